"""Sorted runs of byte strings, front-coded, and their merge by common prefixes.

In a run each key is kept as the number of bytes that it shares with the key before, and
the rest. The merge never looks at shared bytes again: of two candidates that both follow
the last key put out, the one that shares more bytes with it comes first, and only where
they share equally many are bytes beyond those compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Keys whose neighbours are compared at once.
AT_ONCE = 2048


def difference(a: bytes, b: bytes, at: int) -> int:
    """The first place from ``at`` on where ``a`` and ``b`` differ, or the shorter's end."""
    most = min(len(a), len(b))
    for end in (min(at + 32, most), most):
        x = int.from_bytes(a[at:end], "big") ^ int.from_bytes(b[at:end], "big")
        if x:
            return end - (x.bit_length() + 7) // 8
        at = end
    return most


def shared_prefixes(keys: list[bytes]) -> np.ndarray:
    """How many bytes each key shares with the one before; 0 for the first."""
    out, lengths = np.zeros(len(keys), np.int64), np.array([len(k) for k in keys], np.int64)
    for a in range(0, len(keys) - 1, AT_ONCE):
        some = keys[a : a + AT_ONCE + 1]
        wide = max(1, int(lengths[a : a + len(some)].max()))
        table = np.frombuffer(b"".join(k.ljust(wide, b"\0") for k in some), np.uint8).reshape(-1, wide)
        differ = table[1:] != table[:-1]
        first = differ.argmax(1)
        first[~differ[np.arange(len(first)), first]] = wide
        out[a + 1 : a + len(some)] = np.minimum(first, np.minimum(lengths[a : a + len(some) - 1], lengths[a + 1 : a + len(some)]))
    return out


def front_coded(keys: list[bytes]) -> dict[str, bytes]:
    """Sorted keys as numbers of shared bytes, numbers of other bytes, and those bytes."""
    shared = shared_prefixes(keys)
    rests = [k[s:] for k, s in zip(keys, shared.tolist())]
    return {"shared": shared.astype("<u4").tobytes(), "lengths": np.array([len(r) for r in rests], "<u4").tobytes(), "rests": b"".join(rests)}


class Run:
    """Reads a front-coded run key by key; ``key`` is the current one."""

    def __init__(self, shared: bytes, lengths: bytes, rests: bytes):
        self.shared, self.lengths, self.rests = np.frombuffer(shared, "<u4").tolist(), np.frombuffer(lengths, "<u4").tolist(), rests
        self.index, self.at, self.key = -1, 0, b""

    def step(self) -> int:
        """The bytes that the next key shares with this one; -1 at the end."""
        self.index += 1
        if self.index == len(self.shared):
            return -1
        s, end = self.shared[self.index], self.at + self.lengths[self.index]
        self.key, self.at = self.key[:s] + self.rests[self.at : end], end
        return s


def merged(runs: list[Run]) -> Iterator[tuple[int, bytes, int, int]]:
    """All keys in order, each as (bytes shared with the one before, key, run, index).

    A tree of losers: ``lost[node]`` is the run that lost there, and ``shared[run]`` says
    how many bytes its key shares with the key that beat it, so with the last key put out
    for every node on the winner's path; a run that has ended has -1 and loses.
    """
    n = len(runs)
    if not n:
        return
    shared, lost = [r.step() for r in runs], [0] * n

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = shared[a], shared[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        p, q = runs[a].key, runs[b].key
        d = difference(p, q, x)
        first, last = (a, b) if p[d : d + 1] <= q[d : d + 1] else (b, a)
        shared[last] = d
        return first, last

    def build(node: int) -> int:
        if node >= n:
            return node - n
        first, lost[node] = play(build(2 * node), build(2 * node + 1))
        return first

    best = build(1) if n > 1 else 0
    while shared[best] >= 0:
        run = runs[best]
        yield shared[best], run.key, best, run.index
        shared[best] = run.step()
        node = (best + n) // 2
        while node:
            other = lost[node]
            x, y = shared[best], shared[other]
            if x < y:
                best, lost[node] = other, best
            elif x == y:
                best, lost[node] = play(best, other)
            node //= 2
