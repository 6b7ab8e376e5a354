"""Packing token streams into windows by Karmarkar-Karp multiway differencing.

Documents give whole windows first; what is left of them is packed in groups. In a
group every piece starts as a partial partition of its own. The two partial partitions
with the largest imbalance are merged, the fullest window of one beside the emptiest of
the other, until one partition is left, whose windows are near equal. Should a window
exceed its capacity, the count of windows rises and the pieces are differenced again.

Cuts are free, so a few of a group's remainders are cut into pieces of many sizes, by
which the differencing levels the windows; the others stay whole. A task packs the rows
it reads as they come and holds one group at a time, so memory doesn't grow and nothing
is shuffled. The windows of a task's last group have what tokens there are, near equally;
all others are filled but for a token or two.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.chunks import ChunkMemo, split_chunks
from graphloom.llm.common import small_batches, text_or_empty

#: Windows of a group, and the tokens that each of them leaves free, on average.
GROUP, FREE = 24, 2
#: The share of a group's tokens that is cut fine, and the sizes of such pieces in turn.
FINE, SIZES = 0.12, (64, 48, 32, 24, 16, 12, 8, 6, 4, 3, 2, 1)


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of ``sizes`` dealt to ``windows`` lists with near-equal sums."""
    # a partial partition: imbalance, order, [(sum, indices)] from fullest to emptiest
    heap = [(-s, i, [(s, [i])] + [(0, [])] * (windows - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=lambda w: -w[0])
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], order, joined))
        order += 1
    return [w[1] for w in heap[0][2]] if heap else []


def _cut(sizes: list[int], share: float) -> list[tuple[int, int, int]]:
    """(index, start, length) of pieces: the longest rows, as many as make ``share`` of all
    tokens, are cut fine, the others stay whole."""
    due, out = share * sum(sizes), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if due <= 0:
            out.append((i, 0, sizes[i]))
            continue
        due -= sizes[i]
        at, turn = 0, itertools.cycle(SIZES)
        while at < sizes[i]:
            n = min(next(turn), sizes[i] - at)
            out.append((i, at, n))
            at += n
    return out


def pack_group(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (index, start, length) parts; every token lies in one part and no
    window exceeds the capacity. As many windows as the tokens need; more, one by one,
    while differencing leaves a window over its capacity. No size may exceed it."""
    windows = max(1, -(-sum(sizes) // capacity))
    pieces = _cut(sizes, FINE if windows > 1 else 0)
    while True:
        dealt = differencing([p[2] for p in pieces], windows)
        if max(sum(pieces[i][2] for i in w) for w in dealt) <= capacity:
            return [_joined(sorted(pieces[i] for i in w)) for w in dealt if w]
        windows += 1


def _joined(parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Neighbouring parts of one row as one."""
    out: list[tuple[int, int, int]] = []
    for i, start, n in parts:
        if out and out[-1][0] == i and out[-1][1] + out[-1][2] == start:
            out[-1] = (i, out[-1][1], out[-1][2] + n)
        else:
            out.append((i, start, n))
    return out


_MEMOS: dict[str, ChunkMemo] = {}


def _ids_of(ranks_file: str, pattern: str) -> ChunkMemo:
    if ranks_file not in _MEMOS:
        import base64
        from array import array

        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        _MEMOS[ranks_file] = ChunkMemo(lambda chunk: array("I", encode(chunk)).tobytes())
    return _MEMOS[ranks_file]


def _chunks(text: str) -> list[str]:
    """The pattern looks past white space only where two such characters meet."""
    chunks = split_chunks(text)
    return [text] if any(c[-1:].isspace() or c[1:2].isspace() for c in chunks) else chunks


@functools.cache
def _special(tokenizer_file: str) -> tuple[str, ...]:
    """Strings that the tokenizer takes whole wherever they stand."""
    with open(tokenizer_file, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f)["added_tokens"])


@functools.cache
def _tokenizer(tokenizer_file: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file)


def ids_of(text: str, tokenizer_file: str, ranks_file: str, pattern: str) -> bytes:
    """Little-endian unsigned 32-bit ids of a whole text, as the tokenizer file gives
    them without special tokens added. A text that holds one of the special strings goes
    through the tokenizer itself; others through the same vocabulary's ranks, chunk by
    chunk, which is faster and gives the same ids."""
    if not text:
        return b""
    if any(x in text for x in _special(tokenizer_file)):
        from array import array

        return array("I", _tokenizer(tokenizer_file).encode(text, add_special_tokens=False).ids).tobytes()
    memo = _ids_of(ranks_file, pattern)
    out = b"".join(map(memo.__getitem__, _chunks(text)))
    memo.trim()
    return out


def pack_documents(
    df: DataFrame, tokenizer_file: str, ranks_file: str, pattern: str, capacity: int = 1024, separator: int = 0, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of all rows' tokens: key, start, length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset.

    Every row's tokens are followed by ``separator``; null texts count as empty and
    are the separator alone. Rows with one key, a null one too, are separate documents.
    Keys of any type come back as they are. Empty tables give no rows.
    """
    kind = df.schema[key].dataType.simpleString()
    size, end = 4 * capacity, separator.to_bytes(4, "little")
    full = 4 * GROUP * (capacity - min(FREE, capacity - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        rest: list[tuple] = []  # (key, start, ids, doc_tokens)
        held = 0

        def close() -> None:
            nonlocal sequence, rest, held
            for window in pack_group([len(r[2]) // 4 for r in rest], capacity):
                offset = 0
                for i, start, length in window:
                    k, first, ids, tokens = rest[i]
                    rows.append((k, first + start, length, ids[4 * start : 4 * (start + length)], tokens, sequence, offset))
                    offset += length
                sequence += 1
            rest, held = [], 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 7
            kinds = [of_key, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return out

        of_key = None
        for b in batches:
            of_key = b.column("_key").type
            for k, t in zip(b.column("_key").to_pylist(), b.column("_text")):
                ids = ids_of(t.as_py(), tokenizer_file, ranks_file, pattern) + end
                tokens, at = len(ids) // 4, 0
                while len(ids) - at >= size:
                    rows.append((k, at // 4, capacity, ids[at : at + size], tokens, sequence, 0))
                    sequence += 1
                    at += size
                    if len(rows) >= 2000:
                        yield flush()
                while at < len(ids):
                    # the last remainder of a group is cut so that the group fills its windows
                    part = ids[at : at + full - held]
                    rest.append((k, at // 4, part, tokens))
                    at, held = at + len(part), held + len(part)
                    if held == full:
                        close()
                if len(rows) >= 2000:
                    yield flush()
        if rest:
            close()
        if rows:
            yield flush()

    return small_batches(df.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text"))).mapInArrow(
        run, f"`{key}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
