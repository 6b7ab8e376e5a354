"""Passages removed, vectors whitened, spellings grouped: brute force and odd input."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

CLASHES = ["id", "bytes", "row", "place", "key", "kept", "spans", "own", "copies", "part", "x", "v", "k", "w", "word", "n", "component", "near", "h"]


def with_clashes(df):
    for c in CLASHES:
        df = df.withColumn(c, F.lit("own"))
    return df


# ---- suffixes


@settings(deadline=None, max_examples=200)
@given(st.lists(st.lists(st.binary(max_size=9).map(lambda b: bytes(x % 3 for x in b)), max_size=12), min_size=1, max_size=9))
def test_runs_merge_in_order_and_know_what_they_share(parts):
    from graphloom.llm.suffix_runs import Run, front_coded, merged

    parts = [sorted(p) for p in parts]
    got = list(merged([Run(**front_coded(p)) for p in parts]))
    assert [k for _, k, _, _ in got] == sorted(k for p in parts for k in p)
    assert all(parts[r][i] == k for _, k, r, i in got)
    before = b""
    for shared, key, _, _ in got:
        assert shared == next((i for i in range(min(len(key), len(before))) if key[i] != before[i]), min(len(key), len(before)))
        before = key


def test_merge_compares_no_shared_byte_again(monkeypatch):
    from graphloom.llm import suffix_runs

    compared, real = [], suffix_runs.difference
    monkeypatch.setattr(suffix_runs, "difference", lambda a, b, at: compared.append((len(a), at)) or real(a, b, at))
    keys = sorted(b"x" * 500 + bytes([i, j]) for i in range(20) for j in range(20))
    assert [k for _, k, _, _ in suffix_runs.merged([suffix_runs.Run(**suffix_runs.front_coded(keys[i::4])) for i in range(4)])] == keys
    # but for the tree's first games all comparisons begin behind the shared 500 bytes
    assert sum(at < 500 for _, at in compared) <= 3


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text("ab", max_size=60), max_size=12), st.sampled_from([3, 5, 12, 20]))
def test_every_window_has_a_cell_that_its_bytes_alone_choose(texts, length):
    from graphloom.llm.suffix_dedup import Anchors

    a, raw = Anchors(length), [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    places, hashes = a.cells(np.frombuffer(b"".join(raw), np.uint8), np.repeat(offsets[1:], np.diff(offsets)))
    whole, by_window, by_core = b"".join(raw), {}, {}
    for p, h in zip(places.tolist(), hashes.tolist()):
        assert by_core.setdefault(whole[p : p + a.core], h) == h
    held = set(places.tolist())
    for start, end in zip(offsets, offsets[1:]):
        for i in range(start, end - length + 1):
            distances = {p - i for p in range(i, i + a.width) if p in held}
            by_window.setdefault(whole[i : i + length], []).append(distances)
    # equal windows have a distance in common, at which both have a cell
    assert all(set.intersection(*d) for d in by_window.values())


def removed(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    times = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (k, _), b in zip(rows, raw):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((k, len(b), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if b else 0, hashlib.sha256(kept).hexdigest()))
    return out


ORDER = lambda t: (t[0] is not None, t[0] or 0, t[1:])


@pytest.mark.parametrize("length, part_keys, slices", [(3, 20_000, 4096), (12, 20_000, 4096), (40, 7, 4096), (12, 5, 3)])
def test_removal_equals_brute_force(spark, monkeypatch, length, part_keys, slices):
    """Also with parts so small that cores are dealt to several, and sorted by slices."""
    from graphloom.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "PART_KEYS", part_keys)
    monkeypatch.setattr(suffix_dedup, "MOST_PARTS", slices)
    r = random.Random(length * part_keys)
    base, rows = ["".join(r.choices("abé ", k=r.randint(0, 150))) for _ in range(6)], []
    for i in range(40):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2]) if t else 0):
            t[r.randrange(len(t))] = r.choice("abxyz")
        if r.random() < 0.4:
            t = [*r.choices("abcdefgh ", k=r.randint(0, 60)), *t[r.randint(0, 20) :]]
        rows.append((r.choice([i, i, None, 3]), r.choice(["".join(t), "".join(t), "a" * r.randint(0, 90), None])))
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(x) for x in suffix_dedup.repeat_digests(df, length).collect()]
    assert sorted(got, key=ORDER) == sorted(removed(rows, length), key=ORDER)


def test_removal_keeps_bytes_and_takes_any_columns(spark):
    from graphloom.llm.suffix_dedup import remove_repeats, repeat_digests

    shared = "the same passage stands in both texts, é "
    rows = [(1, "one " + shared * 2), (2, shared + "two"), (None, None), (4, ""), (5, "x" * 30000), (6, "short")]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in remove_repeats(df, 30).collect():
        raw = (dict(rows)[r.doc_id] or "").encode()
        gone = [raw[s.start : s.end] for s in r.spans]
        left, at = b"", 0
        for s in r.spans:
            left, at = left + raw[at : s.start], s.end
        assert r.kept == left + raw[at:] and all(len(g) >= 30 for g in gone)
    got = [tuple(x) for x in repeat_digests(df, 30).collect()]
    assert sorted(got, key=ORDER) == sorted(removed(rows, 30), key=ORDER)
    assert repeat_digests(df.limit(0)).count() == 0 and repeat_digests(df.filter("doc_id = 4")).count() == 1


# ---- vectors


def test_rotations_find_small_deviations():
    from graphloom.llm.whitening import jacobi

    r = np.random.default_rng(1)
    q, _ = np.linalg.qr(r.normal(size=(9, 9)))
    sizes = 10.0 ** np.arange(4, -5, -1)
    lengths, v = jacobi(np.linalg.qr(r.normal(size=(300, 9)) @ np.diag(sizes) @ q.T, mode="r"))
    assert np.allclose(v.T @ v, np.eye(9), atol=1e-14)
    assert (np.diff(lengths) <= 0).all() and np.allclose(np.log10(lengths / lengths[0]), -np.arange(9), atol=0.5)
    for m in (np.zeros((1, 3)), np.ones((2, 5)), np.array([[3.0]])):
        lengths, v = jacobi(m)
        assert np.allclose((m @ v) ** 2 @ np.ones(m.shape[1]), (m**2).sum(1)) and np.allclose(np.sqrt(((m @ v) ** 2).sum(0)), lengths)


def test_whitening_equals_eigenvectors(spark, monkeypatch):
    from graphloom.llm import whitening

    monkeypatch.setattr(whitening, "FAN_IN", 2)
    r = np.random.default_rng(2)
    e = (r.normal(size=(157, 6)) @ r.normal(size=(6, 6))).astype(np.float32)
    odd = [(500, None), (501, [0.5] * 5 + [None]), (502, [0.5] * 5 + [float("nan")]), (503, [0.5] * 5 + [float("-inf")]), (504, []), (505, [1.0] * 5), (506, [1e30] * 6), (507, [0.0] * 6), (None, [0.25] * 6), (7, [1.0] * 6)]
    rows = [(i, v.tolist()) for i, v in enumerate(e)] + odd
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).repartition(7)
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in v] for v in [*e, [0.0] * 6, [0.25] * 6, [1.0] * 6]])
    n, sums = len(x), x.sum(0)
    got = whitening.whiten(df).toPandas()
    assert len(got) == 6 * n and set(got.n) == {n}
    c = x - sums / n
    w, u = np.linalg.eigh(c.T @ c / n)
    expected = (c @ u[:, ::-1]) / np.sqrt(w[::-1])
    own = {k: g.sort_values("component") for k, g in got[got.vec_id.notna() & (got.vec_id != 7)].groupby("vec_id")}
    table = np.array([own[i].whitened for i in [*range(7), *range(8, 157), 507]])
    assert np.allclose(np.abs(table), np.abs(expected[[*range(7), *range(8, 157), 157]]), atol=1e-9)
    assert np.allclose(own[0].explained, w[::-1] / w.sum()) and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    assert [int(own[i].deviation.iloc[0]) for i in range(7)] == exact[:7]
    assert len(got[got.vec_id == 7]) == 12 and got.vec_id.isna().sum() == 6


def test_deviations_beyond_a_long_are_exact():
    from graphloom.llm.whitening import Centre

    x = np.array([[1 << 50, 5], [3, -(1 << 49)], [1, 2]])
    n, sums = 1_000_003, [int(s) + 12345 for s in x.sum(0)]
    got = Centre(sums, n).deviations(x)
    assert got == [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x] and max(got) > 1 << 64
    c = Centre(sums, n)(x)
    assert all(abs(float(Fraction(int(a)) - Fraction(s, n)) - b) <= 1e-15 * abs(b) + 1e-15 for row, out in zip(x, c) for a, s, b in zip(row, sums, out))


def test_vectors_without_variance_give_no_rows(spark):
    from graphloom.llm.whitening import whiten

    kind = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], kind)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0])], kind)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0
    flat = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], kind)).collect()
    assert [abs(round(r.whitened, 9)) for r in flat] == [1.0, 1.0] and {r.component for r in flat} == {1}


# ---- words


def variants(rows, ratio=5, shortest=6, least=5, every=199):
    lower, n = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), collections.Counter()
    for k, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % every == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w in n:
        best = [v for v in n if near(w, v)]
        form = min(best, key=lambda v: (-n[v], v), default=None)
        form = form if form and n[form] >= ratio * n[w] else None
        out[w] = form, n[w], len(best), n.get(form)

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return {(w, f, root(w), c, m, k) for w, (f, c, m, k) in out.items()}


def made_words(seed):
    r = random.Random(seed)
    base = ["".join(r.choices("abéÉÿ×", k=r.randint(5, 9))) for _ in range(25)]
    rows = []
    for i in range(60):
        words = []
        for b in r.choices(base, weights=[4**-k * 1e9 for k in range(25)] if seed % 2 else None, k=60):
            if r.random() < 0.3:
                j = r.randrange(len(b))
                b = r.choice([b[:j] + b[j + 1 :], b[:j] + r.choice("abé") + b[j:], b[:j] + r.choice("abé") + b[j + 1 :], b.upper()])
            words.append(b)
        rows.append((r.choice([i, None, 2**60 + i]), r.choice([" ", "1", "_", "中🙂"]).join(words)))
    return [*rows, *rows[:2], (5, None), (5, ""), (6, "hallöchen" * 4000)]


@pytest.mark.parametrize("seed, slice_words", [(1, 8_000_000), (2, 50)])
def test_variants_equal_brute_force(spark, monkeypatch, seed, slice_words):
    from graphloom.llm import spelling

    monkeypatch.setattr(spelling, "SLICE_WORDS", slice_words)
    rows = made_words(seed)
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [tuple(r) for r in spelling.group_variants(df, least=2, every=7).collect()]
    expected = variants(rows, least=2, every=7)
    assert len(got) == len(expected) and set(got) == expected and any(r[1] for r in got)


def test_neighbourhoods_are_whole_and_distinct():
    from graphloom.llm.spelling import _codes, neighbourhood, spelt, word_hashes

    letters, r = "abcé", random.Random(3)
    for word in ["a", "aab", *("".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(30))]:
        made, hashes = [], []
        for kind, j, h, new in neighbourhood(_codes([word]), np.array([ord(c) for c in letters], np.uint64)):
            for c in range(h.shape[1]):
                if new is None or np.broadcast_to(new, h.shape)[0, c]:
                    made.append(spelt(word, kind, j, letters[c]))
                    hashes.append(h[0, c])
        whole = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + d :] for i in range(len(word) + 1) for c in letters for d in (0, 1) if i + d <= len(word)}
        assert len(made) == len(set(made)) and set(made) == whole - {word}
        assert (word_hashes(made) == np.array(hashes, np.uint64)).all()


def test_no_words_no_rows(spark):
    from graphloom.llm.spelling import group_variants

    assert group_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert group_variants(spark.createDataFrame([(1, None), (2, "a b c"), (3, "")], "doc_id long, text string")).count() == 0


# ---- neighbours


def test_neighbours_of_hard_tables(spark):
    """Nulls, other lengths, repeated keys and vectors, zero vectors, columns of any name."""
    from graphloom.llm.nn_descent import nearest

    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=8).round(3).tolist()) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(3, rows[3][1]), (7, [9.0] * 8), (2**60 + 20, [0.5] * 8)]
    rows += [(200, None), (220, [0.0] * 8), (240, [1.0] * 7 + [None]), (260, [1.0] * 7 + [float("inf")]), (280, [1.0] * 5), (None, [1.0] * 8), (300, [])]
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).withColumn("score", F.lit("own")).withColumn("rank", F.lit("own"))
    usable = {}
    for k, v in rows:
        if k is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.float32(v).astype(float).tolist()
            usable[k] = min(usable.get(k, v), v)
    asked = df.filter("vec_id % 20 = 0")
    got = {}
    for x in nearest(df, asked, 20).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    assert set(got) == {k for k in usable if k % 20 == 0}
    for q, found in got.items():
        best = sorted((-float(np.dot(usable[q], v)), k) for k, v in usable.items() if k != q)[:20]
        assert [k for _, k, _ in sorted(found)] == [k for _, k in best] and np.allclose([s for _, _, s in sorted(found)], [-s for s, _ in best])
    assert nearest(df.limit(0), asked.limit(0), 20).count() == 0
