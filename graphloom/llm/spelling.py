"""Spelling variants by full generation of a word's neighbourhood.

For each word of the vocabulary every distinct deletion, replacement and insertion over
the vocabulary's alphabet is made, and those that are words themselves are its near words:
two words that meet this way differ by one code point, so that nothing is verified
afterwards.

A word has over a thousand neighbours, nearly none of which is a word. So they are made as
hashes, in numpy, and asked of a bitmap of the vocabulary's hashes first; those that pass
are spelt out and hash-joined with the vocabulary. A bitmap serves ``SLICE_WORDS`` words at
most and is as large as that needs; a larger vocabulary is gone through slice by slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, small_batches

#: Words that one bitmap serves, of 32 bits each: 32 MB at most reach a task.
SLICE_WORDS = 8_000_000
#: Bytes of a bitmap's parts, and words whose neighbours are made at once.
PART_BYTES, AT_ONCE = 1 << 16, 512
#: The multiplier of the hash by place, and its mixer.
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(df: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """(word, n): the distinct words of ``shortest`` code points and ``least`` occurrences.

    Words are maximal runs of letters, in which A-Z alone are lower-cased. Where ``every``
    divides the crc32 of ``<key>:<word>``, one code point is left out: that at crc32 modulo
    length. A null key counts as an empty one; null texts have no words.
    """
    # a run that is too short already can't be one afterwards
    runs = F.expr(f"regexp_extract_all(cast(`{text}` as string), '[A-Za-z\\\\u00C0-\\\\u00FF]{{{shortest},}}', 0)")
    tokens = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(runs).alias("run"))
    low = tokens.select("k", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("w"))
    hashed = low.select("w", F.crc32(F.concat_ws(":", "k", "w").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("w")).cast("int")
    spelt = hashed.select(F.when(F.pmod("h", F.lit(every)) == 0, F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))).otherwise(F.col("w")).alias("word"))
    return spelt.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least) & (F.length("word") >= shortest))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n + 1, BASE, np.uint64), dtype=np.uint64)


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def _by_length(words: list[str]) -> Iterator[list[str]]:
    by: dict[int, list[str]] = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    yield from by.values()


def _hash(codes: np.ndarray) -> np.ndarray:
    return (codes * _powers(codes.shape[1])[:-1]).sum(1, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(32))


def word_hashes(words: list[str]) -> np.ndarray:
    at = {w: i for i, w in enumerate(words)}
    out = np.zeros(len(words), np.uint64)
    for group in _by_length(list(at)):
        out[[at[w] for w in group]] = _hash(_codes(group))
    return out


def neighbourhood(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[str, int, np.ndarray, np.ndarray | None]]:
    """The distinct neighbours of words of one length, as (kind, place, hashes with a row
    for each word, which of them count): kind d deletes the place, r replaces it by, and i
    inserts before it, each letter. Of equal results one alone counts."""
    n, length = codes.shape
    power = _powers(length)
    terms = codes * power[:length]
    before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(terms, 1, dtype=np.uint64)], 1)
    total = before[:, -1:]
    down = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(codes[:, 1:] * power[: length - 1], 1, dtype=np.uint64)], 1)
    up = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(codes * power[1:], 1, dtype=np.uint64)], 1)
    for j in range(length):
        # of a run of one letter the first is deleted
        new = np.ones((n, 1), bool) if j == 0 else codes[:, j : j + 1] != codes[:, j - 1 : j]
        yield "d", j, before[:, j : j + 1] + down[:, -1:] - down[:, j : j + 1], new
        yield "r", j, total - terms[:, j : j + 1] + alphabet * power[j], alphabet != codes[:, j : j + 1]
    for j in range(length + 1):
        # before a letter itself it isn't inserted, but after it
        new = None if j == length else alphabet != codes[:, j : j + 1]
        yield "i", j, before[:, j : j + 1] + up[:, -1:] - up[:, j : j + 1] + alphabet * power[j], new


def spelt(word: str, kind: str, j: int, letter: str) -> str:
    return word[:j] + ("" if kind == "d" else letter) + word[j + (kind != "i") :]


def _bits(h: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    m = _mixed(h)
    return m & np.uint64(mask), (m >> np.uint64(32)) & np.uint64(mask)


def build_bitmap(words: DataFrame, mask: int) -> np.ndarray:
    """Two bits a word of ``mask`` + 1 bits, from parts that tasks make."""
    parts = (mask + 1) // 8 // PART_BYTES or 1

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(_bits(word_hashes(b.column("word").to_pylist()), mask)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"part": pa.array(at // (PART_BYTES * 8), pa.int32()), "at": pa.array(at % (PART_BYTES * 8), pa.int32())})

    def part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(PART_BYTES * 8, bool)
        flags[rows["at"]] = True
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    made = small_batches(words).select("word").mapInArrow(places, "part int, at int").groupBy("part").applyInPandas(part, "part int, bits binary")
    out = np.zeros(parts * PART_BYTES, np.uint8)
    for r in made.collect():
        out[r["part"] * PART_BYTES : (r["part"] + 1) * PART_BYTES] = np.frombuffer(r["bits"], np.uint8)
    return out


def _survivors(words: DataFrame, bitmap: np.ndarray, mask: int, letters: str) -> DataFrame:
    """(word, near) of the neighbours whose bits are set."""
    held = words.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, alphabet = held.value, np.array([ord(c) for c in letters], np.uint64)
        lit = lambda at: (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0
        for b in batches:
            of, near = [], []
            for group in _by_length(b.column("word").to_pylist()):
                for a in range(0, len(group), AT_ONCE):
                    some = group[a : a + AT_ONCE]
                    for kind, j, h, new in neighbourhood(_codes(some), alphabet):
                        first, second = _bits(h, mask)
                        found = lit(first)
                        if new is not None:
                            found &= new
                        row, letter = np.nonzero(found)
                        kept = lit(second[row, letter])
                        of += [some[i] for i in row[kept]]
                        near += [spelt(some[i], kind, j, letters[c]) for i, c in zip(row[kept], letter[kept])]
            if of:
                yield pa.RecordBatch.from_pydict({"word": pa.array(of, pa.string()), "near": pa.array(near, pa.string())})

    return small_batches(words).select("word").mapInArrow(run, "word string, near string")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n): each pair of near words of a vocabulary (word, n), both ways.
    Its alphabet comes to the driver: at most the letters that there are."""
    count = vocabulary.count()
    alphabet = "".join(sorted(r["c"] for r in vocabulary.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().collect()))
    slices, found = max(1, -(-count // SLICE_WORDS)), None
    mask = (1 << max(19, int(np.ceil(np.log2(32 * max(1, -(-count // slices))))))) - 1
    for s in range(slices):
        own = vocabulary if slices == 1 else vocabulary.filter(F.pmod(F.xxhash64("word"), F.lit(slices)) == s)
        pairs = _survivors(vocabulary, build_bitmap(own, mask), mask, alphabet).join(own.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
        pairs = materialize(pairs.select("word", "near", "near_n"), "near")
        found = pairs if found is None else found.unionByName(pairs)
    return found


def group_variants(df: DataFrame, key: str = "doc_id", text: str = "text", ratio: int = 5, **counting) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one for each word of all texts.

    A word's form is its near word of largest n (of equally many the smallest), if that
    is ``ratio`` times its own n or more; the root is the last word along the forms. Null
    and empty texts have no words and empty tables give no rows; repeated rows count
    again. Other columns are not read. ``counting`` goes to ``count_words``.
    """
    vocabulary = materialize(count_words(df, key, text, **counting), "words")
    best = near_words(vocabulary).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    form = (-F.col("best.less") >= ratio * F.col("n")) & F.col("best").isNotNull()
    words = materialize(
        vocabulary.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("best.near")).alias("form"), F.when(form, -F.col("best.less")).alias("form_n")
        ),
        "forms",
    )
    # along the forms n grows, so that they end; each round doubles the steps
    ahead = materialize(words.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(ahead.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        ahead = step.select("word", "root")
        if step.filter("moved").isEmpty():
            break
    return words.join(ahead, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
