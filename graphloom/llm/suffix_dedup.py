"""Removal of passages that start anywhere else too, by a distributed merge sort of suffixes.

Which suffixes. Of each run of ``2 * width`` starting places one is the *anchor*: the one
whose next bytes have the smallest hash. A window of ``length`` bytes names its anchor by
its own bytes alone, so equal windows have anchors at equal distances. The distance's
range is cut in two cells of ``width``; a cell stands for the windows that start up to
``width`` - 1 bytes before a place and shares with all of them its *core*, the
``length`` + 1 - ``width`` bytes from that place on. So one suffix, cut at ``length`` bytes,
is sorted for a cell, not one for each byte, and no window is without one.

Which cells. A core whose hash occurs once occurs once. Only hashes are counted; suffixes
of the other cells alone are sorted.

The sort. Each task sorts its suffixes in runs, codes them by common prefixes, cuts the runs
at splitters taken from a sample, and exchanges the pieces. A part is merged by a tree of
losers that knows common prefixes, and cells with one core leave it side by side. Their
windows are equal where the bytes round the core are: these, at most ``width`` - 1 on either
side, go with the suffix.

A core that is too frequent for one part is dealt to several. What a part finds among its
own is certain; cells that it leaves open go on, equal ones as one, to a next round with cells
of half the width. At width one a core is a whole window.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, small_batches, text_or_empty
from graphloom.llm.components import FEW
from graphloom.llm.suffix_runs import Run, difference, front_coded, merged

#: Suffixes of a sorted run and of a part, about; parts sorted in one go, beyond which cores
#: are sorted slice by slice; suffixes of the sample for each splitter.
RUN_KEYS, PART_KEYS, MOST_PARTS, SAMPLED = 50_000, 20_000, 4096, 16
#: Starting places hashed at once, and the hash's multiplier.
PLACES, BASE, MIX = 1 << 20, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

RUNS = "part int, shared binary, lengths binary, rests binary, rows binary, places binary, after binary, wanted binary"
MERGED = "row long, first long, last long, place long, key binary, after int, wanted boolean"


class Cell(NamedTuple):
    """A place in a text, its suffix and, reversed, the bytes before it; how many bytes of
    the suffix follow the core; whether anyone asks for its windows, or it only attests
    those of others."""

    key: bytes
    row: int
    place: int
    after: int
    wanted: bool


def cell_width(length: int) -> int:
    if length < 3:
        raise ValueError("passages of at least three bytes are needed")
    return 1 << ((length // 3).bit_length() - 1)


class Anchors:
    """The cells of texts that lie end on end in one buffer."""

    def __init__(self, length: int):
        self.length, self.width = length, cell_width(length)
        self.core, self.gram = length + 1 - self.width, length + 1 - 2 * self.width
        self.power, self.back = (np.cumprod(np.full(PLACES + length, x, np.uint64), dtype=np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64)))

    def cells(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, rising and distinct, and the hashes of their cores. ``ends`` says for
        each byte where its text ends."""
        places, hashes = [], []
        for a in range(0, len(data) - self.length + 1, PLACES):
            p, h = self._cells(data[a : a + PLACES + self.length - 1], ends[a : a + PLACES], a)
            places.append(p)
            hashes.append(h)
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        p, first = np.unique(np.concatenate(places), return_index=True)
        return p, np.concatenate(hashes)[first]

    def _cells(self, data: np.ndarray, ends: np.ndarray, a: int) -> tuple[np.ndarray, np.ndarray]:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=sums[1:])

        def hashed(at: np.ndarray | slice, to: np.ndarray | slice, back: np.ndarray) -> np.ndarray:
            h = (sums[to] - sums[at]) * back * np.uint64(MIX)
            return (h ^ (h >> np.uint64(29))) * np.uint64(BASE)

        n = len(data) - self.gram + 1
        # hash above, place below: the least is the first of the smallest hashes
        low = (hashed(slice(0, n), slice(self.gram, None), self.back[:n]) & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
        step = 1
        while step < 2 * self.width:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        start = np.flatnonzero(np.arange(a, a + len(low)) + self.length <= ends[: len(low)])
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        anchor = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(start) != 1)]))
        last = np.concatenate([new[1:], [len(start)]]) - 1
        anchor, nearest, farthest = anchor[new], anchor[new] - start[last], anchor[new] - start[new]
        found = [anchor[nearest < self.width], anchor[farthest >= self.width] - self.width]
        places = np.concatenate(found)
        return places + a, hashed(places, places + self.core, self.back[places]).astype(np.int64)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, and the offsets of its values in them."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cells_of(texts: DataFrame, length: int) -> DataFrame:
    """(id, places, cores) of the texts (id, bytes) that have windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        for b in batches:
            data, offsets = _bytes_of(b.column("bytes"))
            places, hashes = anchors.cells(data, np.repeat(offsets[1:], np.diff(offsets)))
            cut = np.searchsorted(places, offsets)
            own = pa.array(places - np.repeat(offsets[:-1], np.diff(cut)))
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), v) for v in (own, pa.array(hashes))]
            made = pa.RecordBatch.from_arrays([b.column("id"), *lists], names=["id", "places", "cores"])
            yield made.filter(pa.array(np.diff(cut) > 0))

    return small_batches(texts).mapInArrow(run, "id binary, places array<long>, cores array<long>")


def _shared_texts(docs: DataFrame, length: int) -> DataFrame:
    """(row, id, bytes, copies, places): each distinct text once that has cells whose core's
    hash occurs again, with these cells' places and the text's number of rows."""
    cells = materialize(_cells_of(docs.filter(F.length("bytes") >= length), length), "cells")
    each = cells.select("id", F.inline(F.arrays_zip("places", "cores")))
    # written, so that the join below has two plain exchanges, whose hot parts Spark can split
    again = materialize(each.groupBy("cores").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cores"), "cores")
    again = F.broadcast(again) if again.count() <= FEW else again
    places = materialize(each.join(again, "cores", "left_semi").groupBy("id").agg(F.collect_set("places").alias("places")), "places")
    if places.count() <= FEW:  # then texts without such cells stay where they are
        docs = docs.join(F.broadcast(places.select("id")), "id", "left_semi")
    texts = docs.groupBy("id").agg(F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("copies")).join(places, "id")
    return materialize(texts.select(F.monotonically_increasing_id().alias("row"), "id", "bytes", "copies", "places"), "texts")


Source = Callable[[pa.RecordBatch], Iterator[tuple[int, int, Callable[[], Cell]]]]


def _of_texts(length: int, width: int) -> Source:
    """Cells of texts: (row, place, how to make the cell)."""

    def source(b: pa.RecordBatch) -> Iterator[tuple[int, int, Callable[[], Cell]]]:
        for row, text, copies, places in zip(*(b.column(c).to_pylist() for c in ("row", "bytes", "copies", "places"))):
            for p in places:
                yield row, p, lambda p=p, text=text, row=row, copies=copies: Cell(
                    (end := text[p : p + length]) + text[max(0, p - width + 1) : p][::-1], row, p, len(end) - (length + 1 - width), copies == 1
                )

    return source


def _of_halves(length: int, width: int) -> Source:
    """Cells of ``width`` from open ones of twice that width: the nearer and the farther half."""
    core = length + 1 - 2 * width

    def source(b: pa.RecordBatch) -> Iterator[tuple[int, int, Callable[[], Cell]]]:
        for row, p, key, after, wanted in zip(*(b.column(c).to_pylist() for c in ("row", "place", "key", "after", "wanted"))):
            suffix, before = key[: core + after], key[core + after :]
            if after >= width:
                yield row, p, lambda s=suffix, v=before, row=row, p=p, after=after, wanted=wanted: Cell(s + v[: width - 1], row, p, after - width, wanted)
            if len(before) >= width:
                yield row, p - width, lambda s=suffix, v=before, row=row, p=p, after=after, wanted=wanted: Cell(
                    v[:width][::-1] + s[: length - width] + v[width:], row, p - width, min(after, width - 1), wanted
                )

    return source


def _dealt(row: int, place: int) -> int:
    return zlib.crc32(row.to_bytes(8, "little", signed=True) + place.to_bytes(8, "little", signed=True))


class Splitters:
    """Cores that end the parts, in order. A core that ends several is dealt to all of them."""

    def __init__(self, cores: list[bytes]):
        times = Counter(cores)
        self.cores = sorted(times)
        self.times = [times[c] for c in self.cores]
        self.first = np.concatenate([[0], np.cumsum(self.times)]).tolist()
        self.dealt = {c for c, n in times.items() if n > 1}

    def cut(self, cells: list[Cell], core: int) -> Iterator[tuple[int, list[Cell]]]:
        """(part, cells) of sorted cells."""
        keys = [c.key for c in cells]
        a = 0
        for i, s in enumerate(self.cores):
            if a == len(cells):
                return
            b = bisect.bisect_left(keys, s, a)
            c = bisect.bisect_right(keys, s, b, key=lambda k: k[:core])
            if self.times[i] == 1:
                b = c
            yield self.first[i], cells[a:b]
            if b < c:
                dealt: list[list[Cell]] = [[] for _ in range(self.times[i])]
                for x in cells[b:c]:
                    dealt[_dealt(x.row, x.place) // 64 % len(dealt)].append(x)
                yield from ((self.first[i] + j, d) for j, d in enumerate(dealt))
            a = c
        yield self.first[-1], cells[a:]


def _splitters(rows: DataFrame, source: Source, core: int, total: int, slices: int, s: int, parts: int) -> Splitters:
    """From a sample by hash of row and place, of about ``SAMPLED`` cells a part."""
    rate = max(1, total // slices // (parts * SAMPLED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(row, place, cell().key[:core]) for row, place, cell in source(b) if _dealt(row, place) % rate == 0]
            found = [f for f in found if slices == 1 or zlib.crc32(f[2]) % slices == s]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["row", "place", "core"])

    sample = sorted(r["core"] for r in rows.mapInArrow(run, "row long, place long, core binary").dropDuplicates(["row", "place"]).collect())
    return Splitters([sample[i] for i in sorted({i * len(sample) // parts for i in range(1, parts)})] if sample else [])


def _runs(rows: DataFrame, source: Source, core: int, splitters: Splitters, slices: int, s: int) -> DataFrame:
    """Pieces of sorted runs, front-coded, with their parts."""

    def coded(cells: list[Cell]) -> Iterator[dict]:
        for part, own in splitters.cut(sorted(cells), core):
            if own:
                numbers = {"rows": [c.row for c in own], "places": [c.place for c in own], "after": [c.after for c in own], "wanted": [c.wanted for c in own]}
                yield {"part": part, **front_coded([c.key for c in own]), **{k: np.array(v, "<i8").tobytes() for k, v in numbers.items()}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("shared", "lengths", "rests", "rows", "places", "after", "wanted"))])
        held: list[Cell] = []
        for b in batches:
            for _, _, cell in source(b):
                c = cell()
                if slices == 1 or zlib.crc32(c.key[:core]) % slices == s:
                    held.append(c)
                if len(held) == RUN_KEYS:
                    yield pa.RecordBatch.from_pylist(list(coded(held)), schema=kinds)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(list(coded(held)), schema=kinds)

    return rows.mapInArrow(run, RUNS)


def equal_windows(distinct: dict[tuple[bytes, int], int], core: int, width: int) -> dict[tuple[bytes, int], list[tuple[int, int]]]:
    """Of cells with one core, given as (key, after) with their number: the distances from
    the place, as ranges, at which a window equals that of another cell.

    Two cells have equal windows at the distances t where they share t bytes before and
    ``width`` - 1 - t bytes after the core. Between those where a pair's answer can change
    all cells are grouped once.
    """
    bounds, sides = {}, {}
    for key, after in distinct:
        right, left = key[core : core + after], key[core + after :]
        sides[key, after] = left, right
        bounds[key, after] = max(0, width - 1 - after), min(width - 1, len(left))
    if len(distinct) == 1:
        ((one, n),) = distinct.items()
        return {one: [bounds[one]] if n > 1 else []}
    change = {0, *(a for a, _ in bounds.values()), *(b + 1 for _, b in bounds.values())}
    for side, at in ((0, lambda f: f + 1), (1, lambda f: width - 1 - f)):
        ordered = sorted(s[side] for s in sides.values())
        change.update(at(difference(p, q, 0)) for p, q in zip(ordered, ordered[1:]))
    change = sorted(t for t in change if 0 <= t < width)
    out: dict[tuple[bytes, int], list[tuple[int, int]]] = {x: [bounds[x]] if n > 1 else [] for x, n in distinct.items()}
    for t, end in zip(change, [*change[1:], width]):
        windows: dict[tuple[bytes, bytes], list] = {}
        for x, (left, right) in sides.items():
            if bounds[x][0] <= t <= bounds[x][1]:
                windows.setdefault((left[:t], right[: width - 1 - t]), []).append(x)
        for same in windows.values():
            if len(same) > 1:
                for x in same:
                    if distinct[x] == 1:
                        before = out[x].pop()[0] if out[x] and out[x][-1][1] == t - 1 else t
                        out[x].append((before, end - 1))
    return out


def _merge(length: int, width: int, dealt: set[bytes]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A part's runs to rows of MERGED: windows (``first`` to ``last``) that occur again, and
    open cells (with a key)."""
    core = length + 1 - width

    def settle(cells: list[Cell], out: list[tuple]) -> None:
        opened = cells[0].key[:core] in dealt
        if len(cells) < 2 and not opened:
            return
        own: dict[tuple[int, int], Cell] = {}
        for c in cells:  # halves of two cells may be one and the same
            if (c.row, c.place) not in own or c.wanted:
                own[c.row, c.place] = c
        groups: dict[tuple[bytes, int], list[Cell]] = {}
        for c in own.values():
            groups.setdefault((c.key, c.after), []).append(c)
        found = equal_windows({x: len(g) for x, g in groups.items()}, core, width)
        for x, group in groups.items():
            least, most = max(0, width - 1 - x[1]), min(width - 1, len(x[0]) - core - x[1])
            # a core that is dealt has been sampled more than once: at width one that settles it
            ranges = [(0, 0)] if opened and width == 1 else found[x]
            for c in group:
                if c.wanted:
                    out += [(c.row, c.place - b, c.place - a, None, None, None, None) for a, b in ranges]
            if opened and width > 1:
                whole, c = sum(b - a + 1 for a, b in ranges) == most - least + 1, group[0]
                out.append((c.row, None, None, c.place, c.key, c.after, c.wanted and not whole))

    def merge(pieces: pd.DataFrame) -> pd.DataFrame:
        runs = [Run(*r) for r in zip(pieces["shared"], pieces["lengths"], pieces["rests"])]
        rows, places, after, wanted = ([np.frombuffer(v, "<i8").tolist() for v in pieces[c]] for c in ("rows", "places", "after", "wanted"))
        out: list[tuple] = []
        held: list[Cell] = []
        for shared, key, r, i in merged(runs):
            if shared < core and held:
                settle(held, out)
                held = []
            held.append(Cell(key, rows[r][i], places[r][i], after[r][i], bool(wanted[r][i])))
        if held:
            settle(held, out)
        made = pd.DataFrame(out, columns=[c.split()[0] for c in MERGED.split(", ")])
        return made.astype({"row": "int64", "wanted": "boolean"} | {c: "Int64" for c in ("first", "last", "place", "after")})

    return merge


def _windows(texts: DataFrame, length: int) -> DataFrame:
    """(row, first, last): starting places of windows that occur again, for texts of one copy."""
    width = cell_width(length)
    total = texts.agg(F.sum(F.size("places"))).first()[0] or 0
    rows, source, found = texts.select("row", "bytes", "copies", "places"), _of_texts(length, width), []
    while True:
        slices = -(-total // (MOST_PARTS * PART_KEYS)) or 1
        parts = -(-total // slices // PART_KEYS) or 1
        core = length + 1 - width
        opened = []
        for s in range(slices):
            splitters = _splitters(small_batches(rows), source, core, total, slices, s, parts)
            pieces = _runs(small_batches(rows), source, core, splitters, slices, s)
            done = materialize(pieces.groupBy("part").applyInPandas(_merge(length, width, splitters.dealt), MERGED), "merged")
            found.append(done.filter("first is not null").select("row", "first", "last"))
            if splitters.dealt:
                opened.append(done.filter("key is not null").select("row", "place", "key", "after", "wanted"))
        width //= 2
        rows = None
        for o in opened:
            rows = o if rows is None else rows.unionByName(o)
        total = 2 * rows.count() if rows is not None else 0
        if not total:
            break
        source = _of_halves(length, width)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _cuts(windows: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows cover, as (start, end)."""
    out: list[list[int]] = []
    for first, last in sorted(windows):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, b) for a, b in out]


def _cut_texts(docs: DataFrame, length: int) -> DataFrame:
    """(id, spans, kept) of each distinct text that loses bytes."""
    texts = _shared_texts(docs, length)
    windows = _windows(texts, length).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("windows"))
    cut = texts.select("row", "id", "bytes", "copies").join(windows, "row", "left").filter("copies > 1 or windows is not null").select("id", "bytes", "copies", "windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("id", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
        for b in batches:
            made = []
            for i, text, copies, ranges in zip(*(b.column(c).to_pylist() for c in ("id", "bytes", "copies", "windows"))):
                spans = [(0, len(text))] if copies > 1 else _cuts([(r["first"], r["last"]) for r in ranges], length)
                ends = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[p:q] for p, q in zip(ends[::2], ends[1::2]))
                made.append({"id": i, "spans": [{"start": p, "end": q} for p, q in spans], "kept": kept})
            yield pa.RecordBatch.from_pylist(made, schema=kinds)

    return small_batches(cut).mapInArrow(run, "id binary, spans array<struct<start:long,end:long>>, kept binary")


def _numbered(df: DataFrame, key: str, text: str) -> tuple[DataFrame, Column]:
    body = text_or_empty(text)
    return df.select(F.substring(F.unhex(F.sha2(body, 256)), 1, 16).alias("id"), body.cast("binary").alias("bytes")), body


def remove_repeats(df: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, kept, spans), one for each row of ``df``: the bytes that remain and the
    maximal runs removed, as (start, end) in bytes.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else as
    well, in this text or another; texts are judged as they come in. Null texts are empty;
    texts shorter than ``length`` stay. Rows with equal texts, repeated rows too, all lose
    their whole text if it has ``length`` bytes. Keys may be null or repeat; other columns
    are not read. ``kept`` may end inside a character, so it is binary. A text has to fit a
    task's memory about four times, and 40 times a million of its bytes. Texts are told
    apart by 128 bits of their SHA-256.
    """
    docs, body = _numbered(df, key, text)
    cut = materialize(_cut_texts(docs, length), "cut")
    own = df.select(F.col(key).alias("key"), F.substring(F.unhex(F.sha2(body, 256)), 1, 16).alias("id"), body.cast("binary").alias("bytes"))
    spans = F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>"))
    return own.join(cut, "id", "left").select(F.col("key").alias(key), F.coalesce("kept", "bytes").alias("kept"), spans.alias("spans"))


def repeat_digests(df: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_bytes, n_removed, n_spans, kept_sha256) of what ``remove_repeats`` does;
    texts that lose nothing don't travel for it."""
    docs, body = _numbered(df, key, text)
    cut = materialize(_cut_texts(docs, length).select("id", F.octet_length("kept").cast("long").alias("left"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("sha")), "cut")
    own = df.select(F.col(key).alias("key"), F.sha2(body, 256).alias("own"), F.octet_length(body).cast("long").alias("n_bytes"))
    own = own.withColumn("id", F.substring(F.unhex("own"), 1, 16))
    return own.join(cut, "id", "left").select(
        F.col("key").alias(key), "n_bytes", F.coalesce(F.col("n_bytes") - F.col("left"), F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("sha", "own").alias("kept_sha256"),
    )
