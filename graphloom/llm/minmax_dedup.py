"""Near-duplicate detection by min-max hashing.

Each permutation of the shingles gives two values, its minimum and its maximum, so a
signature needs half the hash evaluations for the same length; the share of equal
values stays an unbiased estimate of the Jaccard similarity, with less variance.
Bands of the signature name buckets, and documents that share a bucket are compared
on their full shingle sets.

Texts with one shingle set are one class and travel as one. A bucket's members meet
with their signatures, two bits of each value, inside a task: whoever has been reached
through likely pairs is compared with those that haven't, and only the pairs that reached
somebody become rows, fewer than members. Large buckets are cut into blocks, and every
two blocks meet. The pairs are then compared on full sets. Where all of a cluster's pairs
are links the cluster is a component; elsewhere the full sets of the cluster's parts meet
in tasks, block by block, until it is known which parts are linked. So no link between
texts that share a bucket is lost, and pairs never become rows in number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import byte_slices, materialize, runs_of, small_batches, text_or_empty
from graphloom.llm.components import FEW, connected_components, look_up

#: Values of a signature, at most so many to a band, and how often a pair at the
#: threshold may escape all bands.
VALUES, ROWS, MISSED = 256, 8, 1 / 25_000
#: Members of a block, and bytes of the full sets of one, about.
BLOCK, SET_BYTES = 2048, 16_000_000
#: Parts into which the rows of one class are dealt.
SALTS = 64

_R = np.random.default_rng(20240607)
_BYTE = _R.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = _R.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_MUL = (_R.integers(1, 1 << 32, VALUES // 2, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _R.integers(0, 1 << 32, VALUES // 2, dtype=np.uint64).astype(np.uint32)
_FOLD = _R.integers(1, 1 << 63, (VALUES, ROWS + 1), dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
#: The low bit of each two.
_LOW = np.uint64(0x5555555555555555)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit prints of each text's ``words``-word shingles.

    A-Z are lower-cased, words are runs without space and \\x09-\\x0d. A text with
    fewer words is one shingle of all of them; one without words has an empty set.
    """
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(raw)
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if not len(data):
        return out
    begins = np.cumsum([0, *[len(r) + 1 for r in raw[:-1]]])
    solid = ~_SPACE[data]
    edge = np.diff(solid.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return out
    size = last - first
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    word = _mix(np.add.reduceat(_BYTE[data[solid]] * _powers(int(size.max()))[place], at))
    owner = np.searchsorted(begins, first, "right") - 1
    count = np.bincount(owner, minlength=len(raw))
    start = np.cumsum(count) - count
    n = len(word) - words + 1
    if n > 0:
        grams = word[:n] * _STEP[0]
        for j in range(1, words):
            grams = grams + word[j : j + n] * _STEP[j]
        grams = _mix(grams)
    for d in np.flatnonzero(count):
        s, c = int(start[d]), int(count[d])
        if c >= words:
            out[d] = np.unique(grams[s : s + c - words + 1])
        else:
            out[d] = _mix((word[s : s + c] * _STEP[:c]).sum(keepdims=True) + _STEP[63] * np.uint64(c))
    return out


def band_rows(percent: int) -> int:
    """Values of a band: as many whole permutations as keep a pair at ``percent`` from
    escaping more than ``MISSED``, or one value. 8 at 85, 6 at 80."""
    p = percent / 100
    return next((r for r in range(ROWS, 1, -2) if (1 - p**r) ** (VALUES // r) <= MISSED), 1)


def min_max(sets: list[np.ndarray]) -> np.ndarray:
    """The signatures of non-empty sets: len(sets) x VALUES."""
    sizes = np.array([len(s) for s in sets])
    at = np.cumsum(sizes) - sizes
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    values = np.empty((len(sets), VALUES), np.uint64)
    for j in range(VALUES // 2):
        y = x * _MUL[j] + _ADD[j]
        values[:, 2 * j] = np.minimum.reduceat(y, at)
        values[:, 2 * j + 1] = np.maximum.reduceat(y, at)
    return values


def band_prints(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A print for each band of ``rows`` values of each signature."""
    n = VALUES // rows
    values = values[:, : n * rows].reshape(len(values), n, rows)
    bands = (values * _FOLD[:n, :rows]).sum(axis=2, dtype=np.uint64)
    return _mix(bands + _FOLD[:n, ROWS]).view(np.int64)


def marks_of(values: np.ndarray) -> np.ndarray:
    """Two bits of each value of each signature: len(values) x VALUES / 32 of 64 bits."""
    two = (_mix(values) & np.uint64(3)).reshape(len(values), -1, 32)
    return np.bitwise_or.reduce(two << np.arange(0, 64, 2, dtype=np.uint64), axis=2)


def most_different(percent: int) -> int:
    """Marks of two signatures that differ at most, for a pair at ``percent``: five standard
    deviations over the mean, the two values of a permutation taken as one."""
    p, n = 0.75 * (1 - percent / 100), VALUES
    return int(n * p + 5 * (2 * n * p * (1 - p)) ** 0.5) + 1


def _print_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, n_shingles, component_id (the smallest key that
    links reach, its own included) and kept (the key is that smallest one).

    Two texts are linked when 100 times their common shingles is at least ``percent``
    times their distinct shingles, taken on the full sets. Null and wordless texts
    have an empty set and are linked with nothing. Keys are integers; rows with a null
    key are in a component of their own class only. Repeated rows are in one component.
    Other columns, whatever their names, are not read. Empty tables give no rows.
    """
    per_band = band_rows(percent)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in byte_slices(b, "body"):
                sets = shingle_sets(part.column("body").to_pylist(), words)
                full = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                marks: list = [None] * len(sets)
                if full:
                    values = min_max([sets[i] for i in full])
                    for i, row, mark in zip(full, band_prints(values, per_band), marks_of(values)):
                        bands[i], marks[i] = row, mark.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_print_of(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(marks, pa.binary()),
                    ],
                    ["id", "n", "print", "bands", "marks"],
                )

    docs = df.select(F.col(key).cast("long").alias("id"), text_or_empty(text).alias("body"))
    printed = materialize(small_batches(docs).mapInArrow(prints, "id long, n long, print binary, bands array<long>, marks binary"), "prints")
    # texts with equal sets are one class, named by its smallest key
    classes = materialize(
        printed.filter("n > 0 and id is not null")
        .groupBy("print")
        .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("marks").alias("marks")),
        "classes",
    )
    labels = _link(classes, docs, words, percent)

    salted = printed.select("id", "n", "print", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    named = classes.select("print", "rep").join(labels, "rep", "left").select("print", F.coalesce("component", "rep").alias("component"))
    dealt = salted.filter("n > 0").groupBy("print", "salt").agg(F.count(F.lit(1)).alias("_")).drop("_").join(named, "print")
    found = salted.join(dealt, ["print", "salt"], "left")
    return found.select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )


def _likely(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: pairs of classes whose signatures allow a link, enough of them to
    reach within each bucket whatever all such pairs reach."""
    rows = classes.select("rep", F.explode("bands").alias("band"))
    shared = materialize(rows.groupBy("band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "shared")
    members = rows.join(shared, "band").join(classes.select("rep", "n", "marks"), "rep")
    # a large bucket is cut into blocks, and every two of them meet in a group
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    cut = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep", "band"), F.col("blocks")).cast("int"))
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own")))
    met = cut.withColumn("other", F.explode(other)).select("band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "rep", "n", "marks")
    grouped = met.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "rep")
    most = most_different(percent)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _in_lots(_forest(g, percent, most) for g in runs_of(batches, ["band", "lo", "hi"])):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return materialize(small_batches(grouped).mapInArrow(join, "a long, b long").distinct(), "likely")


def _in_lots(pairs: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of arrays, put together so that few are passed on."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for p in pairs:
        if len(p[0]):
            held.append(p)
            n += len(p[0])
        if n >= most:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _bits(marks: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(marks), np.uint64).reshape(len(marks), -1)


def _alike(x: np.ndarray, n: np.ndarray, i: int, others: np.ndarray, percent: int, most: int) -> np.ndarray:
    """Which ``others`` could be linked with ``i``, by sizes and signatures."""
    sized = 100 * np.minimum(n[i], n[others]) >= percent * np.maximum(n[i], n[others])
    d = x[others] ^ x[i]
    return sized & (np.bitwise_count((d | (d >> np.uint64(1))) & _LOW).sum(axis=1, dtype=np.int64) <= most)


def _forest(group: pa.Table, percent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that reach what all likely pairs of a group reach: whoever has been reached
    is compared with those that have not, and with nobody else."""
    ids, n = group.column("rep").to_numpy(), group.column("n").to_numpy()
    x = _bits(group.column("marks").to_pylist())
    left, queue = np.arange(1, len(ids)), [0]
    a, b = [], []
    while len(left):
        if queue:
            i = queue.pop()
        else:
            i, left = left[0], left[1:]
        hit = _alike(x, n, i, left, percent, most)
        if hit.any():
            new = left[hit]
            a.append(np.full(len(new), ids[i]))
            b.append(ids[new])
            queue.extend(new.tolist())
            left = left[~hit]
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _link(classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(rep, component) of every class that links reach."""
    likely = _likely(classes, percent)
    clusters = connected_components(likely.select(F.col("a").alias("u"), F.col("b").alias("v"))).toDF("rep", "cluster")
    clusters = materialize(clusters, "clusters")
    n_ids = clusters.count()
    if n_ids == 0:
        return clusters.select("rep", F.col("cluster").alias("component"))
    ids = materialize(clusters.select("rep").join(classes.select("rep", _short("print").alias("own")), "rep"), "ids")

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in byte_slices(b, "body"):
                sets = shingle_sets(part.column("body").to_pylist(), words)
                # a key that stands on several rows names the row whose print its class has
                own = [i for i, (s, p) in enumerate(zip(sets, part.column("own").to_pylist())) if len(s) and int.from_bytes(_print_of(s)[:7]) == p]
                if own:
                    arrays = [part.column("id").take(pa.array(own)), pa.array([sets[i].tobytes() for i in own], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, ["id", "set"])

    few = F.broadcast(ids) if n_ids <= FEW else ids
    wanted = docs.join(few, docs["id"] == ids["rep"]).select("id", "own", "body")
    sets = materialize(small_batches(wanted).mapInArrow(full_sets, "id long, set binary"), "sets")
    if sets.count() > n_ids:  # rows that repeat key and text
        sets = materialize(sets.dropDuplicates(["id"]), "sets")

    checked = materialize(_verified(likely, sets, percent), "checked")
    # clusters in which a likely pair is no link may be several components
    torn = checked.filter(~F.col("linked")).select(F.col("a").alias("rep")).distinct().join(clusters, "rep").select("cluster").distinct()
    torn = materialize(torn, "torn")
    if torn.isEmpty():
        return clusters.select("rep", F.col("cluster").alias("component"))
    n_torn = torn.count()
    inside = clusters.join(F.broadcast(torn) if n_torn <= FEW else torn, "cluster", "left_semi")
    links = checked.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    parts = connected_components(links.join(inside.select(F.col("rep").alias("u")), "u", "left_semi")).toDF("rep", "part")
    inside = materialize(inside.join(parts, "rep", "left").select("rep", "cluster", F.coalesce("part", "rep").alias("part")), "inside")
    found = _across(inside, classes, sets, percent)
    joined = connected_components(found.select(F.col("a").alias("u"), F.col("b").alias("v"))).toDF("part", "whole")
    # a part may have most of the rows: they meet their name in pieces
    named = look_up(inside.select("rep", "part"), joined, "part", "rep", n_ids, "left").select("rep", F.coalesce("whole", "part").alias("settled"))
    return clusters.join(named, "rep", "left").select("rep", F.coalesce("settled", "cluster").alias("component"))


def _short(name: str) -> Column:
    """The first 7 bytes of a print as a number."""
    return F.conv(F.hex(F.substring(name, 1, 7)), 16, 10).cast("long")


def _beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the sets of both as x and y. A class in many pairs is
    dealt to pieces, so that its pairs don't meet in one task."""
    cut = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    lead = cut.select("a", "salt").distinct().join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    return cut.join(lead, ["a", "salt"]).join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` and whether they are links, by their full sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return small_batches(_beside(pairs, sets).select("a", "b", "x", "y")).mapInArrow(compare, "a long, b long, linked boolean")


def _across(inside: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between different parts of one cluster, enough of them to reach
    what all links reach. ``inside``: rep, cluster, part.

    A cluster's full sets meet in one group where they are few; a larger cluster is cut
    into blocks, and every two blocks meet, but those of one part.
    """
    rows = inside.join(classes.select("rep", "n", "marks"), "rep")
    load = F.greatest(F.sum(8 * F.col("n")) / SET_BYTES, F.count(F.lit(1)) / BLOCK)
    # summed by part first: a cluster, or a part, may hold most rows
    by_part = materialize(rows.groupBy("cluster", "part").agg(load.alias("load")), "parts")
    by_cluster = by_part.groupBy("cluster").agg(F.sum("load").alias("all"), F.sum(F.when(F.col("load") <= 1, F.col("load"))).alias("small"), F.count(F.lit(1)).alias("k"))
    by_cluster = by_cluster.filter("k > 1")
    # a part of over one load has blocks of its own; smaller ones share blocks by hash
    sized = by_part.join(by_cluster, "cluster")
    large = (F.col("all") > 1) & (F.col("load") > 1)
    shares = F.when(F.col("all") <= 1, F.lit(1)).when(large, F.ceil("load")).otherwise(F.ceil(F.coalesce("small", F.lit(1.0)))).cast("int")
    placed = materialize(sized.select("cluster", "part", F.when(large, F.col("part")).alias("alone"), shares.alias("blocks")), "placed")
    block = lambda: F.struct(F.coalesce("alone", F.lit(-(1 << 63))).alias("alone"), F.col("k").alias("k"))
    each = placed.select("cluster", "alone", "blocks").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cluster", "alone", block().alias("block"))
    right = each.select("cluster", F.col("alone").alias("alone2"), F.col("block").alias("block2"))
    met = each.join(right, "cluster").filter((F.col("block") < F.col("block2")) & ~F.coalesce(F.col("alone") == F.col("alone2"), F.lit(False)) | (F.col("block") == F.col("block2")) & F.col("alone").isNull())
    met = met.select("cluster", F.xxhash64("block", "block2").alias("group"), F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"))
    home = rows.join(placed.withColumnRenamed("blocks", "m"), ["cluster", "part"]).withColumn("k", F.when(F.col("alone").isNull(), F.pmod(F.xxhash64("part"), F.col("m"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("m"))).cast("int"))
    home = home.select("cluster", block().alias("block"), "part", "rep", "n", "marks")
    dealt = home.join(met, ["cluster", "block"]).join(sets.withColumnRenamed("id", "rep"), "rep").select("cluster", "group", "part", "rep", "n", "marks", "set")
    grouped = dealt.repartition("cluster", "group").sortWithinPartitions("cluster", "group", "part", "rep")
    most = most_different(percent)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _in_lots(_part_links(g, percent, most) for g in runs_of(batches, ["cluster", "group"])):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return materialize(small_batches(grouped).mapInArrow(join, "a long, b long").distinct(), "across")


def _part_links(group: pa.Table, percent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the parts of a group: as in ``_forest``, on full sets, where whoever
    is reached brings all of its part along."""
    part, n = group.column("part").to_numpy(), group.column("n").to_numpy()
    x = _bits(group.column("marks").to_pylist())
    flat = np.frombuffer(b"".join(group.column("set").to_pylist()), np.uint64)
    codes = np.unique(flat, return_inverse=True)[1]
    at = np.cumsum(n) - n
    flag = np.zeros(len(flat), np.int64)
    a, b = [], []
    left, queue = np.arange(len(part)), []
    while len(left):
        if queue:
            i = queue.pop()
        else:
            mine = part[left] == part[left[0]]
            queue, left = left[mine].tolist(), left[~mine]
            continue
        near = left[_alike(x, n, i, left, percent, most)]
        if not len(near):
            continue
        own = codes[at[i] : at[i] + n[i]]
        flag[own] = 1
        if len(near) > 16:
            common = np.add.reduceat(flag[codes], at)[near]
        else:
            common = np.array([flag[codes[at[j] : at[j] + n[j]]].sum() for j in near])
        flag[own] = 0
        hit = near[100 * common >= percent * (n[i] + n[near] - common)]
        if len(hit):
            reached = np.unique(part[hit])
            a.append(np.full(len(reached), part[i]))
            b.append(reached)
            came = np.isin(part[left], reached)
            queue.extend(left[came].tolist())
            left = left[~came]
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)
