"""Exact deduplication of incoming texts against immutable snapshots.

Digests go ahead, and texts stay where they are. Each snapshot has static binary-fuse
filters, one for each bucket of its digests, built once. An incoming batch is grouped by
digest on its own first; its distinct digests are screened by the filters. Those that
pass meet the snapshot's exact buckets; those that don't are new without another look.
At the end the texts of rows that have copies travel, no others: each is compared byte by
byte with one text of its group, and an error says so should two texts share a digest.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, text_or_empty
from graphloom.llm.components import FEW, look_up

#: Digests of a bucket, about, on either side; bounds the memory of a task that builds or asks.
PER_BUCKET = 200_000
#: Parts into which the rows of one digest are dealt.
SALTS = 64


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) + np.uint64(seed)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(33))


class BinaryFuse:
    """Static filter: 8-bit prints, three slots a key in three neighbouring
    segments. No key of the set is ever missed; about one other in 256 passes."""

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    @staticmethod
    def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        mask = np.uint64(segment - 1)
        first = ((h >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
        second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * segment)) ^ (h & mask)
        return np.stack([first, second, third]).astype(np.int64)

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        """Peel keys that are alone in a slot, round by round, then fill the slots
        in the opposite order. A set that can't be peeled gets another seed."""
        keys = np.unique(np.asarray(keys, np.int64))
        n = max(2, len(keys))
        segment = 1 << max(2, min(18, int(math.log(n) / math.log(3.33) + 2.25)))
        wanted = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        segments = max(1, math.ceil(wanted / segment) - 2)
        size = (segments + 2) * segment
        for seed in range(1, 1000):
            h = _mix(keys, seed * 0x9E3779B9)
            slots = cls._slots(h, segment, segments)
            count = np.bincount(slots.ravel(), minlength=size)
            held = np.zeros(size, np.int64)
            ids = np.arange(len(keys))
            for row in slots:
                np.bitwise_xor.at(held, row, ids)
            rounds, left = [], len(keys)
            while left:
                alone = np.flatnonzero(count == 1)
                if not len(alone):
                    break
                peeled, at = np.unique(held[alone], return_index=True)
                rounds.append((peeled, alone[at]))
                left -= len(peeled)
                for row in slots[:, peeled]:
                    np.subtract.at(count, row, 1)
                    np.bitwise_xor.at(held, row, peeled)
            if not left:
                break
        else:
            raise RuntimeError("the filter can't be built")
        prints, own = np.zeros(size, np.uint8), cls._print(h)
        for peeled, at in reversed(rounds):
            a, b, c = slots[:, peeled]
            prints[at] = own[peeled] ^ prints[a] ^ prints[b] ^ prints[c]
        return cls(seed * 0x9E3779B9, segment, segments, prints)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(np.asarray(keys, np.int64), self.seed)
        a, b, c = self._slots(h, self.segment, self.segments)
        return (self.prints[a] ^ self.prints[b] ^ self.prints[c]) == self._print(h)

    def dump(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], "<i8").tobytes() + self.prints.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> BinaryFuse:
        seed, segment, segments = np.frombuffer(raw[:24], "<i8")
        return cls(int(seed), int(segment), int(segments), np.frombuffer(raw[24:], np.uint8))


def build_filters(digests: DataFrame, buckets: int) -> DataFrame:
    """(bucket, filter) of a snapshot's distinct digests (column ``digest``)."""

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": [key[0]], "filter": [BinaryFuse.build(part["print"].to_numpy()).dump()]})

    return _with_bucket(digests, buckets).select("bucket", "print").groupBy("bucket").applyInPandas(build, "bucket int, filter binary")


def _with_bucket(digests: DataFrame, buckets: int) -> DataFrame:
    prints = digests.withColumn("print", F.xxhash64("digest"))
    return prints.withColumn("bucket", F.pmod(F.shiftright("print", 7), F.lit(buckets)).cast("int"))


def screen(digests: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """``digests`` with ``maybe``: whether the snapshot's filter lets a digest pass.
    A bucket without a filter lets none pass."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in digests.schema.fields)

    def probe(incoming: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        maybe = BinaryFuse.load(known["filter"].iloc[0]).holds(incoming["print"].to_numpy()) if len(known) and len(incoming) else np.zeros(len(incoming), bool)
        return incoming.drop(columns=["print", "bucket"]).assign(maybe=maybe)

    return _with_bucket(digests, buckets).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, f"{fields}, maybe boolean")


def keep_snapshot(df: DataFrame, path: str, text: str = "text") -> None:
    """Write a snapshot's distinct digests and, beside them, its filters, for batches that come
    later. A snapshot never changes; further rows are another snapshot."""
    spark = df.sparkSession
    df.select(F.unhex(F.sha2(text_or_empty(text), 256)).alias("digest")).distinct().write.parquet(f"{path}/digests")
    digests = spark.read.schema("digest binary").parquet(f"{path}/digests")
    buckets = max(8, -(-digests.count() // PER_BUCKET))
    build_filters(digests, buckets).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/filters")


def known_texts(df: DataFrame, snapshots: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, text_sha256, snapshots), one for each row of ``df``: in which of the kept
    ``snapshots`` its text is. A batch's distinct digests are screened by each snapshot's
    filters as they were kept; only those that pass meet its digests. Nulls are empty texts."""
    spark = df.sparkSession
    rows = materialize(df.select(F.col(key).alias("id"), F.unhex(F.sha2(text_or_empty(text), 256)).alias("digest")), "batch")
    distinct, hits = materialize(rows.select("digest").distinct(), "distinct"), []
    for path in snapshots:
        filters = spark.read.schema("bucket int, filter binary, buckets int").parquet(f"{path}/filters")
        if size := filters.select("buckets").first():
            passed = screen(distinct, filters.drop("buckets"), size["buckets"]).filter("maybe").select("digest")
            hits.append(passed.join(spark.read.schema("digest binary").parquet(f"{path}/digests"), "digest", "left_semi").withColumn("path", F.lit(path)))
    none = F.array().cast("array<string>")
    if not hits:
        return rows.select(F.col("id").alias(key), F.lower(F.hex("digest")).alias("text_sha256"), none.alias("snapshots"))
    found = hits[0]
    for h in hits[1:]:
        found = found.unionByName(h)
    found = materialize(found.groupBy("digest").agg(F.array_sort(F.collect_list("path")).alias("paths")), "known")
    met = look_up(rows, found, "digest", "id", found.count(), "left")
    return met.select(F.col("id").alias(key), F.lower(F.hex("digest")).alias("text_sha256"), F.coalesce("paths", none).alias("snapshots"))


def group_texts(df: DataFrame, in_snapshot: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, keep_id (the largest key with that text),
    group_size, kept and text_sha256.

    ``in_snapshot`` parts the rows into the immutable snapshot (true) and the
    incoming batch; either may be empty. Null texts count as empty, and all empty texts
    are equal. A null key counts as smaller than any other. Of rows that repeat both key
    and text one alone is kept. Other columns are not read but by ``in_snapshot``. Empty
    tables give no rows.
    """
    digest = F.unhex(F.sha2(text_or_empty(text), 256))
    rows = materialize(df.select(F.col(key).alias("id"), digest.alias("digest"), F.coalesce(in_snapshot, F.lit(False)).alias("old")), "digests")
    groups = materialize(rows.groupBy("digest", "old").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")), "groups")
    snapshot, batch = groups.filter("old").drop("old"), groups.filter("not old").drop("old")
    buckets = max(8, -(-max(snapshot.count(), batch.count()) // PER_BUCKET))
    filters = materialize(build_filters(snapshot, buckets), "filters")
    screened = materialize(screen(batch, filters, buckets), "screened")
    positives = screened.filter("maybe").select("digest", F.col("n").alias("n2"), F.col("top").alias("top2"))
    met = snapshot.join(positives, "digest", "full").select(
        "digest",
        (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("group_size"),
        F.greatest("top", "top2").alias("keep_id"),
    )
    fresh = screened.filter("not maybe").select("digest", F.col("n").alias("group_size"), F.col("top").alias("keep_id"))
    whole = materialize(met.unionByName(fresh), "whole")
    _compare_texts(df.select(F.col(key).alias("id"), text_or_empty(text).alias("body"), digest.alias("digest")), whole.filter("group_size > 1").select("digest"))
    # rows that repeat key and digest travel as one; those of one digest are dealt to
    # parts, so that they don't meet in one task
    own = rows.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("times")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    dealt = own.groupBy("digest", "salt").agg(F.count(F.lit(1)).alias("_")).drop("_").join(whole, "digest")
    each = own.join(dealt, ["digest", "salt"]).withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return each.select(
        F.col("id").alias(key),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        ((F.col("time") == 1) & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _compare_texts(rows: DataFrame, shared: DataFrame) -> None:
    """Compare every text whose digest several rows have (``shared``) with one text of
    that digest; a difference is an error. The one text goes to each part of its digest's
    rows."""
    shared = materialize(shared, "shared")
    few = F.broadcast(shared) if shared.count() <= FEW else shared
    copies = rows.join(few, "digest", "left_semi").select("digest", "body", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    # equal texts of a part are one before anything is shuffled
    copies = materialize(copies.groupBy("digest", "salt", "body").agg(F.lit(1).alias("_")).drop("_"), "copies")
    one = copies.groupBy("digest").agg(F.min("salt").alias("salt")).join(copies, ["digest", "salt"]).select("digest", F.col("body").alias("other"))
    parts = copies.select("digest", "salt").distinct().join(one, "digest")
    if not copies.join(parts, ["digest", "salt"]).filter("body <> other").isEmpty():
        raise ValueError("two texts share one digest")
