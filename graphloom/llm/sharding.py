"""Rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair has a pseudo-random draw; a record lives in the shard with
the highest draw, ties going to the smaller shard. A further shard can only win
records for itself, and a shard's weight is the odds of its winning, so few
records move when shards are added, removed or reweighted. Only the key and the
shards decide; the number of rows, their order and the partitioning don't.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, text_or_empty

#: Hex digits of a key's hash that name its bin, and the parts of a bin by text: 4096
#: times 16 in a shard.
BIN_DIGITS, PARTS = 3, 16


def _text_of(key: str) -> Column:
    """A null key has a name of its own that no other key has."""
    return F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("null"))


def _draw(key: Column, shard: int, weight: float | None) -> Column:
    """With equal weights the hash itself orders the draws; with weights, a draw is
    -weight / ln(u) for u uniform in (0, 1)."""
    digest = F.md5(F.concat(key, F.lit(f":{shard}")))
    if weight is None:
        return digest
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.lit(float(weight)) / -F.log(u)


def winner(key: Column, n_shards: int, weights: Sequence[float] | None = None) -> Column:
    """The highest draw ``d`` of a key given as text, and ``s``, its shard negated."""
    if n_shards < 1 or weights is not None and (len(weights) != n_shards or min(weights) <= 0):
        raise ValueError("one positive weight for each of at least one shard is needed")
    draws = [_draw(key, s, weights[s] if weights is not None else None) for s in range(n_shards)]
    return F.array_max(F.array(*[F.struct(d.alias("d"), F.lit(-s).alias("s")) for s, d in enumerate(draws)]))


def shard_of(key: Column, n_shards: int, weights: Sequence[float] | None = None) -> Column:
    """The shard, 0 to ``n_shards`` - 1, of a key given as text."""
    return (-winner(key, n_shards, weights)["s"]).cast("int")


def assign_shards(
    df: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", weights: Sequence[float] | None = None
) -> DataFrame:
    """One row per row of ``df``: key, size, text_crc32, shard, grown_shard (with one
    more shard of the mean weight) and slot, gapless from 0 in every shard.

    size is the UTF-8 bytes of the text plus 8; null texts have none. Rows with one
    key share a shard; a null key counts as a key of its own. Rows that repeat key and
    text have slots on end. Other columns are not read. Empty tables give no rows.

    Slots need no task that sees a whole shard: keys fall into 4096 bins a shard, each
    cut into parts by the text, rows are numbered within their part, and a part starts
    where the parts before it end. Equal rows are counted before they are shuffled.
    """
    name, mean = _text_of(key), None if weights is None else sum(weights) / len(weights)
    rows = df.select(
        F.col(key).alias("_key"),
        (F.octet_length(text_or_empty(text)) + F.lit(8)).cast("long").alias("_size"),
        F.crc32(text_or_empty(text)).alias("_crc"),
        winner(name, n_shards, weights).alias("_best"),
        _draw(name, n_shards, mean).alias("_more"),
        F.substring(F.md5(name), 1, BIN_DIGITS).alias("_bin"),
    )
    shard = (-F.col("_best.s")).cast("int")
    drawn = rows.select(
        "_key", "_size", "_crc", "_bin", shard.alias("_shard"), F.pmod(F.xxhash64("_crc", "_size"), F.lit(PARTS)).cast("int").alias("_part"),
        # the further shard has to beat only the winner so far
        F.when(F.col("_more") > F.col("_best.d"), F.lit(n_shards)).otherwise(shard).alias("_grown"),
    )
    own = ["_shard", "_bin", "_part"]
    placed = materialize(drawn.groupBy(*own, "_key", "_size", "_crc", "_grown").agg(F.count(F.lit(1)).alias("_times")), "shards")
    before = Window.partitionBy("_shard").orderBy("_bin", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*own).agg(F.sum("_times").alias("n")).select(*own, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*own).orderBy("_key", "_crc", "_size").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.withColumn("_first", F.coalesce(F.sum("_times").over(inside), F.lit(0)))
    each = first.join(starts, own).withColumn("_time", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)))
    return each.select(
        F.col("_key").alias(key),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"),
        F.col("_grown").alias("grown_shard"),
        (F.col("_start") + F.col("_first") + F.col("_time")).alias("slot"),
    )
