"""Connected components as iterated joins; links stay distributed."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, materialize

#: Rows (of two numbers; 10 MB as a hash table) that are sent to all executors at most, and parts that one key is dealt to.
FEW, PARTS = 200_000, 64


def look_up(rows: DataFrame, table: DataFrame, key: str, by: str, n: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a key and ``n`` rows at
    most. A key may stand on most of ``rows``: up to ``FEW`` rows the table goes to all
    executors, a larger one meets each key's rows in parts dealt by ``by``. The columns
    of both may have any names."""
    if n <= FEW:
        return rows.join(F.broadcast(table), key, how)
    taken = {c.lower() for c in [*rows.columns, *table.columns]}
    part = next(name for k in itertools.count() if (name := f"part{k}") not in taken)
    cut = rows.withColumn(part, F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int"))
    return cut.join(cut.select(key, part).distinct().join(table, key), [key, part], how).drop(part)


def _stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` (u > v) either is a centre or has one link, to one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out + in > 1").isEmpty()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``links`` (u, v); a component is named by
    its smallest node. Loops and repeated links don't matter.

    Large-star and small-star steps in turn pull every node towards the smallest
    node it knows, until the links are stars whose centres are the components.
    """
    both = lambda e: e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    for _ in range(most_rounds):
        if _stars(edges):
            break
        n = edges.count()
        around = both(edges)
        low = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = look_up(around, low, "u", "v", 2 * n).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = look_up(down, low, "u", "v", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before, edges = edges, materialize(small.filter("u <> v").distinct(), "links")
        discard(before)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
