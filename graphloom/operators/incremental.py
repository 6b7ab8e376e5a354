"""Derived tables kept up from what a step adds and removes, not made again from all.

Each function takes what was derived, the facts before, and a step's additions and removals
(facts that didn't hold, and facts that did), and gives what is derived after. Work grows with
what the step touches; the whole tables are only joined with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ontology import materialized

EDGE, PATH = ["child", "parent"], ["descendant", "ancestor"]


def _through(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths over one of ``edges``, with known ``paths`` before and behind it, or neither."""
    e = edges.select("child", "parent").distinct()
    front = e.select(F.col("child").alias("descendant"), "parent").unionByName(
        e.join(paths.select("descendant", F.col("ancestor").alias("child")), "child").select("descendant", "parent")
    )
    return materialized(
        front.select("descendant", F.col("parent").alias("ancestor"))
        .unionByName(front.join(paths.select(F.col("descendant").alias("parent"), "ancestor"), "parent").select("descendant", "ancestor"))
        .distinct()
    )


def closure_added(paths: DataFrame, added: DataFrame, most_rounds: int = 64) -> DataFrame:
    """The closure (descendant, ancestor) with further edges (child, parent): only new paths
    go on to the next round, where paths over several new edges meet."""
    paths = materialized(paths.select(PATH))
    fresh = materialized(_through(paths, added).join(paths, PATH, "left_anti"))
    for _ in range(most_rounds):
        if fresh.isEmpty():
            return paths
        paths = materialized(paths.unionByName(fresh))
        # a path that is new on either side may make further ones
        ahead = paths.select(F.col("descendant").alias("mid"), F.col("ancestor").alias("end"))
        behind = paths.select(F.col("descendant").alias("start"), F.col("ancestor").alias("mid"))
        more = fresh.withColumnRenamed("ancestor", "mid").join(ahead, "mid").select("descendant", F.col("end").alias("ancestor"))
        more = more.unionByName(fresh.withColumnRenamed("descendant", "mid").join(behind, "mid").select(F.col("start").alias("descendant"), "ancestor"))
        fresh = materialized(more.distinct().join(paths, PATH, "left_anti"))
    raise RuntimeError("the closure did not settle")


def closure_removed(paths: DataFrame, edges: DataFrame, removed: DataFrame, most_rounds: int = 64) -> DataFrame:
    """The closure without some of its edges. All paths that may rest on one of them go; those
    that the edges that stay still make are derived again, from their first edge on."""
    gone_edges = removed.select(EDGE).distinct().join(edges.select(EDGE).distinct(), EDGE, "left_semi")
    rest = materialized(edges.select(EDGE).distinct().join(gone_edges, EDGE, "left_anti"))
    doubtful = materialized(_through(paths, gone_edges).join(paths.select(PATH), PATH, "left_semi"))
    kept = materialized(paths.select(PATH).join(doubtful, PATH, "left_anti"))
    step = rest.select(F.col("child").alias("descendant"), F.col("parent").alias("mid"))
    # what an edge alone, or an edge and a path that is certain, makes
    first = rest.select(F.col("child").alias("descendant"), F.col("parent").alias("ancestor"))
    over = lambda known: doubtful.join(step, "descendant").join(known.select(F.col("descendant").alias("mid"), "ancestor"), ["mid", "ancestor"], "left_semi").select(PATH)
    fresh = materialized(doubtful.join(first, PATH, "left_semi").unionByName(over(kept)).distinct())
    for _ in range(most_rounds):
        if fresh.isEmpty():
            return kept
        kept = materialized(kept.unionByName(fresh))
        doubtful = materialized(doubtful.join(fresh, PATH, "left_anti"))
        fresh = materialized(over(fresh).distinct())
    raise RuntimeError("the closure did not settle")


def closure_after(paths: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The closure after a step on the ``edges`` before it."""
    return closure_added(closure_removed(paths, edges, removed), added)


def support_after(support: DataFrame, keys: list[str], added: DataFrame, removed: DataFrame) -> DataFrame:
    """(keys, n): how many facts stand behind each combination of ``keys``, after a step. What
    nothing stands behind any more is left out."""
    change = added.select(*keys, F.lit(1).alias("d")).unionByName(removed.select(*keys, F.lit(-1).alias("d")))
    change = change.groupBy(*keys).agg(F.sum("d").alias("d"))
    n = (F.coalesce("n", F.lit(0)) + F.coalesce("d", F.lit(0))).cast("long").alias("n")
    return support.join(change, keys, "full").select(*keys, n).filter("n > 0")


def candidates_after(defined: DataFrame, found: DataFrame, touched: DataFrame, least: int = 2) -> DataFrame:
    """(slug, docs) of ``consolidate.candidates`` after a step that touched some slugs: theirs are
    counted again from ``defined`` (doc, slug, deprecated, promoted), the others stay."""
    from graphloom.operators import consolidate

    slugs = touched.select("slug").distinct()
    again = consolidate.candidates(defined.join(slugs, "slug", "left_semi"), least)
    return found.join(slugs, "slug", "left_anti").unionByName(again)
