"""The nearest vectors of many queries, in blocks: no row for a pair is ever made."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries and candidates that meet at once: a table of 1024 by 4096 similarities is 32 MB.
QUERIES, CANDIDATES = 1024, 4096
#: From so many candidates on a query is narrowed to the nearest; with fewer all stay.
NARROW_FROM = 30


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return x / (np.sqrt((x * x).sum(1, keepdims=True)) + 1e-12)


def _best(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows' ``k`` largest, ties to the smaller id: a bound first, then all that reach it."""
    k = min(k, sims.shape[1])
    bound = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
    row, col = np.nonzero(sims >= bound[:, None])
    order = np.lexsort((ids[col], -sims[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def nearest(queries: DataFrame, candidates: DataFrame, k: int, within: DataFrame | None = None, digits: int = 6, by: Sequence[str] = ()) -> DataFrame:
    """(query, rank, candidate, similarity): for each of ``queries`` (query, vec) the ``k``
    candidates (candidate, vec) of largest cosine, rounded to ``digits``, ties to the smaller key.

    ``within`` (query, candidate) restricts whom a query may meet: it is joined, so it may
    be long; without it every query is held against all, block by block. With ``by``, columns
    of both, it meets those that agree in them (nulls agree with nothing), block by block too:
    no pair is written anywhere. Null vectors take no part; all others have one length. Keys
    are distinct. A block's answers for a query are ``k`` rows at most, of which the aggregate
    keeps ``k``.
    """
    if within is not None:
        q = queries.select(F.col("query"), "vec").filter("vec is not null")
        c = candidates.select(F.col("candidate"), "vec").filter("vec is not null")
        met = within.select("query", "candidate").distinct().join(q, "query").join(c.withColumnRenamed("vec", "other"), "candidate")
        sims = met.select("query", "candidate", F.round(_cosine_of("vec", "other"), digits).alias("similarity"))
    else:
        # blocks of each group, on both sides; without ``by`` there is one group
        one = [F.lit(0).alias("group")] if not by else [F.struct(*by).alias("group")]
        whole = lambda x: x.dropna(subset=list(by)) if by else x
        q, c = (whole(x.select(key, "vec", *by)).select(key, "vec", *one).filter("vec is not null") for x, key in ((queries, "query"), (candidates, "candidate")))
        parts = lambda x, n, size: x.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(n))
        blocks = parts(q, "qn", QUERIES).join(parts(c, "cn", CANDIDATES), "group")
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        left = q.join(blocks, "group").select("group", "query", F.col("vec").alias("query_vec"), own("query", "qn").alias("qb"), all_of("cn").alias("cb"))
        right = c.join(blocks, "group").select("group", "candidate", F.col("vec").alias("candidate_vec"), own("candidate", "cn").alias("cb"), all_of("qn").alias("qb"))
        kinds = queries.schema["query"].dataType.simpleString(), candidates.schema["candidate"].dataType.simpleString()

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query": a["query"][:0], "candidate": b["candidate"][:0], "similarity": np.zeros(0)})
            sims = np.round(_unit(a["query_vec"]) @ _unit(b["candidate_vec"]).T, digits)
            row, col = _best(sims, b["candidate"].to_numpy(), k)
            return pd.DataFrame({"query": a["query"].to_numpy()[row], "candidate": b["candidate"].to_numpy()[col], "similarity": sims[row, col]})

        sims = left.groupBy("group", "qb", "cb").cogroup(right.groupBy("group", "qb", "cb")).applyInPandas(meet, f"query {kinds[0]}, candidate {kinds[1]}, similarity double")
    order = F.struct((-F.col("similarity")).alias("less"), F.col("candidate").alias("candidate"))
    # first within parts of a query's answers, so that no task holds more than k of each part
    part = sims.withColumn("part", F.pmod(F.xxhash64("candidate"), F.lit(16))).groupBy("query", "part").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("best"))
    whole = part.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return whole.select("query", F.posexplode("best").alias("at", "x")).select("query", (F.col("at") + 1).alias("rank"), "x.candidate", (-F.col("x.less")).alias("similarity"))


def _cosine_of(a: str, b: str):
    from graphloom.operators.link import cosine

    return cosine(F.col(a), F.col(b))


def narrowed(pairs: DataFrame, queries: DataFrame, candidates: DataFrame, k: int = 8, least: int = NARROW_FROM) -> DataFrame:
    """``pairs`` (query, candidate) of which queries with ``least`` candidates or more keep
    the ``k`` nearest; those with fewer keep all. A candidate without a vector isn't near."""
    many = pairs.groupBy("query").agg(F.countDistinct("candidate").alias("n"))
    few = pairs.join(many.filter(F.col("n") < least).select("query"), "query", "left_semi")
    rest = pairs.join(many.filter(F.col("n") >= least).select("query"), "query", "left_semi")
    return few.select("query", "candidate").distinct().unionByName(nearest(queries, candidates, k, within=rest).select("query", "candidate"))


def narrowed_by(queries: DataFrame, candidates: DataFrame, by: Sequence[str], k: int = 8, least: int = NARROW_FROM) -> DataFrame:
    """``narrowed`` where the pairs are all queries and candidates that agree in the columns
    ``by``: these grow with the square of a group, so only groups with fewer than ``least``
    candidates are written out pair by pair."""
    many = candidates.dropna(subset=list(by)).groupBy(*by).agg(F.countDistinct("candidate").alias("n"))
    small, large = (many.filter(F.col("n") < least).select(*by), many.filter(F.col("n") >= least).select(*by))
    few = queries.select("query", *by).join(candidates.select("candidate", *by).join(small, list(by), "left_semi"), list(by)).select("query", "candidate").distinct()
    near = nearest(queries, candidates.join(large, list(by), "left_semi"), k, by=by)
    return few.unionByName(near.select("query", "candidate"))


def matched_classes(own: DataFrame, higher: DataFrame, floor: float = 0.8, k: int = 8) -> DataFrame:
    """(slug, match, how, similarity): for classes ``own`` (slug, vec) the class of ``higher``
    (slug, vec) with the same slug, else the nearest one whose cosine is ``floor`` or more;
    classes with neither are left out. The ``k`` nearest are looked at and the best by
    similarity, then slug, taken."""
    same = own.select("slug").join(higher.select("slug"), "slug", "left_semi").distinct()
    rest = own.join(same, "slug", "left_anti").select(F.col("slug").alias("query"), "vec")
    near = nearest(rest, higher.select(F.col("slug").alias("candidate"), "vec"), k).filter((F.col("rank") == 1) & (F.col("similarity") >= floor))
    return same.select("slug", F.col("slug").alias("match"), F.lit("slug").alias("how"), F.lit(1.0).alias("similarity")).unionByName(
        near.select(F.col("query").alias("slug"), F.col("candidate").alias("match"), F.lit("vector").alias("how"), "similarity")
    )
