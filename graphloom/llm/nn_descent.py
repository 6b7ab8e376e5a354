"""Approximate nearest neighbours: NN-descent over Spark joins, greedy graph search.

The neighbour graph starts from buckets of random hyperplanes. Then, again and
again, every vector's neighbours and reverse neighbours meet in a local join, and
whoever is nearer than the neighbours known so far takes their place: a neighbour of
a neighbour is likely a neighbour. Only pairs of which one is new to the group meet, the
others have met before; the rounds end when few neighbours change. Queries walk the graph
greedily, a fixed number of hops: the best known nodes are expanded, the best of what
they lead to are kept. Results are scored afresh on the original vectors in double
precision.

Equal vectors are one node. Vectors travel as 8-bit integers, each with its own scale,
while the graph is built. Lists in the graph are bounded (that is the graph's degree, not a cap on the
data): reverse neighbours are one for each of a node's slots, picked by hash, so a
hub's are never gathered. Every vector is indexed and every query answered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize

#: Neighbours of a node; hyperplane tables; rounds of local joins at most; hops of a
#: query, and the nodes that it holds.
DEGREE, TABLES, ROUNDS, HOPS, BEAM = 48, 4, 3, 3, 80
#: Vectors of a hyperplane bucket, about, and at most in one local join.
BUCKET, JOIN = 128, 256
#: Candidates that a local join names for each of its members.
NAMED = 8
#: The share of neighbours that change in a round below which the rounds end.
SETTLED = 0.02
#: Nodes of a group dealt by hash, which gives each node starting neighbours.
DEALT = 32


def usable(df: DataFrame, key: str, vector: str, dims: int | None = None) -> DataFrame:
    """(id, v: array<double>) of rows that take part: not null, no null or non-finite
    component, not all zero, and of the most frequent length."""
    v = F.col(vector).cast("array<double>")
    fine = F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.filter(fine).filter(~bad & F.exists(v, lambda x: x != 0)).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    if dims is None:
        sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dims = sizes["n"] if sizes else 0
    return rows.filter(F.size("v") == dims)


def _codes(vectors: DataFrame, tables: int, bits: int, dims: int, limit: float) -> DataFrame:
    """(node, q: bytes, codes: one bucket for each table). Before its integers stands a
    vector's own scale, as a share of ``limit``, so that a large vector doesn't round
    the others to zero."""
    planes = np.random.default_rng(5).standard_normal((dims, tables * bits)).astype(np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b["v"].tolist(), np.float64).reshape(len(b), dims) / limit
            most = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
            q = np.rint(x / most * 127).astype(np.int8)
            scale = np.maximum(most[:, 0], 1e-18).astype(np.float32)
            x = (x / most).astype(np.float32)
            side = (x @ planes > 0).reshape(len(b), tables, bits)
            codes = side @ (1 << np.arange(bits, dtype=np.int64)) + (np.arange(tables, dtype=np.int64) << 40)
            yield pd.DataFrame({"node": b["node"], "q": [k.tobytes() + r.tobytes() for k, r in zip(scale, q)], "codes": list(codes)})

    return vectors.mapInPandas(run, "node long, q binary, codes array<long>")


def _decoded(blobs: list[bytes], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Scales and integers (as floats, whose products are exact) of coded vectors."""
    raw = np.frombuffer(b"".join(map(bytes, blobs)), np.uint8).reshape(len(blobs), dims + 4)
    return raw[:, :4].copy().view(np.float32)[:, 0], raw[:, 4:].view(np.int8).astype(np.float32)


def _local_join(groups: DataFrame, dims: int, named: int = NAMED) -> DataFrame:
    """(u, w, s): for each member u of each group, the nearest others w that beat u's
    worst known neighbour, one of the two being fresh. groups: array ``m`` of (node, q,
    least, fresh)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            us, ws, ss = [], [], []
            for members in b["m"]:
                n = len(members)
                if n < 2:
                    continue
                ids = np.array([r["node"] for r in members], np.int64)
                least = np.array([r["least"] for r in members], np.float32)
                scale, x = _decoded([r["q"] for r in members], dims)
                s = (x @ x.T) * (scale[:, None] * scale)
                fresh = np.array([r["fresh"] for r in members], bool)
                s[~(fresh[:, None] | fresh)] = -np.inf
                np.fill_diagonal(s, -np.inf)
                k = min(named, n - 1)
                best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                score = np.take_along_axis(s, best, axis=1)
                i, j = np.nonzero((score > least[:, None]) & np.isfinite(score))
                us.append(ids[i])
                ws.append(ids[best[i, j]])
                ss.append(score[i, j])
            if us:
                yield pd.DataFrame({"u": np.concatenate(us), "w": np.concatenate(ws), "s": np.concatenate(ss)})

    return groups.mapInPandas(run, "u long, w long, s float")


def _best(edges: DataFrame, degree: int) -> DataFrame:
    """(u, near: array of (s, w), nearest first), the ``degree`` best of each node."""
    order = Window.partitionBy("u").orderBy(F.desc("s"), "w")
    # an edge found twice has one score: equal rows share a rank
    top = edges.withColumn("r", F.dense_rank().over(order)).filter(F.col("r") <= degree)
    return top.groupBy("u").agg(F.array_sort(F.collect_set(F.struct((-F.col("s")).alias("d"), "w"))).alias("near"))


def _edges(graph: DataFrame) -> DataFrame:
    return graph.select("u", F.explode("near").alias("e")).select("u", F.col("e.w").alias("w"), (-F.col("e.d")).alias("s"))


def _adjacent(graph: DataFrame, degree: int) -> DataFrame:
    """(u, w): neighbours, and of the reverse ones one for each of ``degree`` slots."""
    out = _edges(graph).select("u", "w")
    back = out.groupBy(F.col("w").alias("u"), F.pmod(F.xxhash64("u"), F.lit(degree)).alias("slot")).agg(F.min("u").alias("w")).select("u", "w")
    return out.unionByName(back).distinct()


def _around(graph: DataFrame, degree: int) -> DataFrame:
    """(u, w, fresh): as ``_adjacent``, and each node itself; whether w is new to u's group
    by an edge that the last round brought."""
    out = graph.select("u", "fresh", F.explode("near").alias("e")).select("u", F.col("e.w").alias("w"), F.array_contains("fresh", F.col("e.w")).alias("fresh"))
    back = out.groupBy(F.col("w").alias("x"), F.pmod(F.xxhash64("u"), F.lit(degree)).alias("slot")).agg(F.min(F.struct("u", "fresh")).alias("e"))
    own = graph.select("u", F.col("u").alias("w"), F.lit(False).alias("fresh"))
    every = out.unionByName(back.select(F.col("x").alias("u"), F.col("e.u").alias("w"), F.col("e.fresh").alias("fresh"))).unionByName(own)
    return every.groupBy("u", "w").agg(F.max("fresh").alias("fresh"))


def build_graph(nodes: DataFrame, dims: int, limit: float, degree: int = DEGREE, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The neighbour graph of ``nodes`` (node, v), and the nodes' 8-bit vectors."""
    count = nodes.count()
    bits = max(1, min(30, round(math.log2(max(2, count / BUCKET)))))
    coded = materialize(_codes(nodes, TABLES, bits, dims, limit), "codes")
    spark = nodes.sparkSession
    # hyperplane buckets; one that is too large is dealt by hash. A vector may be alone in
    # all of them, so each node is in a group dealt by hash as well
    dealt_to = F.pmod(F.xxhash64("node", F.lit(DEALT)), F.lit(max(1, count // DEALT))) + F.lit(TABLES << 40)
    placed = coded.select("node", "q", F.explode(F.concat("codes", F.array(dealt_to))).alias("code"))
    parts = placed.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / JOIN).cast("int").alias("parts"))
    member = F.struct("node", "q", F.lit(-3.0e38).cast("float").alias("least"), F.lit(True).alias("fresh")).alias("m")
    dealt = placed.join(parts, "code").select("code", F.pmod(F.xxhash64("node", "code"), F.col("parts")).alias("part"), member)
    graph = materialize(_best(_local_join(dealt.groupBy("code", "part").agg(F.collect_list("m").alias("m")).select("m"), dims, 2 * NAMED), degree), "graph")
    graph = graph.withColumn("fresh", F.transform("near", lambda e: e["w"]))
    for _ in range(rounds):
        worst = graph.select(F.col("u").alias("node"), F.when(F.size("near") >= degree, -F.element_at("near", -1)["d"]).otherwise(F.lit(-3.0e38)).cast("float").alias("least"))
        known = coded.select("node", "q").join(worst, "node", "left").select(F.col("node").alias("w"), "q", F.coalesce("least", F.lit(-3.0e38).cast("float")).alias("least"))
        members = _around(graph, degree).join(known, "w").select("u", F.struct(F.col("w").alias("node"), "q", "least", "fresh").alias("m"))
        groups = members.groupBy("u").agg(F.collect_list("m").alias("m")).filter(F.exists("m", lambda m: m["fresh"])).select("m")
        best = _best(_edges(graph).unionByName(_local_join(groups, dims)), degree)
        before = graph.select("u", F.transform("near", lambda e: e["w"]).alias("old"))
        names = F.transform("near", lambda e: e["w"])
        graph = materialize(best.join(before, "u", "left").select("u", "near", F.array_except(names, F.coalesce("old", F.array().cast("array<bigint>"))).alias("fresh")), "graph")
        spark._jvm.System.gc()  # lets go of the last round's shuffle files
        changed = graph.agg(F.sum(F.size("fresh")).alias("fresh"), F.sum(F.size("near")).alias("all")).first()
        if changed["fresh"] is None or changed["fresh"] < SETTLED * changed["all"]:
            break
    return graph, coded.select("node", "q")


def search(graph: DataFrame, coded: DataFrame, starts: DataFrame, dims: int, beam: int = BEAM, hops: int = HOPS) -> DataFrame:
    """(node, found: nodes nearest first) for the query nodes ``starts`` (node).

    A query begins with its own neighbours in the graph; a hop expands all nodes of
    the beam that it has not expanded before.
    """
    own = coded.join(starts, "node", "left_semi")
    adjacent = materialize(_adjacent(graph, DEGREE).groupBy("u").agg(F.collect_list("w").alias("ws")), "adjacent")
    state = graph.join(starts.withColumnRenamed("node", "u"), "u", "left_semi").select(
        F.col("u").alias("node"), F.transform("near", lambda e: F.struct(e["w"].alias("w"), (-e["d"]).alias("s"))).alias("beam"), F.array().cast("array<bigint>").alias("done")
    )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                (scale,), (x,) = _decoded([r.q], dims)
                known = {e["w"]: e["s"] for e in r.beam}
                fresh = [m for m in r.m if m["node"] not in known and m["node"] != r.node]
                if fresh:
                    scales, y = _decoded([m["q"] for m in fresh], dims)
                    known |= dict(zip((m["node"] for m in fresh), ((y @ x) * (scales * scale)).tolist()))
                top = sorted(known.items(), key=lambda e: (-e[1], e[0]))[:beam]
                rows.append((r.node, [{"w": w, "s": s} for w, s in top]))
            yield pd.DataFrame(rows, columns=["node", "beam"])

    for _ in range(hops):
        state = materialize(state, "beams")
        front = state.select("node", F.explode(F.array_except(F.transform("beam", lambda e: e["w"]), F.col("done"))).alias("u"))
        reached = front.join(adjacent, "u").select("node", F.explode("ws").alias("w")).distinct()
        met = reached.join(coded.select(F.col("node").alias("w"), F.struct("node", "q").alias("m")), "w").groupBy("node").agg(F.collect_list("m").alias("m"))
        walked = state.select("node", "beam").join(met, "node").join(own, "node").mapInPandas(walk, "node long, beam array<struct<w:long,s:float>>")
        done = state.select("node", F.array_union("done", F.transform("beam", lambda e: e["w"])).alias("done"), F.col("beam").alias("old"))
        state = done.join(walked, "node", "left").select("node", F.coalesce("beam", "old").alias("beam"), "done")
    return state.select("node", F.transform("beam", lambda e: e["w"]).alias("found"))


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for every row of ``queries`` (a subset of
    ``df``'s rows) the ``k`` rows of ``df`` found with the largest inner product, its own
    excepted, ties to the smaller key; all rows where there are no more than ``k``.

    Vectors that are null, zero or hold null or non-finite components take no part, nor
    do those of another length than most. Rows that repeat a key count as one, the one
    with the smallest vector. Empty tables give no rows.
    """
    rows = usable(df, key, vector).groupBy("id").agg(F.min("v").alias("v"))
    rows = materialize(rows, "vectors")
    facts = rows.select(F.size("v").alias("n"), F.array_max(F.transform("v", F.abs)).alias("x")).agg(F.first("n").alias("n"), F.max("x").alias("x")).first()
    if facts["n"] is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(key), F.lit(0.0).alias("score")).limit(0)
    # equal vectors are one node; as many of its keys as a result could need
    kept = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    nodes = materialize(kept.groupBy("v").agg(F.min("id").alias("node"), F.array_sort(F.collect_list("id")).alias("ids")), "nodes")
    graph, coded = build_graph(nodes.select("node", "v"), facts["n"], max(facts["x"], 1e-300), DEGREE, ROUNDS)
    asked = rows.join(queries.select(F.col(key).cast("long").alias("id")).distinct(), "id", "left_semi")
    asked = materialize(asked.join(nodes.select("node", "v"), "v").select(F.col("id").alias("query_id"), "node", "v"), "queries")
    found = search(graph, coded, asked.select("node").distinct(), facts["n"], max(BEAM, 2 * k), HOPS)
    # all keys of the nodes found, and of the query's own
    near = asked.join(found, "node", "left").select(
        "query_id", F.col("v").alias("x"), F.explode(F.array_union(F.coalesce("found", F.array().cast("array<bigint>")), F.array("node"))).alias("node")
    )
    exact = near.join(nodes, "node").withColumn("score", _product("x", "v"))
    ranked = materialize(_ranked(exact, k, key), "ranked")
    # queries that found too few are compared with every node
    due = min(k, rows.count() - 1)
    counts = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    short = asked.join(counts, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < due).select("query_id", F.col("v").alias("x"))
    short = materialize(short, "short")
    if short.isEmpty():
        return ranked
    every = short.crossJoin(nodes).withColumn("score", _product("x", "v"))
    return ranked.join(short, "query_id", "left_anti").unionByName(_ranked(every, k, key))


def _product(x: str, v: str) -> Column:
    return F.aggregate(F.zip_with(x, v, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def _ranked(exact: DataFrame, k: int, key: str) -> DataFrame:
    each = exact.select("query_id", "score", F.explode("ids").alias("vec")).filter("vec <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("vec").alias(key), "score")
