"""What is kept up step by step equals what is made from all."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import incremental as inc
from graphloom.operators.ontology import closure


def paths_of(edges):
    out = set(edges)
    while more := {(a, d) for a, b in out for c, d in edges if b == c} - out:
        out |= more
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_closures_after_every_step(spark, seed):
    r, kind = random.Random(seed), "child int, parent int"
    pairs = [(a, b) for a in range(9) for b in range(9)]  # circles and loops too
    edges = set(r.sample(pairs, 9))
    paths = closure(spark.createDataFrame(sorted(edges), kind))
    for _ in range(4):
        removed = set(r.sample(sorted(edges), min(len(edges), r.randint(0, 3))))
        added = set(r.sample([p for p in pairs if p not in edges], r.randint(0, 3)))
        frame = lambda rows: spark.createDataFrame(sorted(rows), kind)
        paths = inc.closure_after(paths, frame(edges), frame(added), frame(removed))
        edges = edges - removed | added
        got = [tuple(x) for x in paths.collect()]
        assert len(got) == len(set(got)) and set(got) == paths_of(edges)


def test_support_and_candidates(spark):
    from graphloom.operators import consolidate

    r, facts = random.Random(3), set()
    support = spark.createDataFrame([], "slug string, doc string, n long")
    found = spark.createDataFrame([], "slug string, docs long")
    for _ in range(4):
        added = {(f"s{r.randrange(5)}", f"d{r.randrange(4)}", r.randrange(3)) for _ in range(8)} - facts
        removed = set(r.sample(sorted(facts), min(3, len(facts))))
        frame = lambda rows: spark.createDataFrame(sorted(rows), "slug string, doc string, k int")  # noqa: E731, B023
        a, b = frame(added), frame(removed)
        support = inc.materialized(inc.support_after(support, ["slug", "doc"], a, b))
        facts = facts - removed | added
        defined = support.select("doc", "slug", F.lit(False).alias("deprecated"), F.lit(False).alias("promoted"))
        found = inc.materialized(inc.candidates_after(defined, found, a.select("slug").union(b.select("slug"))))
        want = {}
        for s, d, _ in facts:
            want[s, d] = want.get((s, d), 0) + 1
        assert {(x.slug, x.doc): x.n for x in support.collect()} == want
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, consolidate.candidates(defined).collect()))


def test_a_closure_writes_each_path_once(spark, monkeypatch):
    from graphloom.operators import ontology

    written, real = [], ontology.materialized

    def counted(df):
        out = real(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(ontology, "materialized", counted)
    n = ontology.closure(spark.range(2, 256).selectExpr("id as child", "id div 2 as parent")).count()
    # the paths, and walks of 2, 4 and 8 hops: less than as many again
    assert n == sum(k.bit_length() - 1 for k in range(1, 256)) and sum(written) < 2 * n
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (2, 5), (6, 6), (7, 8), (8, 9), (9, 10), (10, 11), (11, 12)]
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in want if b == c} - want:
        want |= more
    rows = ontology.closure(spark.createDataFrame(edges, "child long, parent long")).collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
