"""States from snapshots and the log's tail equal full replays."""

import random

from pyspark.sql import functions as F

from graphloom.operators import store
from graphloom.sources.log import SCHEMA, append, read_log
from graphloom.sources.snapshots import Snapshots


def made(spark, seed, first, last):
    r = random.Random(seed)
    rows = [(f"s{r.randrange(4)}", r.randint(first, last), 0, "step", None, None, r.choice(["added", "added", "removed"]), f"x:{r.randrange(6)}", "x:p", f'"{r.randrange(3)}"') for _ in range(120)]
    return spark.createDataFrame(rows, SCHEMA)


def same(a, b):
    return sorted(map(tuple, a.select(store.KEYS).collect())) == sorted(map(tuple, b.select(store.KEYS).collect()))


def test_states_equal_full_replays(spark, tmp_path):
    path = str(tmp_path / "log")
    kept = Snapshots(spark, str(tmp_path / "kept"), path)
    append(made(spark, 1, 1, 20), path, by_scope=False)
    assert kept.nearest() is None and same(kept.state(), store.materialize(read_log(spark, path)))
    kept.write(8)
    kept.write()
    # a scope's numbers rise, but another one begins with low numbers
    append(made(spark, 2, 21, 30).filter("scope <> 's1'"), path, by_scope=False)
    append(made(spark, 3, 5, 6).withColumn("scope", F.lit("new")), path, by_scope=False)
    for again in range(2):
        log = read_log(spark, path)
        for at in (None, 3, 8, 12, 20, 25, 30, 99):
            assert same(kept.state(at), store.materialize(log, at)), (again, at)
        kept.write(25)
        kept.write()
    for n in (8, 21):
        c = store.compact(log, n)
        assert c.columns == log.columns and all(same(store.materialize(c, at), store.materialize(log, at)) for at in (n, 22, None))


def test_only_the_tail_is_read(spark, tmp_path):
    path = str(tmp_path / "log")
    kept = Snapshots(spark, str(tmp_path / "kept"), path)
    append(made(spark, 1, 1, 20), path, by_scope=False)
    first = set(read_log(spark, path).inputFiles())
    kept.write()
    append(made(spark, 2, 21, 30), path, by_scope=False)
    assert not first & set(kept.state().inputFiles())
    kept.write(22)
    assert "GreaterThan(seq,22)" in kept.state(23)._jdf.queryExecution().executedPlan().toString()
    assert kept.nearest(19) is None and kept.nearest(20).stop is None and kept.nearest(25).stop == 22


def test_logs_by_scope_and_logs_without_steps(spark, tmp_path):
    path = str(tmp_path / "log")
    made(spark, 1, 1, 9).limit(0).write.parquet(path)
    kept = Snapshots(spark, str(tmp_path / "kept"), path)
    assert kept.write() is None and kept.nearest() is None and kept.state().count() == 0
    path = str(tmp_path / "scoped")
    kept = Snapshots(spark, str(tmp_path / "more"), path)
    append(made(spark, 1, 1, 9), path)
    kept.write()
    append(made(spark, 4, 10, 12), path)
    assert same(kept.state(), store.materialize(read_log(spark, path)))
