"""Staleness and last operations as streams equal the batch, whatever the order."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import store
from graphloom.sources.log import SCHEMA
from graphloom.streaming.log import read_log_stream
from graphloom.streaming.steps import Staleness, changes, latest, stale_steps, start

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UP = {"extract": ["convert"], "align": ["extract"], "diagram": ["align", "extract"]}


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def made(seed):
    r, rows = random.Random(seed), []
    for scope in ("a", "b", "c"):
        for seq in range(1, 13):
            step = r.choice(["convert", "extract", "align", "diagram", "other"])
            rows += [(scope, seq, seq - 1, step, None, None, r.choice(["added", "removed"]), f"x:{r.randrange(3)}", "x:p", f'"{r.randrange(2)}"') for _ in range(2)]
    return rows


def replay(spark, rows, seed, tmp_path, make, lots=4):
    """The rows in shuffled lots, some of them twice; the stream is stopped and begun again."""
    r, log, out = random.Random(seed), str(tmp_path / "log"), str(tmp_path / "out")
    rows = [*rows, *r.sample(rows, 10)]
    r.shuffle(rows)
    cut = -(-len(rows) // lots)
    for i in range(lots):
        spark.createDataFrame(rows[i * cut : (i + 1) * cut], SCHEMA).coalesce(1).write.mode("append").parquet(log)
        if i % 2:
            q = start(make(read_log_stream(spark, log, 1)), out, str(tmp_path / "checkpoint"))
            q.processAllAvailable()
            q.stop()
    return spark.read.parquet(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_staleness_equals_batch(rocks, tmp_path, seed):
    rows = made(seed)
    log = rocks.createDataFrame(rows, SCHEMA)
    got = latest(replay(rocks, rows, seed, tmp_path, lambda s: stale_steps(s, UP, cascade=False)), ["scope", "step"])
    for step, upstream in UP.items():
        want = {r.scope: r.stale for r in store.stale(log, step, upstream).collect()}
        said = {r.scope: r.stale for r in got.filter(F.col("step") == step).collect()}
        assert {s: said.get(s, False) for s in want} == want, step


def test_steps_fire_again_down_the_line(rocks, tmp_path):
    rows = [("a", n, n - 1, step, None, None, "added", "x:1", "x:p", "x:2") for n, step in enumerate(["convert", "extract", "align", "convert"], 1)]
    out = latest(replay(rocks, [*rows, *[("b", *r[1:]) for r in rows[:3]] * 4], 3, tmp_path, lambda s: stale_steps(s, UP)), ["scope", "step"])
    got = {(r.scope, r.step): (r.stale, r.seq, r.upstream) for r in out.collect()}
    assert got[("a", "align")] == (True, 3, 4) and got[("a", "extract")] == (True, 2, 4) and got[("b", "align")] == (False, 3, 2) and got[("b", "diagram")] == (True, 0, 3)
    with pytest.raises(ValueError, match="circle"):
        Staleness({"a": ["b"], "b": ["a"]})


def test_last_operations_equal_batch(rocks, tmp_path):
    rows = made(5)
    out = latest(replay(rocks, rows, 5, tmp_path, changes), store.KEYS)
    want = store.materialize(rocks.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, out.filter("live").select(store.KEYS).collect())) == sorted(map(tuple, want.collect()))
