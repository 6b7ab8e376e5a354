"""Every query with SQL gives what DuckDB gives on the same tables."""

import collections
import os

import duckdb
import pytest

from graphloom.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DIR):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def norm(v):
    return repr(float(v)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rows = con.execute(SQL[name])
    names = [x[0] for x in rows.description]
    assert cols == sorted(names)
    want = collections.Counter(tuple(norm(dict(zip(names, r))[c]) for c in cols) for r in rows.fetchall())
    assert got == want


def test_rows_only_queries_run(spark, con):
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, DIR).count() > 0
