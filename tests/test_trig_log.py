"""Deltas as TriG files: round trips, files chosen by scope and step, whole batches alone."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from graphloom.sources.log import SCHEMA
from graphloom.sources.trig_log import batches, compact, from_trig, read_trig, shown_term, write_trig

AT = datetime.datetime(2024, 5, 1, 12, 30, 15, 250000)
ROWS = [
    ("doc/a b", 1, 0, "convert", "x:agent", AT, "added", "x:1", "rdf:type", "x:Thing"),
    ("doc/a b", 1, 0, "convert", "x:agent", AT, "added", "x:1", "x:says", '"a \\"q\\"\nline\\\\"@en'),
    ("doc/a b", 2, 1, "extract", None, None, "removed", "x:1", "rdf:type", "x:Thing"),
    ("doc/a b", 2, 1, "extract", None, None, "added", "urn:full#n", "http://p/odd,name", '"5"^^xsd:integer'),
    ("doc/é", 7, 6, "a \"step\"", "x:b", None, "added", "x:2", "x:p", '"5"^^http://own/type'),
    ("doc/é", 8, 7, "gone", None, None, "removed", "x:2", "x:p", '"}"'),
]
PREFIXES = {"x": "http://x/"}


@pytest.fixture
def log(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


@pytest.mark.parametrize("prefixes", [None, PREFIXES])
def test_round_trip(spark, log, tmp_path, prefixes):
    write_trig(log, str(tmp_path), prefixes)
    short = {ns: p for p, ns in (prefixes or {}).items()}
    back = read_trig(spark, str(tmp_path), short=short)
    assert same(log, back)
    assert same(log.filter("scope = 'doc/é' and seq <= 7"), read_trig(spark, str(tmp_path), scope="doc/é", up_to=7, short=short))
    assert same(log.filter("seq > 1"), read_trig(spark, str(tmp_path), after=1, short=short))
    (texts,) = [[r.value for r in spark.read.text(str(tmp_path), wholetext=True).collect()]]
    assert len(texts) == 4 and all(t.startswith("@prefix") for t in texts)
    if prefixes:
        assert any("x:1 rdf:type x:Thing ." in t for t in texts) and any('"5"^^xsd:integer' in t for t in texts)


def test_files_of_other_scopes_and_steps_are_not_opened(spark, log, tmp_path):
    write_trig(log, str(tmp_path), PREFIXES)
    for folder, _, names in os.walk(tmp_path):
        if "seq=1" not in folder:
            for n in names:
                if n.startswith("part"):
                    with open(os.path.join(folder, n), "w") as f:
                        f.write("no TriG at all {")
                    os.remove(os.path.join(folder, f".{n}.crc"))
    assert read_trig(spark, str(tmp_path), up_to=1).count() == 2
    with pytest.raises(Exception, match="seq=2"):
        read_trig(spark, str(tmp_path), scope="doc/a b").count()


def test_only_whole_batches_count(spark, log, tmp_path):
    assert read_trig(spark, str(tmp_path)).count() == 0
    first = write_trig(log.filter("seq < 7"), str(tmp_path), PREFIXES)
    second = write_trig(log.filter("seq >= 7"), str(tmp_path), PREFIXES)
    assert len(batches(spark, str(tmp_path))) == 2
    os.remove(tmp_path / f"batch={second}" / "_SUCCESS")
    assert read_trig(spark, str(tmp_path)).count() == 4
    whole = compact(spark, str(tmp_path), PREFIXES)
    assert [b.rsplit("=", 1)[1] for b in batches(spark, str(tmp_path))] == [whole] and whole != first
    assert same(log.filter("seq < 7"), read_trig(spark, str(tmp_path), short={"http://x/": "x"}))


def test_a_delta_without_additions_is_an_error(spark):
    head = "@prefix d: <urn:graphloom:delta#> . "
    empty = head + "<urn:a> a d:GraphAddition ; d:scope <urn:scope/s> ; d:seq 3 . "
    files = lambda **t: spark.createDataFrame(list(t.items()), "path string, value string")
    assert from_trig(files(fine=empty)).count() == 0
    assert from_trig(files(fine=empty + "<urn:a> { <urn:s> <urn:p> 1 }")).select("seq", "parent_seq", "step", "op").first()[:] == (3, 0, "", "added")
    for bad in ("", head + "<urn:r> a d:GraphRemoval . <urn:r> { <urn:s> <urn:p> 1 }"):
        with pytest.raises(Exception, match="bad: no graph of additions"):
            from_trig(files(fine=empty, bad=bad)).collect()


def test_a_delta_without_additions_is_an_error_where_nothing_else_is_held(spark):
    empty = "@prefix d: <urn:graphloom:delta#> . <urn:a> a d:GraphAddition ; d:scope <urn:scope/s> ; d:seq 3 . "
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the empty side is known before the other is joined
    try:
        with pytest.raises(Exception, match="bad: no graph of additions"):
            from_trig(spark.createDataFrame([("fine", empty), ("bad", "")], "path string, value string")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_terms(spark):
    said = {"x:a": "x:a", "http://x/b.c": "x:b.c", "http://x/b.": "<http://x/b.>", "http://x/": "<http://x/>", "_:b": "_:b", '"a"': '"a"', '"a\tb"@de': '"a\\tb"@de', '"1"^^x:i': '"1"^^x:i', '"1"^^y:i': '"1"^^<y:i>'}
    got = spark.createDataFrame([(k,) for k in said], "t string").select("t", shown_term(F.col("t"), PREFIXES).alias("v")).collect()
    assert {r.t: r.v for r in got} == said
