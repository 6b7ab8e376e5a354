"""Turtle and TriG."""

import pytest

from graphloom.sources.turtle import from_turtle, parse, read_turtle

HEAD = "@prefix e: <http://e/> .\nPREFIX x: <http://www.w3.org/2001/XMLSchema#>\n"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def triples(text):
    return [r[1:] for r in parse(HEAD + text)]


def test_lists_of_predicates_and_objects():
    assert triples("e:a a e:C ; e:p e:b, e:c ; . # end\ne:d.e e:p <http://e/f> .") == [
        ("http://e/a", RDF + "type", "http://e/C"), ("http://e/a", "http://e/p", "http://e/b"), ("http://e/a", "http://e/p", "http://e/c"), ("http://e/d.e", "http://e/p", "http://e/f"),
    ]


def test_literals():
    text = 'e:a e:p "q\\"\\u00e9", """two\n"lines" """@en-GB, \'1\'^^x:int, 12, -1.5, 2e3, true, "" .'
    assert [o for _, _, o in triples(text)] == [
        '"q\\"é"', '"two\n\\"lines\\" "@en-GB', f'"1"^^{XSD}int', f'"12"^^{XSD}integer', f'"-1.5"^^{XSD}decimal', f'"2e3"^^{XSD}double', f'"true"^^{XSD}boolean', '""',
    ]


def test_blank_nodes_and_collections():
    got = triples("e:a e:p [ e:q 1 ], (e:x) . [] e:r _:n . [ e:s e:t ] .")
    assert ("_:anon0", "http://e/q", f'"1"^^{XSD}integer') in got and ("_:anon1", RDF + "rest", RDF + "nil") in got
    assert ("_:anon2", "http://e/r", "_:n") in got and ("_:anon3", "http://e/s", "http://e/t") in got and len(got) == 7


def test_graphs_and_short_names():
    rows = parse(HEAD + "e:g { e:a e:p 1 . e:b e:p 2 } { e:c e:p 3 . } GRAPH e:h {} e:d e:p 4 .", short={"http://e/": "e", XSD: "xsd"})
    assert rows == [("e:g", "e:a", "e:p", '"1"^^xsd:integer'), ("e:g", "e:b", "e:p", '"2"^^xsd:integer'), ("", "e:c", "e:p", '"3"^^xsd:integer'), ("", "e:d", "e:p", '"4"^^xsd:integer')]


@pytest.mark.parametrize("bad", ["e:a e:p", "q:a e:p 1 .", "e:a e:p ^ .", "e:g { e:a e:p 1", "e:a e:p 1"])
def test_what_is_no_turtle_is_refused(bad):
    with pytest.raises(ValueError):
        parse(HEAD + bad)


def test_files(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"{n}.ttl").write_text(HEAD + f"_:b e:p {n} .")
    rows = read_turtle(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and len({r.s for r in rows}) == 2 and all(r.s.startswith("_:f") for r in rows)
    assert from_turtle(spark.createDataFrame([("x", None), ("y", "")], "path string, value string")).count() == 0


def test_many_small_files_are_dealt_and_handed_on_together(spark):
    from pyspark.sql import functions as F

    files = spark.range(400).coalesce(1).select(F.concat(F.lit("f"), "id").alias("path"), F.concat(F.lit("<urn:"), "id", F.lit("> <urn:p> 1 .")).alias("value"))
    rows = from_turtle(files)
    assert rows.count() == 400 and rows.select(F.spark_partition_id().alias("n")).distinct().count() > 1
