"""A project from empty to snapshot, and diagram codes."""

import base64
import zlib

import pytest

from graphloom.operators import emit
from graphloom.plans.project import Project
from graphloom.sources.log import read_ntriples


def files(spark, *rows):
    return spark.createDataFrame([(p, bytearray(c), "text/plain") for p, c in rows], "path string, content binary, mime string")


def test_a_project(spark, tmp_path):
    p = Project(spark, str(tmp_path))
    p.init()
    with pytest.raises(ValueError):
        p.init()
    assert p.tasks().run("snapshot") == ["snapshot"] and p.snapshot() is None
    p.add(files(spark, ("/a/One.txt", b"1"), ("/b/one.txt", b"2"), ("/c/copy.txt", b"1")))
    assert {(r.slug, r.path) for r in p.registry().collect()} == {("one", "/a/One.txt"), ("one-2", "/b/one.txt")}
    assert p.add(files(spark, ("/z/again.txt", b"2"))) == 0
    assert p.tasks().run("snapshot") == ["recognize", "snapshot"] and p.tasks().run("snapshot") == []
    p.add(files(spark, ("/d/one.txt", b"3")))
    assert sorted(r.slug for r in p.status().collect()) == ["one", "one-2", "one-3"] and p.status().first().sources == 3
    assert p.unrecognized().count() == 1 and p.recognize() > 0 and p.unrecognized().count() == 0 and p.recognize() == 0
    held = p.state().filter("scope = 'doc/one'")
    assert held.filter("s = 'x:source/one-FileHash-datum' and p = 'lis:datumValue'").count() == 1
    path = p.snapshot()
    assert read_ntriples(spark, f"{path}/scope=doc%2Fone").count() == held.count() > 20
    p.remove(["one-2"])
    assert {r.slug for r in p.registry().collect()} == {"one", "one-3"} and p.state().filter("scope = 'doc/one-2'").count() == 0
    assert p.state(1).filter("scope = 'doc/one-2'").count() > 0
    p.add(files(spark, ("/e/one.txt", b"4"), ("/e/one-9.txt", b"5"), ("/f/one.txt", b"6")))
    assert {r.slug for r in p.registry().collect()} == {"one", "one-3", "one-9", "one-10", "one-11"}
    assert p.outdated() and p.tasks().run("snapshot") == ["recognize", "snapshot"] and not p.outdated()
    steps = {(r.scope, r.seq, r.step) for r in p.history().collect()}
    assert {("project", 1, "add"), ("project", 2, "add"), ("project", 3, "remove"), ("doc/one-2", 1, "recognize"), ("doc/one-2", 2, "remove")} <= steps


def test_a_changed_hash_is_recognized_again(spark, tmp_path):
    p = Project(spark, str(tmp_path))
    p.init()
    p.add(files(spark, ("/a/x.txt", b"1")))
    p.recognize()
    old = p.state().filter("scope = 'project' and p = 'x:hash'")
    p.record("edit", old.selectExpr("scope", "s", "p", "'\"sha256:other\"' AS o"), old)
    assert p.unrecognized().count() == 1 and p.recognize() == 2 and p.unrecognized().count() == 0


def test_diagram_codes_read_back(spark):
    texts = ["", "a", "object x {\n}\n" * 500, "é→"]
    rows = emit.with_diagram_code(spark.createDataFrame([(t,) for t in [*texts, None]], "text string")).collect()
    back = str.maketrans(emit.ALPHABET, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    for r in rows[:-1]:
        assert zlib.decompressobj(-15).decompress(base64.b64decode(r.code.translate(back))).decode() == r.text
    assert rows[-1].code is None


def classes_of(spark, doc, **labels):
    rows = []
    for slug, label in labels.items():
        me = f"x:source/{doc}/{slug}"
        rows += [(f"doc/{doc}", me, "rdf:type", "owl:Class"), (f"doc/{doc}", me, "rdfs:subClassOf", "lis:Thing"), (f"doc/{doc}", me, "rdfs:label", f'"{label}"'), (f"doc/{doc}", f"x:e/{doc}-{slug}", "rdf:type", me)]
    return spark.createDataFrame(rows, "scope string, s string, p string, o string")


def test_classes_are_promoted_and_aligned_where_steps_touch_them(spark, tmp_path):
    p = Project(spark, str(tmp_path))
    p.init()
    p.record("extract", classes_of(spark, "a", Invoice="Invoice", Lone="Lone"))
    assert p.tasks().run("snapshot") == ["snapshot"]
    p.record("extract", classes_of(spark, "b", Invoice="The invoice", Other="Other"))
    assert p.tasks().run("snapshot") == ["consolidate", "align", "snapshot"]
    assert p.tasks().run("snapshot") == []
    held = {tuple(r) for r in p.state().collect()}
    assert ("project", "x:ext/Invoice", "rdfs:label", '"The invoice"') in held and ("project", "x:ext/Invoice", "skos:altLabel", '"Invoice"') in held
    for doc in "ab":
        assert (f"doc/{doc}", f"x:e/{doc}-Invoice", "rdf:type", "x:ext/Invoice") in held and (f"doc/{doc}", f"x:e/{doc}-Invoice", "rdf:type", f"x:source/{doc}/Invoice") not in held
        assert (f"doc/{doc}", f"x:source/{doc}/Invoice", "dct:isReplacedBy", "x:ext/Invoice") in held
    assert ("doc/a", "x:e/a-Lone", "rdf:type", "x:source/a/Lone") in held
    # a later source with a promoted class is aligned alone; nothing is promoted again
    p.record("extract", classes_of(spark, "c", Invoice="Invoice", Lone="Lone too"))
    assert p.promotable().collect()[0].slug == "Lone" and p.alignable().count() == 1
    assert p.tasks().run("snapshot") == ["consolidate", "align", "snapshot"] and p.tasks().run("snapshot") == []
    steps = {(r.scope, r.seq) for r in p.history().filter("step = 'align'").collect()}
    assert steps == {("doc/a", 2), ("doc/a", 3), ("doc/b", 2), ("doc/c", 2)}
