"""Replies, files and entities on small cases that the tables don't have."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import payload as P
from graphloom.functions import terms as T
from graphloom.operators import entities as E
from graphloom.sources import files

S = "s string, p string, o string"


def test_replies_of_any_kind(spark):
    replies = [
        ("prose", 'Sure:\n {"notes": "\\n seen \\t", "instances": [{"name": "a"}, 1, null, {"name": null}]} and so on'),
        ("fence", '\n```json\n{"notes": 5}\n```\nsee {this}'), ("open", '```\n{"notes": "x"}'), ("two", '{"notes": "x"} {"notes": "y"}'), ("listed", '{"notes": "x"}, {"notes": "y"}'),
        ("bad", '{"notes": }'), ("none", "no braces"), ("back", "} {"), ("empty", ""), ("null", None), ("kinds", '{"notes": "x", "instances": {"name": "a"}}'), ("long", '{"notes": "' + "w " * 100_000 + '"}'),
    ]
    df = spark.createDataFrame(replies, "reply_id string, reply string")
    got = {r.reply_id: r.n for r in df.select("reply_id", P.notes(F.col("reply")).alias("n")).collect()}
    assert got == {"prose": "seen", "fence": "5", "open": "x", "two": "", "listed": "", "bad": "", "none": "", "back": "", "empty": "", "null": "", "kinds": "x", "long": ("w " * 100_000).strip()}
    known = F.create_map(F.lit("q"), F.lit("u"))
    assert [tuple(r) for r in P.instances(df, known, F.lit("root")).collect()] == [("prose", "a", ["root"], [])]
    assert P.values(df, known).count() == 0 and P.invocations(df, known).count() == 0


def test_answers_flat_and_with_reasons(spark):
    df = spark.createDataFrame([('{"1": "yes", "2": {"answer": " no ", "reason": "r"}, "3": 4, "4": "", "5": {"reason": "x"}}',), ("nothing",)], "reply string")
    got = [r.a for r in df.select(P.answers(F.col("reply")).alias("a")).collect()]
    assert {k: tuple(v) for k, v in got[0].items()} == {"1": ("yes", ""), "2": ("no", "r")} and not got[1]


def test_pdfs_from_files(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF-1.4 x"), ("b.pdf", b""), ("c.pdf", b"PK"), ("d.pdf", b"%P")):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.problem, r.data) for r in files.read_pdfs(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": (None, "JVBERi0xLjQgeA=="), "c.pdf": ("not a PDF", None), "d.pdf": ("not a PDF", None)}
    empty = spark.createDataFrame([("b.pdf", bytearray())], "path string, content binary")
    assert [tuple(r) for r in files.check_pdfs(empty).collect()] == [("b.pdf", "the file is empty", None)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("## A  \n> said\n\nbody", ("A", "said", "## A  \n> said\n\nbody", [], [])),
        ("intro\n## A\nno\n## B\n> late", ("A", "", "intro\n## A\nno\n## B\n> late", [], [])),
        ("plain * text*", ("Document", "", "plain * text*", [], [])),
        ("## A\n\nx\n\n*Stamps / annotations: p | q*\n\n*Extraction issues: r*\n", ("A", "", "## A\n\nx", ["p", "q"], ["r"])),
        ("*Extraction issues: r* then more", ("Document", "", "*Extraction issues: r* then more", [], [])),
    ],
)
def test_markdown_files(spark, text, want):
    df = spark.createDataFrame([("f", text)], "path string, text string")
    assert tuple(files.load_markdown(df).select("title", "description", "markdown", "stamps", "issues").first()) == want


def test_names_of_markdown_files(spark):
    df = spark.createDataFrame([("a b/ü-1", 1, 1), ("a b/ü-1", 2, 3), ("!", 1, 2)], "title string, part int, parts int")
    assert [r[0] for r in df.select(files.markdown_name(F.lit("s"), F.col("title"), F.col("part"), F.col("parts"))).collect()] == ["s.md", "s_doc2_a_b_ü-1.md", "s_doc1_.md"]


def test_info_lines(spark):
    df = spark.createDataFrame([("A: b: c\nnone\r\nA:d\n : e\n",), (None,), ("",)], "t string")
    assert [r.m for r in df.select(files.parse_info(F.col("t")).alias("m")).collect()] == [{"A": "d", "": "e"}, {}, {}]


def test_entities_of_blank_or_opted_out_types_are_none(spark):
    onto = spark.createDataFrame([("x:Off", "x:extractable", '"False"'), ("x:B", "rdfs:subClassOf", "x:A")], S)
    up = spark.createDataFrame([("x:B", "x:A")], "descendant string, ancestor string")
    rows = [("e", "rdf:type", "x:A"), ("e", "rdf:type", "x:B"), ("off", "rdf:type", "x:Off"), ("_:b", "rdf:type", "x:A"), ("lit", "rdf:type", '"x:A"'), ("k#n", "rdf:type", "x:C"), ("e", "rdfs:label", '"z"'), ("e", "rdfs:label", '"a"')]
    got = sorted(tuple(r) for r in E.typed_entities(spark.createDataFrame(rows, S), onto, up).collect())
    assert got == [("e", "x:B", ["x:A", "x:B"], "a", []), ("k#n", "x:C", ["x:C"], "n", [])]
    assert E.typed_entities(spark.createDataFrame([], S), onto, up).count() == 0


def test_evidence_without_anchor_goes_by_its_quote(spark):
    rows = [("e", "lis:representedBy", "d#"), ("d#", "oa:hasSelector", "_:s"), ("_:s", "oa:exact", '"said"'), ("e", "lis:representedBy", "d#a#id-1"), ("e", "lis:representedBy", "lost"), ("e", "lis:representedBy", '"d#x"')]
    got = sorted((r.anchor or "", r.exact) for r in E.evidence(spark.createDataFrame(rows, S)).collect())
    assert got == [("", "said"), ("id-1", "")]


def test_roles_of_nobody_and_without_a_name(spark):
    part = spark.createDataFrame([("x:act/1", " ", "r", None), ("x:act/1", "nobody", "r", ["h"]), ("x:act/1", "Ann", None, ["h"]), (None, "Ann", "r", None)], "activity string, name string, role string, hints array<string>")
    who = spark.createDataFrame([("x:ann", "ANN"), ("x:ann2", "ann")], "s string, label string")
    got = {tuple(r) for r in E.reify_roles(part, who, "x:").collect()}
    assert got == {("x:act/1", "lis:hasParticipant", "x:ann")}


def test_qname_prefers_the_longest(spark):
    df = spark.createDataFrame([("h://a/b#c",), ("h://a/b#",), ("h://a/z",), ("h://q/r#s/t",)], "u string")
    got = [r[0] for r in df.select(T.qname(F.col("u"), [("", "h://a/"), ("l", "h://a/b#")])).collect()]
    assert got == ["l:c", "h://a/b#", "z", "t"]


def test_a_reply_is_parsed_once_for_all_its_fields(spark):
    from graphloom.entity_queries import _replies
    from graphloom.functions import payload as P

    one = spark.createDataFrame([(1, ' ```json\n{"subjects": ["A", "Z"], "confidence": 0.5}\n``` '), (2, "{"), (3, None)], "reply_id long, reply string")
    got = one.select("reply_id", P.subjects(F.col("reply"), F.create_map(F.lit("A"), F.lit("x:a"))).alias("f"))
    assert got._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
    assert [(r.f.subjects, r.f.confidence, r.f.rationale) for r in got.orderBy("reply_id").collect()] == [(["x:a"], 0.5, ""), ([], 0.0, "(parse error)"), ([], 0.0, "(parse error)")]
    assert _replies(spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("n")).distinct().count() > 1


def test_applicable_templates_deal_entities_by_name(spark):
    typed = spark.range(300).select(F.concat(F.lit("x:"), "id").alias("s"), F.lit("x:T").alias("type"))
    known = spark.createDataFrame([("a", "x:T"), ("b", "x:T"), ("a", "x:U")], "template string, subject string")
    found = E.applicable_templates(typed.unionByName(typed.withColumn("type", F.lit("x:U"))), known)
    assert found.count() == 600 and "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
