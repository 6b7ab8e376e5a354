"""Pages as text: odd mark-up, references, long pages, hard tables."""

import time
import zlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm.warc import as_responses, derive, plain_text

PAGES = {
    "a<script>x</script>b": "a b",
    "a<script>x": "a",
    "a<!-- b": "a",
    "a<style>b</style >c": "a c",
    "<head><title>t</title></head>a": "a",
    "<head><meta x><body>a": "a",
    "<head>a<head>b</head>c": "c",
    "<header>a</header>b": "a\nb",
    '<a title="a>b">c</a>': "c",
    "<p class='x>y'>c<br/>d": "c\nd",
    "<p class=it's>c 'd'": "c 'd'",
    "1 < 2 <3 > 1": "1 < 2 <3 > 1",
    "<p <b>c": "<p c",
    "&lt;b&gt; &amp;lt; &eacute;&#8217;&#x2019;&apos;&Eacute;": "<b> &lt; é’’'É",
    "&nosuch; & &; &#; a&b &#0;&#55296;&#99999999;&#1114112;": "&nosuch; & &; &#; a&b ��&#99999999;�",
    "a&nbsp;&#160; b&#128512;": "a b😀",
    "": "",
}


def test_text_of_odd_pages(spark):
    df = spark.createDataFrame([(k,) for k in PAGES], "html string")
    got = {r.html: r.text for r in df.select("html", plain_text(F.col("html")).alias("text")).collect()}
    assert got == PAGES


@pytest.mark.parametrize("unit, text", [
    ("<script>x ", ""), ("<!-- ", ""), ("<style>x ", ""), ("<head>x ", ""), ("<title>x ", None), ("<a ", None), ("<p ", None), ('<a "', None), ("<a =' ", None), ("<html ", None), ("&amp;", "&" * 100_000), ("</script ", None), ("\n ", ""),
])
def test_a_megabyte_takes_seconds(spark, unit, text):
    page = unit * max(100_000, 1_000_000 // len(unit)) if text and text[0] == "&" else unit * (1_000_000 // len(unit))
    page = unit * 100_000 if unit == "&amp;" else page
    began = time.time()
    rows = derive(as_responses(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"))).collect()
    assert time.time() - began < 10 and len(rows) == 2
    if text is not None:
        assert {r.block for r in rows if r.type == "conversion"} == {text}


def test_hard_and_empty_tables(spark):
    rows = [(None, None, None), (2**60 + 1, "u", ""), (2**60 + 1, "u", ""), (3, None, "<p>x" * 20_000), (3, "v", "é 🙂 &amp;")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("id", "type", "record_id", "_text", "_fields", "payload", "block", "r", "date"):
        df = df.withColumn(c, F.lit("own"))
    got = derive(as_responses(df)).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(k) for k, _, _ in rows * 2)
    assert {r.block for r in got if r.page_id == 3 and r.type == "conversion"} == {"\n".join(["x"] * 20_000), "é 🙂 &"}
    assert derive(as_responses(df.limit(0))).count() == 0


# ---- personal data in long texts


def test_selection_equals_brute_force(spark):
    import random

    from graphloom.llm.pii import ADDED, BASE, _selected

    r = random.Random(5)
    rows = []
    for i in range(120):
        spans = {"base": [], "more": []}
        for kind in (*BASE, *ADDED):
            at = 0
            while r.random() < 0.8:
                at += r.randint(0, 6)
                end = at + r.randint(1, 9)
                spans["base" if kind in BASE else "more"].append((kind, at, end, f"{kind}{at}", *([r.choice([0.25, 0.5, 0.75])] if kind in ADDED else [])))
                at = end
        rows.append((i, spans["base"], spans["more"]))
    kind = "struct<kind:string,start:int,end:int,text:string"
    df = spark.createDataFrame(rows, f"i int, base array<{kind}>>, more array<{kind},score:double>>")
    got = {x.i: [tuple(s) for s in x.s] for x in df.select("i", _selected(F.col("more"), F.col("base")).alias("s")).collect()}
    meets = lambda a, b: a[1] < b[2] and b[1] < a[2]
    rank = lambda s: (-s[4], s[1], s[0])
    for i, base, more in rows:
        free = [s for s in more if not any(meets(s, b) for b in base)]
        best = [s for s in free if not any(meets(s, o) and rank(o) < rank(s) for o in free)]
        assert got[i] == [s[:4] for s in sorted(best, key=lambda s: (ADDED.index(s[0]), s[1]))], i


def test_expressions_score_as_the_trees(spark):
    from graphloom.llm.pii import FEATURES, _Generator, fitted

    x, _, _ = _Generator(7).rows(300)
    names = [f"f{i}" for i in range(len(FEATURES))]
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], ["i", *names])
    got = {r.i: r.s for r in df.select("i", fitted().column([F.col(n) for n in names]).alias("s")).collect()}
    assert all(abs(got[i] - s) < 1e-9 for i, s in enumerate(fitted().score(x)))


def test_running_sums(spark):
    from graphloom.llm.pii import _sums

    lists = [[], [3], *[list(range(n)) for n in (2, 3, 4, 5, 16, 17, 250)]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<int>")
    for r in df.select("x", _sums(F.col("x")).alias("s")).collect():
        assert r.s == [sum(r.x[: j + 1]) for j in range(len(r.x))]


def test_twenty_thousand_spans_take_seconds(spark):
    from graphloom.llm.pii import find_pii

    text = " ".join(f'user{i}@mail.org token = "{zlib.crc32(str(i).encode()):08x}{i:032x}" 10.0.{i % 256}.1' for i in range(7000))
    df = spark.createDataFrame([(1, "a@b.c"), (2, text)], "doc_id long, text string")
    find_pii(df.filter("doc_id = 1")).collect()  # plans and compiles
    began = time.time()
    row = find_pii(df.filter("doc_id = 2")).select("base", "spans").first()
    assert time.time() - began < 20 and len(row.base) == 14_000 and len(row.spans) >= 20_000
