"""Laws of the store, templates, closures, pages and tasks on small cases."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import bgp, consolidate, html, ontology, store, templates
from graphloom.plans.tasks import TaskGraph
from graphloom.sources.log import SCHEMA, append, read_log

S = "s string, p string, o string"


def log(spark, rows):
    full = [("d", seq, seq - 1, "step", None, None, op, "s", "p", o) for seq, op, o in rows]
    return spark.createDataFrame(full, SCHEMA)


def test_last_operation_wins(spark):
    df = log(spark, [(1, "added", "a"), (2, "removed", "a"), (1, "added", "b"), (3, "added", "a"), (4, "added", "c"), (4, "removed", "c")])
    held = lambda n=None: {r.o for r in store.materialize(df, n).collect()}
    assert held(1) == {"a", "b"} and held(2) == {"b"} and held(3) == {"a", "b"} and held() == {"a", "b"}
    assert [(r.o, r.change) for r in store.diff(df, 2, 4).collect()] == [("a", "added")]


def test_log_files_and_stream(spark, tmp_path):
    from graphloom.streaming.log import read_log_stream, start_state

    path = str(tmp_path / "log")
    append(log(spark, [(1, "added", "a"), (2, "removed", "a"), (2, "added", "b")]), path, by_scope=False)
    assert read_log(spark, path, "d").count() == 3 and read_log(spark, path, "e").count() == 0
    q = start_state(read_log_stream(spark, path), "live", str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert [r.o for r in spark.table("live").filter("live").collect()] == ["b"]


def test_closure_of_a_circle_ends(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 1)], "child int, parent int")
    got = {(r.descendant, r.ancestor) for r in ontology.closure(edges).collect()}
    assert got == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3)} | {(9, b) for b in (1, 2, 3)}


ROLE = templates.BUNDLED["role-realized-in-activity"]


def roles(spark):
    rows = [("r", "rdf:type", "lis:Role"), ("r", "lis:realizedIn", "act"), ("ann", "lis:hasRole", "r"), ("q", "rdf:type", "lis:Role"), ("bob", "lis:hasRole", "q")]
    return spark.createDataFrame(rows, S)


def test_templates_round_trip(spark):
    g = roles(spark)
    found = templates.recognize(ROLE, g)
    assert [(r.role, r.activity, r.player) for r in found.collect()] == [("r", "act", "ann")]
    missing = templates.partial(ROLE, g).filter("missing = 'activity'").collect()
    assert [(r.role, r.player) for r in missing] == [("q", "bob")]
    folded = templates.fold_graph([ROLE], g)
    assert folded.filter("s = 'q'").count() == 1 and folded.filter("p = 'lis:realizedIn'").count() == 0
    back = {tuple(r) for r in templates.unfold_graph([ROLE], folded).select("s", "p", "o").collect()}
    assert back == {tuple(r) for r in g.collect()}
    again = templates.fold_graph([ROLE], folded)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in folded.collect()}


def test_confirm_completes_from_answers(spark):
    key = "q|lis:Role||bob"
    answers = spark.createDataFrame([("activity", key, "act2")], "missing string, key string, value string")
    got = templates.confirm(ROLE, roles(spark), answers)
    assert ("q", "lis:realizedIn", "act2") in {tuple(r) for r in got.collect()}


def test_template_circles_and_errors():
    a = templates.Template("t:a", "a", "x", (templates.Slot("v"),), (("?v", "rdf:type", "t:b"),))
    b = templates.Template("t:b", "b", "x", (templates.Slot("w"),), (("?w", "rdf:type", "t:a"),))
    with pytest.raises(ValueError):
        a.inline({"t:a": a, "t:b": b})
    with pytest.raises(ValueError):
        templates.Template("t:c", "c", "x", (), ())


def test_repeated_variable_and_star(spark):
    t = spark.createDataFrame([("a", "p", "a"), ("a", "p", "b"), ("a", "q", "1"), ("a", "r", "2"), ("b", "q", "1")], S)
    assert bgp.scan(t, ("?x", "p", "?x")).collect() == bgp.scan(t, ("?x", "p", "a")).collect()
    star = bgp.match(t, [("?x", "q", "?y"), ("?x", "r", "?z")], ("q", "r")).collect()
    assert [tuple(r) for r in star] == [("a", "1", "2")]


def test_follow_goes_to_the_end(spark):
    hops = spark.createDataFrame([(i, i + 1) for i in range(20)], "old int, new int")
    out = consolidate.follow(spark.createDataFrame([(0, 0), (30, 30)], "cls int, target int"), hops)
    assert {tuple(r) for r in out.collect()} == {(0, 20), (30, 30)}


PAGE = '<article data-note="A"><h1 id="id-1">Hi <b>you</b></h1><p id="id-2" class="x class-7">a &amp; b</p><ol><li>one</li><li>two</li></ol></article><table><tr><td>1</td><td id="id-3">2</td></tr></table>'


def test_page_inventory_and_markdown():
    units = html.inventory(PAGE)
    assert [(u["id"], u["text"], u["css_class"], u["section"], u["tag"]) for u in units] == [
        ("id-1", "Hi you", None, "A", "h1"), ("id-2", "a &amp; b", "class-7", "A", "p"), ("id-3", "2", None, None, "td"),
    ]
    md = html.markdown(PAGE)
    assert "# Hi you {#id-1}" in md and "a & b {#id-2 .class-7}" in md and "1. one\n2. two" in md and "| 1 | 2 {#id-3} |" in md


def test_tasks_run_once_in_order_and_find_circles():
    g, seen = TaskGraph(), []
    for name, needs in (("a", ()), ("b", ("a",)), ("c", ("a",)), ("d", ("b", "c"))):
        g.task(*needs, name=name)(lambda ctx, n=name: seen.append(n))
    assert g.run("d") == ["a", "b", "c", "d"] and g.run("d", exclude=["b"]) == ["a", "c", "d"]
    g.dirty("a")(lambda ctx: False)
    assert g.run("d") == ["b", "c", "d"] and g.run("d", force=["a"])[0] == "a"
    g.task("y", name="x")(print)
    g.task("x", name="y")(print)
    with pytest.raises(ValueError):
        g.order("x")


def test_coverage_by_class_and_collapse(spark):
    m = spark.createDataFrame([("class-1", "id-1"), ("class-1", "id-2"), ("class-2", "id-3"), ("class-2", "id-4")], "cls string, id string")
    cited = spark.createDataFrame([("id-1",), ("id-2",), ("id-3",), ("id-9",)], "id string")
    assert {r.fragment for r in html.collapse(m, cited).collect()} == {"class-1", "id-3", "id-9"}
    assert html.citations(spark.createDataFrame([("e", "lis:representedBy", "d#id-1"), ("e", "lis:representedBy", '"d#x"')], S)).select(F.max("fragment")).first()[0] == "id-1"


HOLDS = templates.Template("t:Holds", "holds", "t:Box", (templates.Slot("box"), templates.Slot("note", required=False), templates.Slot("item", multi=True)),
                           (("?box", "rdf:type", "t:Box"), ("?box", "t:note", "?note"), ("?this", "t:about", "?box"), ("?anon-1", "t:of", "?item"), ("?box", "t:has", "?anon-1")))


def test_many_valued_slots(spark):
    import hashlib
    import json

    rows = spark.createDataFrame([("b", '"né \\"x\\" 🙂"', ["i", "j"]), ("c", None, ["k"])], "box string, note string, item array<string>")
    canon = json.dumps({"box": ["b"], "note": ['né "x" 🙂'], "item": ["i", "j"]}, sort_keys=True)
    base = "urn:tpl-instance/holds-" + hashlib.sha256(f"holds|{canon}".encode()).hexdigest()[:16]
    got = {tuple(r) for r in templates.expand(HOLDS, rows).collect()}
    assert {("b", "rdf:type", "t:Box"), (base, "t:about", "b"), (f"{base}-anon-1-0", "t:of", "i"), (f"{base}-anon-1-1", "t:of", "j"), ("b", "t:has", f"{base}-anon-1-1")} <= got
    empty = "urn:tpl-instance/holds-" + hashlib.sha256(("holds|" + json.dumps({"box": ["c"], "note": [], "item": ["k"]}, sort_keys=True)).encode()).hexdigest()[:16]
    lifted = {tuple(r) for r in templates.lift(HOLDS, rows).collect()}
    assert (base, "urn:tpl/holds/slot/item", "j") in lifted and (empty, "urn:tpl/holds/slot/item", "k") in lifted
    with pytest.raises(ValueError):
        templates.validate(HOLDS, rows.withColumnRenamed("note", "other"))
    broken = spark.createDataFrame([("b", []), (None, ["i"]), ("d", ["i"])], "box string, item array<string>")
    assert [r.box for r in templates.validate(HOLDS, broken, strict=False).collect()] == ["d"]


def test_confirm_goes_past_unanswered_questions(spark):
    rows = [(f"q{i:02}", "rdf:type", "lis:Role") for i in range(30)] + [(f"p{i:02}", "lis:hasRole", f"q{i:02}") for i in range(30)]
    answers = spark.createDataFrame([("activity", "q29|lis:Role||p29", "act")], "missing string, key string, value string")
    got = templates.confirm(ROLE, spark.createDataFrame(rows, S), answers, rounds=5, questions=20)
    assert ("q29", "lis:realizedIn", "act") in {tuple(r) for r in got.collect()}


def test_mentions_by_words_of_any_script(spark):
    from graphloom.operators import link

    texts = spark.createDataFrame([(1, "Les étés. A lone C here"), (2, "Use C++x or c++ now; ÉTÉ, (t)"), (None, "c"), (3, None)], "doc_id int, text string")
    labels = spark.createDataFrame([("C++", "C++"), ("t", "t"), ("été", "été"), ("plus", "++"), ("none", "")], "s string, label string")
    assert {tuple(r) for r in link.mentions(texts, labels).collect()} == {(2, "C++"), (2, "t"), (2, "été"), (2, "plus")}


def test_lines_of_triples_keep_line_ends_and_blank_nodes(spark):
    from graphloom.sources.log import from_ntriples, to_ntriples

    rows = [("_:b", "p", '"a\nb\tc \\\\n d"'), ("s", "p", '"x"^^xsd:string')]
    lines = to_ntriples(spark.createDataFrame(rows, S))
    assert all("\n" not in r.value for r in lines.collect()) and any(r.value.startswith("_:b ") for r in lines.collect())
    assert {tuple(r) for r in from_ntriples(lines).collect()} == set(rows)
    with pytest.raises(Exception, match="no triple"):
        from_ntriples(spark.createDataFrame([("<a> <b> .",)], "value string")).collect()


def test_an_iterating_task_sees_what_later_ones_did():
    g, ctx = TaskGraph(), {"work": 0}
    g.task(name="a", iterate=True)(lambda c: c.update(work=c["work"] - 1))
    g.dirty("a")(lambda c: c["work"] > 0)
    g.task("a", name="b")(lambda c: c.update(work=2))
    assert g.run("b", ctx) == ["b", "a", "a"] and ctx["work"] == 0
    with pytest.raises(ValueError):
        g.run("b", ctx, force=["nobody"])


def test_lookup_shuffles_runs_and_equal_labels_answer_once(spark):
    from graphloom.operators import link

    library = spark.createDataFrame([("x:2", "Green Tin"), ("x:1", "green tin"), ("x:3", "tin"), ("x:4", "GREEN TIN")], "uri string, label string")
    found = link.lookup(spark.createDataFrame([("een",), ("Tin",), ("none",)], "probe string"), library)
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {("een", "x:1", "green tin", 0.6), ("Tin", "x:3", "tin", 1.0)}


def test_inventory_hands_on_rows_of_a_few_pages(spark, monkeypatch):
    from graphloom.operators import html

    real = html.pd.DataFrame
    taken = {}
    pages = spark.createDataFrame([(1, "<p id=a>x</p>")], "page_id long, html string")
    monkeypatch.setattr(type(pages), "mapInPandas", lambda self, run, schema: taken.setdefault("run", run) and self, raising=False)
    html.inventory_rows(pages)
    page = "".join(f'<p id="i{n}">x</p>' for n in range(100))
    sizes = [len(f) for f in taken["run"](iter([real({"page_id": range(100), "html": [page] * 100})]))]
    assert sum(sizes) == 10_000 and max(sizes) < html.ROWS + 100
