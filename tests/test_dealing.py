"""How often rows are dealt, read and written: what grows with a table must not grow faster."""

import re

from graphloom.operators import link, nearest, templates
from graphloom.queries import ORDER, QUERIES
from graphloom.sources import mapping, template_files

SF = "/root/testdata/sf0.001"


def plan(df, which="executedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


def test_triples_of_one_subject_are_not_dealt_again(spark):
    """lines are made one by their datum, and what is expanded stays where it is."""
    assert not re.search(r"Exchange hashpartitioning\(s#\w+, p#", plan(QUERIES["template_expand"](spark, SF)))
    rows = spark.createDataFrame([("x:d", "x:u", '"1"'), ("x:d", "x:u", '"1"'), ("x:d", "x:u", '"2"')], "datum string, uom string, value string")
    found = templates.expand(templates.BUNDLED["quantity-datum-with-uomand-value"], rows)
    assert sorted(map(tuple, found.collect())) == [("x:d", "lis:datumUOM", "x:u"), ("x:d", "lis:datumValue", '"1"'), ("x:d", "lis:datumValue", '"2"'), ("x:d", "rdf:type", "lis:ScalarQuantityDatum")]


def test_parts_grow_with_the_table(spark, monkeypatch):
    """a task gets as many rows of a large table as of a small one."""
    rows = mapping.table(spark, SF, "lineitem").count()
    monkeypatch.setattr(mapping, "PART_ROWS", 50)
    for triples in (mapping.order_lines(spark, SF), mapping.quantities(spark, SF)):
        assert re.search(rf"Exchange hashpartitioning\(\w+#\w+, {-(-rows // 50)}\)", plan(triples))


def test_an_invocation_is_hashed_once(spark):
    """not for each of the triples that its slots' values make."""
    rows = spark.createDataFrame([("x:o", "x:s", ["x:a", "x:b"])], "order string, status string, part array<string>")
    above = plan(templates.lift(ORDER, rows), "optimizedPlan").split("Generate")[0]
    assert "sha2" not in above


def test_a_folded_graph_is_read_as_written(spark):
    """unfolding reads the graph for its invocations, their slots and the rest."""
    assert "lineitem" not in plan(QUERIES["template_many_round_trip"](spark, SF))


def test_rounds_see_only_files_that_still_invoke(spark, monkeypatch):
    """F2 to F6: of twenty files of which one invokes another, one is opened."""
    text = "@prefix tpl: <urn:v#> . @prefix var: <urn:tpl-var/> . @prefix x: <http://x/> . x:T{} a tpl:Template ; tpl:slot var:item ; tpl:lowered var:low . var:item tpl:range x:C . GRAPH var:low {{ var:item a x:C{} . {} }}"
    files = [(f"f{i}", text.format(i, i, "var:item x:like [ a x:T1 ; x:item var:item ] ." if i == 0 else "")) for i in range(20)]
    written, kept = [], template_files.materialized

    def counted(df):
        out = kept(df)
        if out.columns == ["path", "side", "s", "p", "o"]:
            written.append({r.path for r in out.select("path").distinct().collect()})
        return out

    monkeypatch.setattr(template_files, "materialized", counted)
    x = template_files.load(spark.createDataFrame(files, "path string, value string"), "urn:v#", {"http://x/": "x"})
    assert [len(w) for w in written] == [20, 1]
    low = x.patterns.filter("side = 'lowered'")
    assert low.select("path").distinct().count() == 20
    assert sorted((r.p, r.o) for r in low.filter("path = 'f0' and p = 'rdf:type'").collect()) == [("rdf:type", "x:C0"), ("rdf:type", "x:C1")]


def test_faults_are_found_without_opening_invocations(spark, monkeypatch):
    """all that is said of a file lies in its row; only names are dealt again."""
    written, kept = [], template_files.materialized

    def noted(df):
        written.append((df.columns, plan(df).count("Exchange hash")))
        return kept(df)

    monkeypatch.setattr(template_files, "materialized", noted)
    faults = QUERIES["template_load_faults"](spark, SF)
    assert faults.count() == 33 and len(written) == 2 and not any("p" in columns for columns, _ in written)
    assert [n for _, n in written] == [1, 1]


def test_one_side_is_opened_without_the_other(spark, monkeypatch):
    """short patterns invoke nothing here, so the full ones stay closed; those of a
    library are joined by shuffle, whatever Spark takes their size for."""
    written, kept = [], template_files.materialized

    def noted(df):
        out = kept(df)
        if out.columns == ["path", "side", "s", "p", "o"]:
            written.append({r.side for r in out.select("side").distinct().collect()})
        return out

    monkeypatch.setattr(template_files, "materialized", noted)
    found = QUERIES["template_load_lifted"](spark, SF)
    assert written == [{"lifted"}] and "BroadcastHashJoin [path" not in plan(found)
    written.clear()
    QUERIES["template_load_patterns"](spark, SF)
    assert len(written) > 1 and set().union(*written) == {"lowered"}


def test_pairs_of_a_group_are_not_written(spark):
    """a group's pairs grow with its square; its vectors meet block by block."""
    rows = [(i, [float(i % 7 + 1), float(i % 5), 1.0], "a" if i < 60 else "b" if i < 70 else None) for i in range(90)]
    v = spark.createDataFrame(rows, "id long, vec array<double>, label string")
    q, c = v.filter("id % 3 = 0").select(v.id.alias("query"), "vec", "label"), v.select(v.id.alias("candidate"), "vec", "label")
    pairs = q.select("query", "label").join(c.select("candidate", "label"), "label").select("query", "candidate")
    found = nearest.narrowed_by(q, c, ["label"])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, nearest.narrowed(pairs, q, c).collect()))
    assert found.groupBy("query").count().groupBy("count").count().orderBy("count").collect() == [(8, 20), (10, 4)]
    assert plan(QUERIES["vector_narrowed"](spark, SF)).count("FlatMapCoGroupsInPandas") > 0


def test_a_label_of_many_is_looked_for_once(spark):
    """a text meets a label, not each of those that have it."""
    labels = spark.createDataFrame([(f"x:{i}", "Hot rod") for i in range(50)] + [("x:0", "rod"), ("x:a", "ROD"), (None, "rod"), ("x:b", "")], "s string, label string")
    texts = spark.createDataFrame([(1, "a hot rod, a rod"), (1, "hot rod"), (2, "rods"), (3, "Rod"), (None, "rod")], "doc_id long, text string")
    found = link.mentions(texts, labels)
    want = {(1, f"x:{i}") for i in range(50)} | {(1, "x:a"), (1, None), (3, "x:0"), (3, "x:a"), (3, None)}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert re.search(r"Aggregate \[_k#\w+, said#\w+, pattern#\w+\]", plan(found, "optimizedPlan"))
