"""The engine's queries over the test tables, each with its SQL where SQL can say it.

Both sides see the same triples: ``GEO``, ``LOG`` and so on are the SQL of
``graphloom.sources.mapping``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog import QUERIES, SQL, query  # noqa: F401
from graphloom.functions import terms as T
from graphloom.operators import bgp, consolidate, emit, html, incremental, link, nearest, ontology, store, templates
from graphloom.sources import mapping as M
from graphloom.sources.mapping import table

GEO = """geo AS (
  SELECT 'x:customer/' || c_custkey s, 'rdf:type' p, 'x:Customer' o FROM customer UNION ALL SELECT 'x:customer/' || c_custkey, 'x:inNation', 'x:nation/' || c_nationkey FROM customer
  UNION ALL SELECT 'x:supplier/' || s_suppkey, 'rdf:type', 'x:Supplier' FROM supplier UNION ALL SELECT 'x:supplier/' || s_suppkey, 'x:inNation', 'x:nation/' || s_nationkey FROM supplier
  UNION ALL SELECT 'x:nation/' || n_nationkey, 'rdf:type', 'x:Nation' FROM nation UNION ALL SELECT 'x:nation/' || n_nationkey, 'x:inRegion', 'x:region/' || n_regionkey FROM nation
  UNION ALL SELECT 'x:nation/' || n_nationkey, 'rdfs:label', '"' || n_name || '"' FROM nation
  UNION ALL SELECT 'x:region/' || r_regionkey, 'rdf:type', 'x:Region' FROM region UNION ALL SELECT 'x:region/' || r_regionkey, 'rdfs:label', '"' || r_name || '"' FROM region)"""
LOG = """log AS (SELECT CAST(user_id AS VARCHAR) AS scope, event_id AS seq, 'step-' || (event_id % 4) AS step, CASE WHEN event_id % 3 = 0 THEN 'removed' ELSE 'added' END AS op,
  'x:user/' || user_id AS s, 'x:did' AS p, 'x:event/' || event_type AS o FROM events)"""
LINES = """lines AS (SELECT DISTINCT 'x:line/' || l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || CAST(l_quantity AS INTEGER) AS datum, '"' || CAST(l_quantity AS INTEGER) || '"^^xsd:double' AS v FROM lineitem)"""
TREE = "tree AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 1)"
#: How deep the tree of parts can be for the SQL's recursion.
UP = "up AS (SELECT child AS descendant, parent AS ancestor FROM tree UNION SELECT up.descendant, tree.parent FROM up JOIN tree ON up.ancestor = tree.child)"


def _state(n: str) -> str:
    return f"SELECT scope, s, p, o FROM (SELECT *, row_number() OVER (PARTITION BY scope, s, p, o ORDER BY seq DESC, op DESC) r FROM log WHERE seq <= {n}) WHERE r = 1 AND op = 'added'"


# --- triples and patterns ----------------------------------------------------------


@query("kg_map_triples", f"WITH {GEO} SELECT DISTINCT s, p, o FROM geo")
def kg_map_triples(spark, d):
    return M.geography(spark, d).distinct()


@query("kg_pattern_scan", f"WITH {GEO} SELECT s, o FROM geo WHERE p = 'x:inRegion'")
def kg_pattern_scan(spark, d):
    return bgp.scan(M.geography(spark, d), ("?s", "x:inRegion", "?o"))


@query(
    "bgp_customer_region",
    f"WITH {GEO} SELECT a.s AS c, b.o AS n, e.o AS r FROM geo a JOIN geo b ON a.s = b.s JOIN geo e ON b.o = e.s WHERE a.p = 'rdf:type' AND a.o = 'x:Customer' AND b.p = 'x:inNation' AND e.p = 'x:inRegion'",
)
def bgp_customer_region(spark, d):
    return bgp.match(M.geography(spark, d), [("?c", "rdf:type", "x:Customer"), ("?c", "x:inNation", "?n"), ("?n", "x:inRegion", "?r")])


@query(
    "bgp_star_lineitem",
    f"WITH {LINES} SELECT datum, 'x:piece' AS uom, v AS value FROM lines",
)
def bgp_star_lineitem(spark, d):
    patterns = [("?datum", "rdf:type", "lis:ScalarQuantityDatum"), ("?datum", "lis:datumUOM", "?uom"), ("?datum", "lis:datumValue", "?value")]
    return bgp.match(M.quantities(spark, d), patterns, single_valued=("rdf:type", "lis:datumUOM", "lis:datumValue"))


@query("bgp_cross_component", "SELECT 'x:region/' || r_regionkey AS a, 'x:nation/' || n_nationkey AS b FROM region, nation")
def bgp_cross_component(spark, d):
    return bgp.match(M.geography(spark, d), [("?a", "rdf:type", "x:Region"), ("?b", "rdf:type", "x:Nation")])


@query("kg_citations", "SELECT DISTINCT 'id-' || turn AS fragment FROM conversations WHERE turn % 2 = 0")
def kg_citations(spark, d):
    c = table(spark, d, "conversations").filter("turn % 2 = 0")
    return html.citations(M.emit(c, T.iri("x:turn/", c.conv_id, F.lit("/"), c.turn), ("lis:representedBy", T.iri("x:conv/", c.conv_id, F.lit("#id-"), c.turn))))


# --- templates ---------------------------------------------------------------------


@query("template_recognize_quantity", f"WITH {LINES} SELECT datum, 'lis:ScalarQuantityDatum' AS \"datumType\", 'x:piece' AS uom, v AS value FROM lines")
def template_recognize_quantity(spark, d):
    return templates.recognize(templates.BUNDLED["quantity-datum-with-uomand-value"], M.quantities(spark, d), ("lis:datumUOM", "lis:datumValue"))


def _roles(spark, d):
    """Orders as roles: realised in their day, held by their customer; a half of them
    also have a narrower type, and every fifth is not realised."""
    o = table(spark, d, "orders")
    role = T.iri("x:order/", o.o_orderkey)
    return M.emit(
        o, role, ("rdf:type", F.lit("lis:Role")), ("rdf:type", F.when(o.o_orderkey % 2 == 0, F.lit("x:EvenOrder"))),
        ("lis:realizedIn", F.when(o.o_orderkey % 5 != 0, T.iri("x:priority/", F.substring(o.o_orderpriority, 1, 1)))),
    ).unionByName(M.emit(o, T.iri("x:customer/", o.o_custkey), ("lis:hasRole", role)))


_ROLES = """roles AS (SELECT 'x:order/' || o_orderkey AS role, t AS "roleType", CASE WHEN o_orderkey % 5 <> 0 THEN 'x:priority/' || substr(o_orderpriority, 1, 1) END AS activity, 'x:customer/' || o_custkey AS player
  FROM orders, (VALUES ('lis:Role'), ('x:EvenOrder')) AS k(t) WHERE t = 'lis:Role' OR o_orderkey % 2 = 0)"""


@query("template_optional_multiplies", f'WITH {_ROLES} SELECT role, "roleType", activity, player FROM roles WHERE activity IS NOT NULL')
def template_optional_multiplies(spark, d):
    return templates.recognize(templates.BUNDLED["role-realized-in-activity"], _roles(spark, d))


@query("template_partial_match", f"WITH {_ROLES} SELECT role, \"roleType\", player, 'activity' AS missing FROM roles WHERE activity IS NULL")
def template_partial_match(spark, d):
    found = templates.partial(templates.BUNDLED["role-realized-in-activity"], _roles(spark, d))
    return found.filter("missing = 'activity'").select("role", "roleType", "player", "missing")


ORDER = templates.Template("x:OrderHolds", "order-holds", "x:Order", (templates.Slot("order"), templates.Slot("status"), templates.Slot("part", multi=True)),
                           (("?order", "rdf:type", "x:Order"), ("?order", "x:status", "?status"), ("?order", "x:holds", "?part")))


@query(
    "template_multislot_fold",
    """SELECT 'x:order/' || o_orderkey AS "order", '"' || o_orderstatus || '"' AS status, string_agg('x:part/' || l_partkey, '|' ORDER BY 'x:part/' || l_partkey) AS part
  FROM orders JOIN (SELECT l_orderkey, l_partkey FROM lineitem) ON o_orderkey = l_orderkey GROUP BY 1, 2""",
)
def template_multislot_fold(spark, d):
    return templates.recognize(ORDER, M.order_lines(spark, d)).withColumn("part", F.array_join("part", "|"))


@query(
    "template_expand",
    f"""WITH {LINES}, b AS (SELECT *, 'urn:x' AS u FROM lines) SELECT DISTINCT datum AS s, p, o FROM (
  SELECT datum, 'rdf:type' p, 'lis:ScalarQuantityDatum' o FROM b UNION ALL SELECT datum, 'lis:datumUOM', 'x:piece' FROM b UNION ALL SELECT datum, 'lis:datumValue', v FROM b)""",
)
def template_expand(spark, d):
    t = templates.BUNDLED["quantity-datum-with-uomand-value"]
    return templates.expand(t, templates.recognize(t, M.quantities(spark, d), ("lis:datumUOM", "lis:datumValue")))


STATUS = templates.Template("x:OrderStatus", "order-status", "x:Order", (templates.Slot("order"), templates.Slot("status")), (("?order", "rdf:type", "x:Order"), ("?order", "x:status", "?status")))


@query(
    "template_lift",
    """WITH b AS (SELECT 'urn:tpl-instance/order-status-' || substr(sha256('order-status|{"order": ["x:order/' || o_orderkey || '"], "status": ["' || o_orderstatus || '"]}'), 1, 16) AS s, * FROM orders)
  SELECT s, 'rdf:type' AS p, 'x:OrderStatus' AS o FROM b UNION ALL SELECT s, 'urn:tpl/order-status/slot/order', 'x:order/' || o_orderkey FROM b
  UNION ALL SELECT s, 'urn:tpl/order-status/slot/status', '"' || o_orderstatus || '"' FROM b""",
)
def template_lift(spark, d):
    return templates.lift(STATUS, templates.recognize(STATUS, M.order_lines(spark, d)))


@query(
    "template_fold",
    """WITH b AS (SELECT 'urn:tpl-instance/order-status-' || substr(sha256('order-status|{"order": ["x:order/' || o_orderkey || '"], "status": ["' || o_orderstatus || '"]}'), 1, 16) AS s, * FROM orders)
  SELECT s, 'rdf:type' AS p, 'x:OrderStatus' AS o FROM b UNION SELECT s, 'urn:tpl/order-status/slot/order', 'x:order/' || o_orderkey FROM b
  UNION SELECT s, 'urn:tpl/order-status/slot/status', '"' || o_orderstatus || '"' FROM b UNION SELECT 'x:order/' || l_orderkey, 'x:holds', 'x:part/' || l_partkey FROM lineitem""",
)
def template_fold(spark, d):
    return templates.fold_graph([STATUS], M.order_lines(spark, d))


_MANY = """WITH f AS (SELECT o_orderkey, o_orderstatus AS status, list(DISTINCT 'x:part/' || l_partkey ORDER BY 'x:part/' || l_partkey) AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
  b AS (SELECT 'urn:tpl-instance/order-holds-' || substr(sha256('order-holds|{"order": ["x:order/' || o_orderkey || '"], "part": ["' || array_to_string(parts, '", "') || '"], "status": ["' || status || '"]}'), 1, 16) AS s, * FROM f)"""


def _held(spark, d):
    return templates.recognize(ORDER, M.order_lines(spark, d).distinct())


@query("template_many_expand", f"""{_MANY} SELECT 'x:order/' || o_orderkey AS s, 'rdf:type' AS p, 'x:Order' AS o FROM b UNION ALL SELECT 'x:order/' || o_orderkey, 'x:status', '"' || status || '"' FROM b UNION ALL SELECT 'x:order/' || o_orderkey, 'x:holds', unnest(parts) FROM b""")
def template_many_expand(spark, d):
    return templates.expand(ORDER, templates.validate(ORDER, _held(spark, d)))


@query(
    "template_many_lift",
    f"""{_MANY} SELECT s, 'rdf:type' AS p, 'x:OrderHolds' AS o FROM b UNION ALL SELECT s, 'urn:tpl/order-holds/slot/order', 'x:order/' || o_orderkey FROM b
  UNION ALL SELECT s, 'urn:tpl/order-holds/slot/status', '"' || status || '"' FROM b UNION ALL SELECT s, 'urn:tpl/order-holds/slot/part', unnest(parts) FROM b""",
)
def template_many_lift(spark, d):
    return templates.lift(ORDER, _held(spark, d))


@query("template_many_round_trip", """SELECT 'x:order/' || o_orderkey AS s, 'rdf:type' AS p, 'x:Order' AS o FROM orders UNION SELECT 'x:order/' || o_orderkey, 'x:status', '"' || o_orderstatus || '"' FROM orders UNION SELECT 'x:order/' || l_orderkey, 'x:holds', 'x:part/' || l_partkey FROM lineitem""")
def template_many_round_trip(spark, d):
    return templates.unfold_graph([ORDER], templates.fold_graph([ORDER], M.order_lines(spark, d).distinct()))


@query("template_binding_hash", """SELECT n_nationkey, substr(sha256('nation|{"key": ["' || n_nationkey || '"], "name": ["' || n_name || '"]}'), 1, 16) AS anchor FROM nation""")
def template_binding_hash(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", T.binding_hash("nation", {"name": n.n_name, "key": n.n_nationkey.cast("string")}).alias("anchor"))


# --- the delta log and the registry ------------------------------------------------


@query("delta_materialize_head", f"WITH {LOG} {_state('9223372036854775807')}")
def delta_materialize_head(spark, d):
    return store.materialize(M.event_log(spark, d))


@query("delta_materialize_at_seq", f"WITH {LOG} {_state('2000')}")
def delta_materialize_at_seq(spark, d):
    return store.materialize(M.event_log(spark, d), 2000)


def _kept(log, n):
    """The state after step ``n`` and, of each scope, its last step until then."""
    return store.materialize(log, n), log.filter(F.col("seq") <= n).groupBy("scope").agg(F.max("seq").alias("last"))


@query("delta_resume_head", f"WITH {LOG} {_state('9223372036854775807')}")
def delta_resume_head(spark, d):
    log = M.event_log(spark, d)
    return store.resume(*_kept(log, 2000), log.filter("seq > 1000"))


@query("delta_resume_at_seq", f"WITH {LOG} {_state('700')}")
def delta_resume_at_seq(spark, d):
    log = M.event_log(spark, d)
    return store.resume(*_kept(log, 300), log, 700)


@query("delta_compact", f"WITH {LOG}, old AS ({_state('500')}) SELECT scope, s, p, o, max(seq) AS seq, true AS old FROM log JOIN old USING (scope, s, p, o) WHERE seq <= 500 AND op = 'added' GROUP BY ALL UNION ALL SELECT scope, s, p, o, seq, false FROM log WHERE seq > 500")
def delta_compact(spark, d):
    return store.compact(M.event_log(spark, d), 500).select("scope", "s", "p", "o", "seq", (F.col("seq") <= 500).alias("old"))


@query("delta_diff_added", f"WITH {LOG} ({_state('5000')}) EXCEPT ({_state('2000')})")
def delta_diff_added(spark, d):
    return store.diff(M.event_log(spark, d), 2000, 5000).filter("change = 'added'").drop("change")


@query("delta_diff_removed", f"WITH {LOG} ({_state('2000')}) EXCEPT ({_state('5000')})")
def delta_diff_removed(spark, d):
    return store.diff(M.event_log(spark, d), 2000, 5000).filter("change = 'removed'").drop("change")


@query("delta_history", f"WITH {LOG} SELECT scope, seq, step, count(*) FILTER (op = 'added') AS added, count(*) FILTER (op = 'removed') AS removed FROM log GROUP BY 1, 2, 3")
def delta_history(spark, d):
    return store.history(M.event_log(spark, d))


@query("delta_next_seq", f"WITH {LOG} SELECT scope, max(seq) + 1 AS next_seq FROM log GROUP BY 1")
def delta_next_seq(spark, d):
    return store.next_seq(M.event_log(spark, d))


@query("delta_latest_step", f"WITH {LOG} SELECT scope, step, max(seq) AS seq FROM log GROUP BY 1, 2")
def delta_latest_step(spark, d):
    return store.latest_of_step(M.event_log(spark, d))


@query(
    "delta_stale",
    f"WITH {LOG} SELECT scope, coalesce(max(seq) FILTER (step IN ('step-0', 'step-1')) > coalesce(max(seq) FILTER (step = 'step-2'), 0), false) AS stale FROM log GROUP BY 1",
)
def delta_stale(spark, d):
    return store.stale(M.event_log(spark, d), "step-2", ["step-0", "step-1"])


@query("delta_scopes", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS scope FROM events")
def delta_scopes(spark, d):
    from graphloom.sources.log import scopes

    return scopes(M.event_log(spark, d))


@query("delta_scope_uri", "SELECT DISTINCT 'urn:graph/doc/' || user_id AS uri, 'doc' AS kind, CAST(user_id AS VARCHAR) AS name FROM events")
def delta_scope_uri(spark, d):
    uri = T.scope_uri(F.lit("doc"), F.col("user_id").cast("string"))
    return table(spark, d, "events").select(uri.alias("uri")).distinct().withColumn("x", T.scope_of(F.col("uri"))).select("uri", "x.kind", "x.name")


@query("delta_broken_chains", f"WITH {LOG}, x AS (SELECT DISTINCT scope, seq FROM log), y AS (SELECT scope, seq, 0 AS parent_seq, coalesce(lag(seq) OVER (PARTITION BY scope ORDER BY seq), 0) AS before FROM x) SELECT scope, seq, CAST(parent_seq AS BIGINT) AS parent_seq, before FROM y WHERE before <> 0")
def delta_broken_chains(spark, d):
    return store.broken_chains(M.event_log(spark, d))


@query("delta_step_from_states", f"WITH {LOG}, a AS ({_state('1000')}), b AS ({_state('3000')}) SELECT 'added' AS op, s, p, o FROM (SELECT s, p, o FROM b EXCEPT SELECT s, p, o FROM a) UNION ALL SELECT 'removed', s, p, o FROM (SELECT s, p, o FROM a EXCEPT SELECT s, p, o FROM b)")
def delta_step_from_states(spark, d):
    from graphloom.sources.log import step_delta

    log = M.event_log(spark, d)
    return step_delta(store.materialize(log, 1000), store.materialize(log, 3000), "all", 1, "step").select("op", "s", "p", "o")


@query("ntriples_round_trip", f"WITH {GEO} SELECT DISTINCT s, p, o FROM geo")
def ntriples_round_trip(spark, d):
    from graphloom.sources.log import from_ntriples, to_ntriples

    return from_ntriples(to_ntriples(M.geography(spark, d))).distinct()


@query("registry_pivot", "SELECT 'x:doc/' || doc_id AS s, lang AS lang, source AS source, CAST(n_chars AS VARCHAR) AS size FROM documents")
def registry_pivot(spark, d):
    docs = table(spark, d, "documents")
    records = M.emit(docs, T.iri("x:doc/", docs.doc_id), ("lang", docs.lang), ("source", docs.source), ("size", docs.n_chars.cast("string")))
    return store.pivot(records, {"lang": "lang", "source": "source", "size": "size"})


@query("registry_dedup_hash", "SELECT 'sha256:' || sha256(text) AS hash, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1")
def registry_dedup_hash(spark, d):
    return table(spark, d, "documents").groupBy(F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("hash")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))


@query(
    "registry_unique_slug",
    """WITH x AS (SELECT p_partkey, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part), y AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) n FROM x)
  SELECT p_partkey, slug, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS unique_slug FROM y""",
)
def registry_unique_slug(spark, d):
    return consolidate.unique_slugs(table(spark, d, "part").select("p_partkey", T.slug(F.col("p_brand")).alias("slug")), "slug", "p_partkey")


@query(
    "registry_resolve",
    "SELECT s_suppkey AS probe, CASE WHEN s_suppkey % 3 = 2 AND s_suppkey > 50 THEN NULL ELSE s_name END AS slug FROM supplier",
)
def registry_resolve(spark, d):
    s = table(spark, d, "supplier")
    registry = s.select(F.col("s_name").alias("slug"), T.iri("p", s.s_suppkey).alias("path"), T.iri("h", s.s_suppkey).alias("hash"))
    pick = lambda i, c: F.when(F.col("s_suppkey") % 3 == i, c)
    known = pick(2, F.when(F.col("s_suppkey") <= 50, F.col("s_name")).otherwise("nobody"))
    return store.resolve(s.select(F.col("s_suppkey").alias("probe"), pick(0, T.iri("p", s.s_suppkey)).alias("path"), pick(1, T.iri("h", s.s_suppkey)).alias("hash"), known.alias("slug")).withColumnRenamed("slug", "slug"), registry)


# --- ontology ----------------------------------------------------------------------


@query("onto_closure", f"WITH RECURSIVE {TREE}, {UP} SELECT descendant, ancestor FROM up")
def onto_closure(spark, d):
    return ontology.closure(M.part_tree(spark, d))


@query(
    "onto_closure_step",
    """WITH RECURSIVE tree AS (SELECT p_partkey AS child, CASE WHEN p_partkey % 97 = 0 THEN p_partkey // 3 ELSE p_partkey // 2 END AS parent FROM part WHERE p_partkey > 1),
  up AS (SELECT child AS descendant, parent AS ancestor FROM tree UNION SELECT up.descendant, tree.parent FROM up JOIN tree ON up.ancestor = tree.child) SELECT descendant, ancestor FROM up""",
)
def onto_closure_step(spark, d):
    """The closure after a step that gives some parts another parent, from the one before."""
    edges, moved = M.part_tree(spark, d), F.col("child") % 97 == 0
    gone = edges.filter(moved)
    return incremental.closure_after(ontology.closure(edges), edges, gone.withColumn("parent", F.floor(F.col("child") / 3).cast("long")), gone)


@query("onto_descendants", f"WITH RECURSIVE {TREE}, {UP} SELECT descendant FROM up WHERE ancestor = 7")
def onto_descendants(spark, d):
    return ontology.closure(M.part_tree(spark, d)).filter("ancestor = 7").select("descendant")


def _onto(spark, d):
    """Nations under regions as classes; a property for each nation, with or without a
    domain, range and inverse by its number; every seventh nation opted out."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    cls, prop = T.iri("x:nation/", n.n_nationkey), T.iri("x:prop/", n.n_nationkey)
    k = n.n_nationkey
    return (
        M.emit(n, cls, ("rdf:type", F.lit("owl:Class")), ("rdfs:subClassOf", T.iri("x:region/", n.n_regionkey)), ("rdfs:label", T.literal(n.n_name)), ("x:extractable", F.when(k % 7 == 0, T.literal(F.lit("false")))))
        .unionByName(M.emit(r, T.iri("x:region/", r.r_regionkey), ("rdf:type", F.lit("owl:Class")), ("owl:disjointWith", F.when(r.r_regionkey == 0, F.lit("x:region/1")))))
        .unionByName(M.emit(
            n, prop, ("rdf:type", F.lit("owl:ObjectProperty")), ("rdfs:domain", F.when(k % 3 == 0, T.iri("x:region/", n.n_regionkey))),
            ("rdfs:range", F.when(k % 4 == 0, T.iri("x:region/", n.n_regionkey)).when(k % 4 == 1, F.lit("xsd:string"))), ("owl:inverseOf", F.when(k % 6 == 1, T.iri("x:prop/", k + 1))),
        ))
    )


_PROPS = """props AS (SELECT 'x:prop/' || n_nationkey AS property, n_nationkey k, CASE WHEN n_nationkey % 3 = 0 THEN 'x:region/' || n_regionkey END AS domain,
  CASE WHEN n_nationkey % 4 = 0 THEN 'x:region/' || n_regionkey WHEN n_nationkey % 4 = 1 THEN 'xsd:string' END AS range FROM nation),
  inv AS (SELECT 'x:prop/' || n_nationkey AS a, 'x:prop/' || (n_nationkey + 1) AS b FROM nation WHERE n_nationkey % 6 = 1), both_inv AS (SELECT a, b FROM inv UNION SELECT b, a FROM inv)"""


@query("onto_roots", "SELECT 'x:region/' || r_regionkey AS cls FROM region")
def onto_roots(spark, d):
    return ontology.roots(_onto(spark, d))


@query("onto_domainless", f"WITH {_PROPS} SELECT property FROM props WHERE domain IS NULL")
def onto_domainless(spark, d):
    return ontology.domainless(_onto(spark, d))


@query("onto_optout", "SELECT 'x:nation/' || n_nationkey AS term FROM nation WHERE n_nationkey % 7 <> 0")
def onto_optout(spark, d):
    o = _onto(spark, d)
    return ontology.extractable(ontology.classes(o).filter(F.col("cls").startswith("x:nation")).withColumnRenamed("cls", "term"), o)


@query("onto_class_ranged", f"WITH {_PROPS} SELECT property FROM props WHERE range LIKE 'x:%'")
def onto_class_ranged(spark, d):
    return ontology.class_ranged(_onto(spark, d))


@query("onto_annotations", "SELECT 'x:nation/' || n_nationkey AS cls, n_name AS label, '' AS definition FROM nation")
def onto_annotations(spark, d):
    return ontology.annotations(_onto(spark, d)).filter(F.col("cls").startswith("x:nation"))


@query("onto_disjoint", """WITH z AS (SELECT n_regionkey r, 'x:nation/' || n_nationkey c FROM nation WHERE n_regionkey IN (0, 1) UNION ALL SELECT r_regionkey, 'x:region/' || r_regionkey FROM region WHERE r_regionkey IN (0, 1))
  SELECT x.c AS a, y.c AS b FROM z x, z y WHERE x.r <> y.r""")
def onto_disjoint(spark, d):
    o = _onto(spark, d)
    return ontology.disjoint(o, ontology.hierarchy(o))


def _uses(spark, d):
    """Each property beside the nations of the customers whose keys fall to it."""
    c = table(spark, d, "customer")
    return c.select(T.iri("x:prop/", F.col("c_custkey") % 25).alias("property"), T.iri("x:nation/", F.col("c_nationkey")).alias("type")).distinct()


_SAT = """WITH {props}, u AS (SELECT DISTINCT property, domain, range, 'x:nation/' || n_nationkey AS type, 'x:region/' || n_regionkey AS above FROM customer JOIN props ON k = c_custkey % 25 JOIN nation ON n_nationkey = c_nationkey)
  SELECT property, type, ({c} IS NULL OR {c} = type OR {c} = above) AS ok FROM u"""


@query("onto_domain_ok", _SAT.format(props=_PROPS, c="domain"))
def onto_domain_ok(spark, d):
    o = _onto(spark, d)
    return ontology.satisfied(_uses(spark, d), o, ontology.hierarchy(o), "rdfs:domain")


@query("onto_range_ok", _SAT.format(props=_PROPS, c="range"))
def onto_range_ok(spark, d):
    o = _onto(spark, d)
    return ontology.satisfied(_uses(spark, d), o, ontology.hierarchy(o), "rdfs:range")


@query(
    "onto_inverse_fallback",
    f"""WITH {_PROPS} SELECT property, domain AS cls FROM props WHERE domain IS NOT NULL UNION SELECT i.a, p.range FROM (SELECT a, min(b) b FROM both_inv GROUP BY a) i JOIN props p ON p.property = i.b
  WHERE p.range IS NOT NULL AND i.a NOT IN (SELECT property FROM props WHERE domain IS NOT NULL)""",
)
def onto_inverse_fallback(spark, d):
    return ontology.declared(_onto(spark, d), "rdfs:domain")


@query(
    "onto_property_select",
    f"""WITH {_PROPS}, t AS (SELECT 'x:nation/' || n_nationkey AS type, 'x:region/' || n_regionkey AS up FROM nation), e AS (SELECT type, property FROM t, props WHERE domain IS NULL OR domain = up OR domain = type)
  SELECT type, property FROM e WHERE NOT EXISTS (SELECT 1 FROM both_inv i JOIN e f ON f.property = i.b WHERE i.a = e.property AND f.type = e.type AND i.b < i.a)""",
)
def onto_property_select(spark, d):
    o = _onto(spark, d)
    types = ontology.classes(o).filter(F.col("cls").startswith("x:nation")).withColumnRenamed("cls", "type")
    return ontology.select_properties(types, o, ontology.hierarchy(o), ontology.hierarchy(o, "rdfs:subPropertyOf"))


@query("onto_most_specific", "SELECT 'x:thing/' || n_nationkey AS s, 'x:nation/' || n_nationkey AS type FROM nation")
def onto_most_specific(spark, d):
    n = table(spark, d, "nation")
    typed = n.select(T.iri("x:thing/", n.n_nationkey).alias("s"), F.explode(F.array(T.iri("x:nation/", n.n_nationkey), T.iri("x:region/", n.n_regionkey))).alias("type"))
    return ontology.most_specific(typed, ontology.hierarchy(_onto(spark, d)))


@query("onto_in_scope", "SELECT 'x:thing/' || n_nationkey AS s, 'x:nation/' || n_nationkey AS type FROM nation WHERE n_regionkey = 2")
def onto_in_scope(spark, d):
    n, o = table(spark, d, "nation"), _onto(spark, d)
    covers = table(spark, d, "region").filter("r_regionkey = 2").select(T.iri("x:region/", F.col("r_regionkey")).alias("cls"))
    return ontology.in_scope(n.select(T.iri("x:thing/", n.n_nationkey).alias("s"), T.iri("x:nation/", n.n_nationkey).alias("type")), covers, ontology.hierarchy(o))


@query(
    "shacl_counts",
    """WITH d AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), c AS (SELECT o_orderkey, count(l_partkey) n FROM orders LEFT JOIN d ON l_orderkey = o_orderkey GROUP BY 1)
  SELECT 'x:order/' || o_orderkey AS s, 'x:holds' AS path, n FROM c WHERE n < 1 OR n > 5""",
)
def shacl_counts(spark, d):
    return ontology.violations(M.order_lines(spark, d).distinct(), "x:Order", [("x:holds", 1, 5), ("x:status", 1, 1)])


# --- classes across scopes ---------------------------------------------------------


def _defined(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("lang").alias("doc"), T.class_slug(F.concat("source", F.lit(" "), (F.col("doc_id") % 50).cast("string"))).alias("slug"), (F.col("doc_id") % 11 == 0).alias("deprecated"), (F.col("doc_id") % 13 == 0).alias("promoted"))


@query("classes_threshold", "SELECT source || (doc_id % 50) AS slug, count(DISTINCT lang) AS docs FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0 GROUP BY 1 HAVING count(DISTINCT lang) >= 2")
def classes_threshold(spark, d):
    return consolidate.candidates(_defined(spark, d))


def _merged(spark, d):
    p = table(spark, d, "part")
    return consolidate.merge(p.select(T.class_slug(p.p_brand).alias("slug"), T.iri("lis:", F.lit("Object")).alias("anchor"), p.p_type.alias("label"), F.array(p.p_name).alias("alt_labels"), F.concat(p.p_name, F.lit(" "), p.p_type).alias("comment")))


_MERGED = """x AS (SELECT regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS slug, p_type AS label, p_name AS alt, p_name || ' ' || p_type AS comment FROM part),
  m AS (SELECT slug, arg_min(label, (-length(label), label)) AS label, arg_min(comment, (-length(comment), comment)) AS comment FROM x GROUP BY 1),
  a AS (SELECT slug, label AS w FROM x UNION SELECT slug, alt FROM x)"""


@query(
    "classes_merge",
    f"WITH {_MERGED} SELECT m.slug, 'lis:Object' AS anchor, m.label, string_agg(a.w, '|' ORDER BY a.w) AS alt_labels, m.comment FROM m JOIN a ON a.slug = m.slug AND a.w <> m.label GROUP BY m.slug, m.label, m.comment",
)
def classes_merge(spark, d):
    return _merged(spark, d).withColumn("alt_labels", F.array_join("alt_labels", "|"))


@query(
    "classes_promote",
    f"""WITH {_MERGED} SELECT 'x:ext/' || slug AS s, 'rdf:type' AS p, 'owl:Class' AS o FROM m UNION ALL SELECT 'x:ext/' || slug, 'rdfs:subClassOf', 'lis:Object' FROM m UNION ALL SELECT 'x:ext/' || slug, 'rdfs:label', '"' || label || '"' FROM m
  UNION ALL SELECT 'x:ext/' || slug, 'rdfs:comment', '"' || comment || '"' FROM m UNION ALL SELECT 'x:ext/' || slug, 'x:provenance', '"promoted"' FROM m UNION ALL SELECT 'x:ext/' || m.slug, 'skos:altLabel', '"' || w || '"' FROM m JOIN a ON a.slug = m.slug AND w <> label""",
)
def classes_promote(spark, d):
    return consolidate.definitions(_merged(spark, d), "x:ext/")


def _mapping(spark, d):
    n = table(spark, d, "nation")
    return n.filter("n_nationkey % 2 = 0").select(T.iri("x:nation/", n.n_nationkey).alias("old"), T.iri("x:region/", n.n_regionkey).alias("new"))


def _typed(spark, d):
    c = table(spark, d, "customer")
    return M.emit(c, T.iri("x:customer/", c.c_custkey), ("rdf:type", T.iri("x:nation/", c.c_nationkey)), ("x:segment", T.literal(c.c_mktsegment)))


@query(
    "classes_retype",
    """WITH m AS (SELECT 'x:nation/' || n_nationkey AS old, 'x:region/' || n_regionkey AS new FROM nation WHERE n_nationkey % 2 = 0), t AS (SELECT 'x:customer/' || c_custkey AS s, 'x:nation/' || c_nationkey AS o FROM customer)
  SELECT 'removed' AS op, s, 'rdf:type' AS p, o FROM t JOIN m ON o = old UNION ALL SELECT 'added', s, 'rdf:type', new FROM t JOIN m ON o = old
  UNION ALL SELECT 'added', old, 'owl:deprecated', '"true"^^xsd:boolean' FROM m UNION ALL SELECT 'added', old, 'dct:isReplacedBy', new FROM m""",
)
def classes_retype(spark, d):
    return consolidate.retype(_typed(spark, d), _mapping(spark, d))


@query(
    "classes_retype_applied",
    """SELECT 'x:customer/' || c_custkey AS s, 'rdf:type' AS p, CASE WHEN c_nationkey % 2 = 0 THEN 'x:region/' || n_regionkey ELSE 'x:nation/' || c_nationkey END AS o FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION SELECT 'x:customer/' || c_custkey, 'x:segment', '"' || c_mktsegment || '"' FROM customer UNION SELECT 'x:nation/' || n_nationkey, 'owl:deprecated', '"true"^^xsd:boolean' FROM nation WHERE n_nationkey % 2 = 0
  UNION SELECT 'x:nation/' || n_nationkey, 'dct:isReplacedBy', 'x:region/' || n_regionkey FROM nation WHERE n_nationkey % 2 = 0""",
)
def classes_retype_applied(spark, d):
    t = _typed(spark, d)
    return consolidate.apply_changes(t, consolidate.retype(t, _mapping(spark, d)))


@query(
    "classes_align",
    """WITH h AS (SELECT 'x:ext/' || p_brand AS cls, p_brand AS slug, 1 AS pr, p_size > 40 AS dep FROM part UNION ALL SELECT 'x:up/' || p_brand, p_brand, 2, false FROM part)
  SELECT 'x:doc/' || p_partkey AS cls, t AS target FROM part JOIN (SELECT slug, arg_min(cls, (pr, cls)) t FROM h WHERE NOT dep GROUP BY 1) ON slug = p_brand""",
)
def classes_align(spark, d):
    p = table(spark, d, "part")
    higher = p.select(F.concat(F.lit("x:ext/"), "p_brand").alias("cls"), F.col("p_brand").alias("slug"), F.lit(1).alias("priority"), (F.col("p_size") > 40).alias("deprecated")).unionByName(
        p.select(F.concat(F.lit("x:up/"), "p_brand").alias("cls"), F.col("p_brand").alias("slug"), F.lit(2).alias("priority"), F.lit(False).alias("deprecated"))
    )
    return consolidate.align(p.select(T.iri("x:doc/", p.p_partkey).alias("cls"), p.p_brand.alias("slug")), higher)


@query(
    "classes_follow",
    "WITH RECURSIVE t(cls, target) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT cls, target // 2 FROM t WHERE target % 2 = 0) SELECT cls, min(target) AS target FROM t GROUP BY 1",
)
def classes_follow(spark, d):
    p = table(spark, d, "part")
    replaced = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("old"), F.expr("p_partkey div 2").alias("new"))
    return consolidate.follow(p.select(F.col("p_partkey").alias("cls"), F.col("p_partkey").alias("target")), replaced)


@query("classes_unresolved", "SELECT DISTINCT 'x:nation/' || c_nationkey AS cls FROM customer WHERE c_nationkey % 2 = 1")
def classes_unresolved(spark, d):
    return consolidate.unresolved(_typed(spark, d), _mapping(spark, d).select(F.col("old").alias("cls")))


@query("pattern_index", "SELECT 'x:did' AS signature, count(*) AS n, count(DISTINCT user_id) AS scopes FROM (SELECT DISTINCT user_id FROM events) HAVING count(*) >= 3")
def pattern_index(spark, d):
    return consolidate.signatures(M.event_log(spark, d))


@query("first_wins", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def first_wins(spark, d):
    return consolidate.first_wins(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


# --- pages -------------------------------------------------------------------------


@query("html_tags", r"SELECT page_id, lower(unnest(regexp_extract_all(html, '<\s*([a-zA-Z][a-zA-Z0-9]*)[^>]*>', 1))) AS tag FROM pages")
def html_tags(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(html.open_tags(F.col("html"))).alias("tag"))


@query("html_links", """SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref="([^"]*)"', 1)) AS href FROM pages""")
def html_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(html.links(F.col("html"))).alias("href"))


@query(
    "html_title",
    r"SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), ''), nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), '')) AS title FROM pages",
)
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", T.page_title(F.col("html")).alias("title"))


def _seeded(spark, d):
    """Pages whose paragraphs have ids and whose articles have notes and classes."""
    h = F.replace(F.replace(F.col("html"), F.lit("<p>"), F.lit('<p id="id-1" class="x class-2">')), F.lit("<article>"), F.lit('<article data-note="main">'))
    return table(spark, d, "pages").select("page_id", h.alias("html"))


@query("html_inventory")
def html_inventory(spark, d):
    return html.inventory_rows(_seeded(spark, d))


@query("html_markdown")
def html_markdown(spark, d):
    return html.markdown_view(table(spark, d, "pages"))


@query("html_annotate")
def html_annotate(spark, d):
    p = _seeded(spark, d)
    es = p.select("page_id", F.lit("id-1").alias("id"), T.iri("x:e/", F.col("page_id")).alias("uri"), F.lit('A "B"').alias("label"), F.lit("x:T").alias("types"))
    return html.annotate(p, es)


def _units(spark, d):
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id"), T.iri("id-", F.col("turn")).alias("id"), F.col("role").alias("section"), F.when(F.col("turn") % 3 == 0, F.lit("class-3")).alias("css_class"), F.col("turn"))


def _cited(spark, d):
    c = table(spark, d, "conversations")
    return c.filter("turn % 2 = 0").select("conv_id", T.iri("id-", F.col("turn")).alias("fragment")).unionByName(c.filter("conv_id % 5 = 0").select("conv_id", F.lit("class-3").alias("fragment")).distinct())


_COV = "cov AS (SELECT conv_id, 'id-' || turn AS id, role AS section, CASE WHEN turn % 3 = 0 THEN 'class-3' END AS css_class, turn, (turn % 2 = 0 OR (turn % 3 = 0 AND conv_id % 5 = 0)) AS covered FROM conversations)"


@query("coverage_units", f"WITH {_COV} SELECT conv_id, css_class, id, section, turn, covered FROM cov")
def coverage_units(spark, d):
    return html.coverage(_units(spark, d), _cited(spark, d), ["conv_id"])


@query("coverage_total", f"WITH {_COV} SELECT conv_id, count(*) AS total, count(*) FILTER (covered) AS covered, round(100.0 * count(*) FILTER (covered) / count(*), 4) AS percent FROM cov GROUP BY 1")
def coverage_total(spark, d):
    return html.coverage_totals(coverage_units(spark, d), ["conv_id"])


@query("coverage_by_section", f"WITH {_COV} SELECT section, count(*) AS total, count(*) FILTER (covered) AS covered, round(100.0 * count(*) FILTER (covered) / count(*), 4) AS percent FROM cov GROUP BY 1")
def coverage_by_section(spark, d):
    return html.coverage_totals(coverage_units(spark, d), ["section"])


@query("coverage_citation_kinds", f"WITH {_COV} SELECT count(DISTINCT (conv_id, id)) FILTER (turn % 2 = 0) AS ids, count(DISTINCT conv_id) FILTER (conv_id % 5 = 0) AS classes FROM cov")
def coverage_citation_kinds(spark, d):
    kind = lambda k: F.count(F.when(F.col("fragment").startswith(k), 1))
    return _cited(spark, d).distinct().agg(kind("id-").alias("ids"), kind("class-").alias("classes"))


@query(
    "coverage_collapse",
    """WITH c AS (SELECT DISTINCT conv_id, turn, (turn % 2 = 0 OR conv_id % 4 = 0) AS hit FROM conversations), w AS (SELECT conv_id, bool_and(hit) AS whole FROM c GROUP BY 1)
  SELECT DISTINCT CASE WHEN whole THEN 'class-' || conv_id ELSE 'id-' || conv_id || '-' || turn END AS fragment FROM c JOIN w USING (conv_id) WHERE hit""",
)
def coverage_collapse(spark, d):
    c = table(spark, d, "conversations")
    rows = c.select(T.iri("class-", F.col("conv_id")).alias("cls"), T.iri("id-", F.col("conv_id"), F.lit("-"), F.col("turn")).alias("id"), ((F.col("turn") % 2 == 0) | (F.col("conv_id") % 4 == 0)).alias("hit"))
    return html.collapse(rows, rows.filter("hit").select("id"))


@query(
    "entity_index",
    "SELECT 'id-' || n_nationkey AS fragment, 'x:nation/' || n_nationkey AS s, n_name AS label, 'x:Nation x:Place' AS types FROM nation",
)
def entity_index(spark, d):
    n = table(spark, d, "nation")
    s = T.iri("x:nation/", n.n_nationkey)
    return html.entity_index(M.emit(n, s, ("rdf:type", F.lit("x:Place")), ("rdf:type", F.lit("x:Nation")), ("rdfs:label", T.literal(n.n_name)), ("lis:representedBy", T.iri("x:page#id-", n.n_nationkey))))


# --- linking -----------------------------------------------------------------------


def _labels(spark, d):
    n = table(spark, d, "nation")
    return n.select(T.iri("x:nation/", n.n_nationkey).alias("s"), n.n_name.alias("label"))


@query("link_exact", "SELECT s_suppkey, n_name AS value, 'x:nation/' || n_nationkey AS entity FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def link_exact(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return link.by_label(s.select("s_suppkey", F.col("n_name").alias("value")), _labels(spark, d))


@query("link_casefold", "SELECT s_suppkey, lower(n_name) AS value, 'x:nation/' || n_nationkey AS entity FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def link_casefold(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return link.by_label(s.select("s_suppkey", F.lower("n_name").alias("value")), _labels(spark, d), fold_case=True)


_WORDS = ["the", "License", "is the", "trash", "version 3", "et les", "C++"]


def _spoken(spark, d):
    """Labels: some words, the names of all parts, and the opening of each benchmark item."""
    given = spark.createDataFrame([(f"x:{w.lower()}", w) for w in _WORDS], "s string, label string")
    p, b = table(spark, d, "part"), table(spark, d, "benchmark")
    opening = F.array_join(F.slice(F.split("text", " "), 1, 6), " ")
    return given.unionByName(p.select(T.iri("x:part/", p.p_partkey).alias("s"), p.p_name.alias("label"))).unionByName(b.select(T.iri("x:item/", b.item_id).alias("s"), opening.alias("label")))


@query(
    "link_cooccurrence",
    r"""WITH b AS (SELECT doc_id, lower(text) AS body FROM documents WHERE text IS NOT NULL), l AS (SELECT 'x:' || lower(w) AS s, lower(w) AS w FROM (SELECT unnest(['the', 'License', 'is the', 'trash', 'version 3', 'et les', 'C++']) AS w)
  UNION ALL SELECT 'x:part/' || p_partkey, lower(p_name) FROM part UNION ALL SELECT 'x:item/' || item_id, lower(array_to_string(string_split(text, ' ')[1:6], ' ')) FROM benchmark),
  k AS (SELECT s, w, CASE WHEN regexp_matches(w, '^[\p{L}\p{N}_]') THEN '(^|[^\p{L}\p{N}_])' ELSE '[\p{L}\p{N}_]' END || regexp_escape(w) || CASE WHEN regexp_matches(w, '[\p{L}\p{N}_]$') THEN '([^\p{L}\p{N}_]|$)' ELSE '[\p{L}\p{N}_]' END AS pattern FROM l WHERE w <> ''),
  m AS (SELECT doc_id, s, body, pattern FROM b, k WHERE contains(body, w)) SELECT DISTINCT doc_id, s FROM m WHERE regexp_matches(body, pattern)""",
)
def link_cooccurrence(spark, d):
    return link.mentions(table(spark, d, "documents"), _spoken(spark, d))


@query(
    "link_infer",
    """WITH e AS (SELECT s_suppkey, n_nationkey AS a, (s_suppkey * 7 + 3) % 25 AS b FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 5 <> 0)
  SELECT 'x:supplier/' || s_suppkey AS s, 'x:tradesWith' AS property, 'x:nation/' || least(a, b) AS other FROM e""",
)
def link_infer(spark, d):
    """Suppliers whose evidence names two nations, and a supplier, which doesn't fit."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    far = n.select((F.col("n_nationkey")).alias("far"), F.lower("n_name").alias("far_name"))
    both = s.join(n, n.n_nationkey == s.s_nationkey).withColumn("far", (F.col("s_suppkey") * 7 + 3) % 25).join(far, "far")
    said = F.concat(F.lit("From "), "n_name", F.lit(", by "), "s_name", F.lit(" to ("), "far_name", F.lit(")."))
    none = F.lit(None).cast("string")
    ents = both.select(T.iri("x:supplier/", F.col("s_suppkey")).alias("s"), F.lit("x:Supplier").alias("type"), F.col("s_name").alias("label"), said.alias("evidence"), (F.col("s_suppkey") + 1000).cast("long").alias("pos")).unionByName(
        n.select(T.iri("x:nation/", n.n_nationkey).alias("s"), F.lit("x:Nation").alias("type"), n.n_name.alias("label"), none.alias("evidence"), n.n_nationkey.cast("long").alias("pos"))
    )
    one = lambda a, b, t: spark.createDataFrame([(a, b)], t)
    taken = s.filter("s_suppkey % 5 = 0").select(T.iri("x:supplier/", F.col("s_suppkey")).alias("s"), F.lit("x:tradesWith").alias("property"))
    return link.infer_links(ents, one("x:Supplier", "x:tradesWith", "type string, property string"), taken, one("x:tradesWith", "x:Nation", "property string, other_type string"))


@query(
    "lookup_exact_fuzzy",
    """WITH q AS (SELECT DISTINCT upper(p_name) AS probe FROM part UNION SELECT DISTINCT substr(p_name, 2, 6) FROM part), r AS (SELECT 'x:part/' || p_partkey AS uri, p_name AS label FROM part),
  e AS (SELECT probe, arg_min(label, (uri, label)) AS label, min(uri) AS uri FROM q JOIN r ON lower(probe) = lower(label) GROUP BY 1), t AS (SELECT DISTINCT probe, lower(trim(regexp_replace(probe, '\\s+', ' ', 'g'))) AS p FROM q WHERE probe NOT IN (SELECT probe FROM e)),
  f AS (SELECT probe, arg_min(label, (uri, label)) AS label, min(uri) AS uri FROM t JOIN r ON contains(lower(label), p) WHERE p <> '' GROUP BY 1)
  SELECT probe, uri, label, CAST(1.0 AS DOUBLE) AS confidence FROM e UNION ALL SELECT probe, uri, label, CAST(0.6 AS DOUBLE) FROM f""",
)
def lookup_exact_fuzzy(spark, d):
    p = table(spark, d, "part")
    probes = p.select(F.upper("p_name").alias("probe")).unionByName(p.select(F.substring("p_name", 2, 6).alias("probe")))
    return link.lookup(probes, p.select(T.iri("x:part/", p.p_partkey).alias("uri"), p.p_name.alias("label")))


@query("vector_topk", "WITH q AS (SELECT embedding e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS similarity FROM embeddings, q ORDER BY 2 DESC, 1 LIMIT 8")
def vector_topk(spark, d):
    v = table(spark, d, "embeddings")
    return link.top_cosine(v, v.filter("vec_id = 0").first()["embedding"])


_SIMILAR = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"


@query("vector_topk_within", "WITH q AS (SELECT embedding e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS similarity FROM embeddings, q WHERE label = 1 ORDER BY 2 DESC, 1 LIMIT 5")
def vector_topk_within(spark, d):
    v = table(spark, d, "embeddings")
    return link.top_cosine(v, v.filter("vec_id = 0").first()["embedding"], 5, v.filter("label = 1"))


@query(
    "vector_nearest",
    f"""WITH p AS (SELECT a.vec_id AS query, b.vec_id AS candidate, {_SIMILAR} AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 10 = 3)
  SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, candidate) AS INTEGER) AS rank, candidate, similarity FROM p QUALIFY rank <= 8""",
)
def vector_nearest(spark, d):
    """A tenth of the vectors as queries against all."""
    v = table(spark, d, "embeddings")
    return nearest.nearest(v.filter("vec_id % 10 = 3").select(v.vec_id.alias("query"), v.embedding.alias("vec")), v.select(v.vec_id.alias("candidate"), v.embedding.alias("vec")), 8)


@query(
    "vector_narrowed",
    f"""WITH p AS (SELECT a.vec_id AS query, b.vec_id AS candidate, {_SIMILAR} AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND (a.label % 2 = 0 OR b.vec_id % 50 = 0) WHERE a.vec_id % 10 = 3),
  n AS (SELECT *, count(*) OVER (PARTITION BY query) AS n, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, candidate) AS r FROM p) SELECT query, candidate FROM n WHERE n < 30 OR r <= 8""",
)
def vector_narrowed(spark, d):
    """Candidates of a query's label: all for even labels, few for odd ones."""
    v = table(spark, d, "embeddings")
    q, c = v.filter("vec_id % 10 = 3").select(v.vec_id.alias("query"), v.embedding.alias("vec"), "label"), v.select(v.vec_id.alias("candidate"), v.embedding.alias("vec"), "label")
    return nearest.narrowed_by(q, c.filter("label % 2 = 0 or candidate % 50 = 0"), ["label"])


@query(
    "classes_matched",
    f"""WITH own AS (SELECT vec_id, embedding, 'c' || CASE WHEN vec_id % 4 = 0 THEN vec_id + 1 ELSE vec_id END AS slug FROM embeddings WHERE vec_id % 2 = 0), higher AS (SELECT vec_id, embedding, 'c' || vec_id AS slug FROM embeddings WHERE vec_id % 2 = 1),
  s AS (SELECT DISTINCT slug FROM own WHERE slug IN (SELECT slug FROM higher)), p AS (SELECT a.slug, b.slug AS match, {_SIMILAR} AS similarity FROM own a, higher b WHERE a.slug NOT IN (SELECT slug FROM s)),
  n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY similarity DESC, match) AS r FROM p) SELECT slug, slug AS match, 'slug' AS how, 1.0::DOUBLE AS similarity FROM s UNION ALL SELECT slug, match, 'vector', similarity FROM n WHERE r = 1 AND similarity >= 0.3""",
)
def classes_matched(spark, d):
    """Classes of even vectors, every second under a slug that the odd ones have."""
    v = table(spark, d, "embeddings")
    slug = F.concat(F.lit("c"), F.when((v.vec_id % 4 == 0), v.vec_id + 1).otherwise(v.vec_id).cast("string"))
    own, higher = (v.filter(f"vec_id % 2 = {i}").select(slug.alias("slug"), v.embedding.alias("vec")) for i in (0, 1))
    return nearest.matched_classes(own, higher, floor=0.3)


@query("vector_upsert", "SELECT vec_id, label + 100 AS label FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id % 2 = 1")
def vector_upsert(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label")
    return link.upsert(v, v.filter("vec_id % 2 = 0").withColumn("label", F.col("label") + 100), "vec_id")


@query(
    "link_guard",
    """SELECT n_name AS name, property, value, 'x:nation/' || n_nationkey AS s, o, verdict FROM (SELECT n.*, 'x:in' AS property, r_name AS value, 'x:region/' || r_regionkey AS o, 'ok' AS verdict FROM nation n JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT n.*, 'x:in', 'nowhere', NULL, 'literal for object' FROM nation n UNION ALL SELECT n.*, 'x:in', n_name, 'x:nation/' || n_nationkey, 'range' FROM nation n UNION ALL SELECT n.*, 'x:other', 'y', NULL, 'domain' FROM nation n)""",
)
def link_guard(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    labels = _labels(spark, d).withColumn("type", F.lit("x:Nation")).unionByName(r.select(T.iri("x:region/", r.r_regionkey).alias("s"), r.r_name.alias("label"), F.lit("x:Region").alias("type")))
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    said = lambda p, v: F.struct(F.lit(p).alias("property"), v.alias("value"))
    rows = j.select(F.col("n_name").alias("name"), F.inline(F.array(said("x:in", F.col("r_name")), said("x:in", F.lit("nowhere")), said("x:in", F.col("n_name")), said("x:other", F.lit("y")))))
    one = lambda p, t: spark.createDataFrame([(p, t)], "property string, type string")
    return link.guard(rows, labels, one("x:in", "x:Nation"), one("x:in", "x:Region"), one("x:in", "").select("property"))


@query("link_refine", "SELECT 'x:e/' || p_partkey AS s, 'x:brand/' || p_brand AS type FROM part WHERE p_partkey % 2 = 0")
def link_refine(spark, d):
    p = table(spark, d, "part")
    ents = p.select(T.iri("x:e/", p.p_partkey).alias("s"), F.lit("@@none@@").alias("label"), F.array(F.upper("p_brand"), F.upper("p_brand")).alias("hints"))
    library = p.select(F.concat(F.lit("x:brand/"), "p_brand").alias("uri"), F.col("p_brand").alias("label")).distinct()
    has = p.filter("p_partkey % 2 = 1").select(T.iri("x:e/", p.p_partkey).alias("s"), F.concat(F.lit("x:brand/"), "p_brand").alias("type"))
    return link.refine(ents, library, has)


# --- sorts, scalars, emitters ------------------------------------------------------


@query("sort_diff_head50", f"WITH {LOG}, x AS (({_state('5000')}) EXCEPT ({_state('2000')})) SELECT s, p, o FROM x ORDER BY s, p, o LIMIT 50")
def sort_diff_head50(spark, d):
    return delta_diff_added(spark, d).select("s", "p", "o").orderBy("s", "p", "o").limit(50)


@query("shortlist_top20", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def shortlist_top20(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_custkey").limit(20)


@query(
    "scalar_slugs",
    r"""WITH x AS (SELECT p_partkey, p_name || ' / ' || p_type AS t FROM part), y AS (SELECT *, trim(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '-') AS b FROM x)
  SELECT p_partkey, b AS slug, substr(b, 1, 64) AS entity_slug, substr(b, 1, 48) AS page_slug, regexp_replace(t, '[^A-Za-z0-9]', '', 'g') AS class_slug FROM y""",
)
def scalar_slugs(spark, d):
    t = F.concat("p_name", F.lit(" / "), "p_type")
    return table(spark, d, "part").select("p_partkey", T.slug(t).alias("slug"), T.entity_slug(t).alias("entity_slug"), T.page_slug(t).alias("page_slug"), T.class_slug(t).alias("class_slug"))


@query(
    "scalar_camel",
    r"SELECT p_partkey, array_to_string(list_transform(list_filter(regexp_split_to_array(p_name || '-' || p_type, '[\s_\-./]+'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), '') AS camel FROM part",
)
def scalar_camel(spark, d):
    return table(spark, d, "part").select("p_partkey", T.camel_case(F.concat("p_name", F.lit("-"), "p_type")).alias("camel"))


@query(
    "scalar_localname",
    "SELECT page_id, regexp_extract(url || '#a/' || page_id, '([^#]*)$', 1) AS after_hash, CASE WHEN contains(url, '#') THEN regexp_extract(url, '([^#]*)$', 1) ELSE regexp_extract(url, '([^/]*)$', 1) END AS after_slash, CAST(page_id AS VARCHAR) AS after_both, 'a/' || page_id AS fragment FROM pages",
)
def scalar_localname(spark, d):
    u = F.concat("url", F.lit("#a/"), F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", T.local_name(u).alias("after_hash"), T.local_name(F.col("url")).alias("after_slash"), T.local_name_both(u).alias("after_both"), T.fragment(u).alias("fragment"))


@query("scalar_curie", "SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN 's:' || substr(url, 9) WHEN starts_with(url, 'http://') THEN 'p:' || substr(url, 8) ELSE '<' || url || '>' END AS curie FROM pages")
def scalar_curie(spark, d):
    return table(spark, d, "pages").select("page_id", T.compact(F.col("url"), [("s", "https://"), ("p", "http://")]).alias("curie"))


@query("scalar_escape", """SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM pages""")
def scalar_escape(spark, d):
    return table(spark, d, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"))


@query(
    "scalar_inline",
    r"""SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '\s+', ' ', 'g') AS inline FROM pages""",
)
def scalar_inline(spark, d):
    return table(spark, d, "pages").select("page_id", T.inline_text(F.col("html")).alias("inline"))


@query(
    "literal_coerce",
    """WITH x AS (SELECT event_id, CAST(user_id AS VARCHAR) AS a, event_type AS b FROM events) SELECT event_id, '"' || a || '"^^xsd:integer' AS number, '"' || b || '"' AS word, '"' || a || '"^^xsd:double' AS real FROM x""",
)
def literal_coerce(spark, d):
    a = F.col("user_id").cast("string")
    return table(spark, d, "events").select("event_id", T.coerce(a, F.lit("xsd:integer")).alias("number"), T.coerce(F.col("event_type"), F.lit("xsd:integer")).alias("word"), T.coerce(a, F.lit("xsd:double")).alias("real"))


@query("json_tolerant", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_tolerant(spark, d):
    fenced = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))
    return table(spark, d, "events").select("event_id", F.from_json(T.json_object(fenced), "k long")["k"].alias("k"))


@query("emit_entities", """SELECT 'x:nation/' || n_nationkey AS s, 'rdf:type' AS p, 'x:Nation' AS o FROM nation UNION ALL SELECT 'x:nation/' || n_nationkey, 'rdfs:label', '"' || n_name || '"' FROM nation UNION ALL SELECT 'x:nation/' || n_nationkey, 'lis:representedBy', 'x:doc#id-' || n_regionkey FROM nation""")
def emit_entities(spark, d):
    n = table(spark, d, "nation")
    return emit.entities(n.select(T.iri("x:nation/", n.n_nationkey).alias("uri"), n.n_name.alias("label"), F.array(F.lit("x:Nation")).alias("types"), F.array(T.iri("x:doc#id-", n.n_regionkey)).alias("fragments")))


@query("emit_recognized_files", """WITH f AS (SELECT 'x:doc/' || doc_id AS u, * FROM documents), v AS (SELECT u, k.name, k.value FROM f, LATERAL (VALUES ('FilePath', '/d/' || doc_id), ('FileHash', sha256(text)), ('MimeType', 'text/plain')) k(name, value)),
  q AS (SELECT u, name FROM v UNION ALL SELECT u, 'FileSize' FROM f)
  SELECT u AS s, 'rdf:type' AS p, 'x:File' AS o FROM f UNION ALL SELECT u, 'rdfs:label', '"' || source || '"' FROM f UNION ALL SELECT u, 'x:createdBy', '"' || lang || '"' FROM f
  UNION ALL SELECT u, 'lis:hasQuality', u || '-' || name FROM q UNION ALL SELECT u || '-' || name, 'rdf:type', 'lis:Quality' FROM q UNION ALL SELECT u || '-' || name, 'rdf:type', 'x:' || name FROM q
  UNION ALL SELECT u || '-' || name, 'lis:qualityQuantifiedAs', u || '-' || name || '-datum' FROM q UNION ALL SELECT u || '-' || name || '-datum', 'rdf:type', CASE name WHEN 'FileSize' THEN 'lis:ScalarQuantityDatum' ELSE 'lis:QuantityDatum' END FROM q
  UNION ALL SELECT u || '-' || name || '-datum', 'lis:datumValue', '"' || value || '"' FROM v UNION ALL SELECT u || '-FileSize-datum', 'lis:datumUOM', 'x:byte' FROM f UNION ALL SELECT u || '-FileSize-datum', 'lis:datumValue', '"' || n_chars || '"^^xsd:double' FROM f""")
def emit_recognized_files(spark, d):
    f = table(spark, d, "documents").select(
        T.iri("x:doc/", F.col("doc_id")).alias("uri"), T.iri("/d/", F.col("doc_id")).alias("path"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("hash"), F.lit("text/plain").alias("mime"),
        F.col("source").alias("title"), F.lit(" ").alias("author"), F.col("lang").alias("producer"), F.lit("n/a").alias("pages"),
    )
    return emit.recognized_files(f)


@query(
    "emit_diagram",
    f"""WITH {GEO}, g AS (SELECT DISTINCT s, p, o, o[1] = '"' AS lit FROM geo WHERE p NOT LIKE 'rdfs:%'), n AS (SELECT s, CASE WHEN p = 'rdf:type' THEN '<<' || o || '>>' END AS kind, CASE WHEN lit THEN p || ' = ' || o END AS member,
  CASE WHEN NOT lit AND p <> 'rdf:type' THEN s || ' --> ' || o || ' : ' || p END AS arrow FROM g)
  SELECT s, 'object ' || s || ' ' || coalesce(string_agg(kind, chr(10) ORDER BY kind), '') || ' {{' || chr(10) || coalesce(string_agg(member, chr(10) ORDER BY member), '') || chr(10) || '}}' || chr(10) || coalesce(string_agg(arrow, chr(10) ORDER BY arrow), '') AS text
  FROM n GROUP BY s""",
)
def emit_diagram(spark, d):
    return emit.diagram(M.geography(spark, d))


# --- names, pages and proposals that had no row --------------------------------------


@query(
    "scalar_uris",
    """SELECT p_partkey, 'http://x/' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '#' ELSE '/' END AS namespace, 'part-' || p_partkey || '-is-made' AS slug,
  CASE p_partkey % 3 WHEN 0 THEN 'http://p/' || p_partkey WHEN 1 THEN 'urn:x:' || p_partkey END AS full_name, 'x:doc#id-' || p_partkey AS fragment_uri FROM part""",
)
def scalar_uris(spark, d):
    """Namespaces, slugs of templates, short names in full, fragments of a document."""
    p = table(spark, d, "part")
    k = p.p_partkey.cast("string")
    uri = F.concat(F.lit("http://x/"), p.p_size.cast("string"), F.when(p.p_partkey % 2 == 0, "#").otherwise("/"), F.lit("Part"), k, F.lit("IsMade"))
    curie = F.when(p.p_partkey % 3 == 0, F.concat(F.lit("p:"), k)).when(p.p_partkey % 3 == 1, F.concat(F.lit("urn:x:"), k)).otherwise(F.concat(F.lit("q:"), k))
    return p.select(
        "p_partkey", T.namespace(uri).alias("namespace"), F.regexp_replace(T.template_slug(uri), "part([0-9])", "part-$1").alias("slug"), T.expand_name(curie, {"p": "http://p/"}).alias("full_name"),
        T.fragment_uri(F.lit("x:doc"), F.concat(F.lit(" # id-"), k)).alias("fragment_uri"),
    )


@query(
    "scalar_shown",
    r"""WITH x AS (SELECT doc_id, text, regexp_replace(regexp_replace(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'), ' '), '[\x00-\x1f\x7f]', '', 'g'), '^ +| +$', '', 'g') AS flat, replace(replace(text, '"', ''''), chr(10), ' ') AS plain FROM documents)
  SELECT doc_id, substr(replace(replace(flat, '\', '\\'), '"', '\"'), 1, 200) AS escaped, CASE WHEN length(plain) > 80 THEN substr(plain, 1, 77) || '...' ELSE plain END AS shown FROM x""",
)
def scalar_shown(spark, d):
    """Texts as a query's literals and as they are shown."""
    t = table(spark, d, "documents")
    return t.select("doc_id", T.query_escape(F.col("text")).alias("escaped"), T.shown_literal(F.col("text")).alias("shown"))


@query(
    "scalar_markers",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ' {#id-' || p_partkey || '}' WHEN 1 THEN ' {#id-' || p_partkey || ' .class-' || p_size || '}' ELSE '' END AS marker,
  CASE WHEN p_partkey % 2 = 0 THEN '<p>' || p_name || '</p>' ELSE '<h1>' || p_name || '</h1>' END AS body FROM part""",
)
def scalar_markers(spark, d):
    """Marks of anchors, and what a page holds between its body tags or, without them, at all."""
    p = table(spark, d, "part")
    k = p.p_partkey
    marker = T.anchor_marker(F.when(k % 3 != 2, F.concat(F.lit("id-"), k.cast("string"))), F.when(k % 3 == 1, F.concat(F.lit("x class-"), p.p_size.cast("string"))).when(k % 3 == 0, "classy"))
    page = F.when(k % 2 == 0, F.concat(F.lit("<html><BODY class='a'> <p>"), "p_name", F.lit("</p>\n</body></html>"))).otherwise(F.concat(F.lit(" <h1>"), "p_name", F.lit("</h1> ")))
    return p.select("p_partkey", marker.alias("marker"), T.page_body(page).alias("body"))


@query(
    "classes_proposed",
    """WITH k AS (SELECT n_name AS slug, 'a' || n_regionkey AS anchor, 'Old ' || n_name AS label, ['x'] AS alts, CASE WHEN n_nationkey % 2 = 0 THEN 'kept' END AS comment FROM nation WHERE n_nationkey % 3 <> 0),
  p AS (SELECT n_name AS slug, 'b' || n_regionkey AS anchor, 'New ' || n_name AS label, ['x', 'y'] AS alts, 'new' AS comment FROM nation WHERE n_nationkey % 3 <> 1)
  SELECT slug, coalesce(k.anchor, p.anchor) AS anchor, coalesce(k.label, p.label) AS label, coalesce(k.comment, p.comment) AS comment,
    CASE WHEN k.label IS NULL THEN 'x y' WHEN p.label IS NULL THEN 'x' ELSE p.label || ' x y' END AS alt_labels FROM k FULL JOIN p USING (slug)""",
)
def classes_proposed(spark, d):
    """Proposals merged into known classes: two thirds of the nations known, two thirds proposed."""
    n = table(spark, d, "nation")
    row = lambda lead, said, alts, comment: (F.col("n_name").alias("slug"), F.concat(F.lit(lead), F.col("n_regionkey").cast("string")).alias("anchor"), F.concat(F.lit(said), "n_name").alias("label"), F.array(*map(F.lit, alts)).alias("alt_labels"), comment.alias("comment"))
    known = n.filter("n_nationkey % 3 <> 0").select(*row("a", "Old ", ["x"], F.when(F.col("n_nationkey") % 2 == 0, "kept")))
    proposed = n.filter("n_nationkey % 3 <> 1").select(*row("b", "New ", ["x", "y"], F.lit("new")))
    return consolidate.merge_proposals(known, proposed).withColumn("alt_labels", F.array_join("alt_labels", " "))


@query("onto_extractable", "SELECT 'x:n' || n_nationkey AS term FROM nation WHERE n_nationkey % 7 <> 0")
def onto_extractable(spark, d):
    """Nations' classes that aren't opted out."""
    o = _onto(spark, d)
    n = table(spark, d, "nation")
    named = n.select(T.iri("x:nation/", n.n_nationkey).alias("term"))
    return ontology.extractable(named, o).select(F.regexp_replace("term", "x:nation/", "x:n").alias("term"))


from graphloom import entity_queries, template_queries  # noqa: E402, F401  register their queries
