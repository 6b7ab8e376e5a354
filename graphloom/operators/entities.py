"""Extracted entities: typing, evidence, what may still be asked of them, roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.terms import is_literal, lexical, literal, local_name, role_uri
from graphloom.operators import ontology
from graphloom.sources.mapping import dealt

#: Classes that are too general to hang a new class on.
TOO_GENERAL = ("lis:Object", "lis:Aspect")


# --- entities of a graph -----------------------------------------------------------


def extractable_types(triples: DataFrame, onto: DataFrame) -> DataFrame:
    """(s, type): types that are names, of subjects that are names, not opted out."""
    named = triples.filter((F.col("p") == "rdf:type") & ~is_literal(F.col("o")) & ~F.col("o").startswith("_:") & ~F.col("s").startswith("_:"))
    return named.select("s", F.col("o").alias("type")).distinct().join(ontology.opted_out(onto), F.col("type") == F.col("term"), "left_anti")


def typed_entities(triples: DataFrame, onto: DataFrame, up: DataFrame) -> DataFrame:
    """(s, type, types, label, hints): subjects with an extractable type. ``type`` is the
    most specific one, ``label`` the smallest label or else the local name, ``hints`` the
    class names suggested for it; types and hints are sorted."""
    typed = extractable_types(triples, onto)
    best = ontology.most_specific(typed, up)
    kinds = typed.groupBy("s").agg(F.sort_array(F.collect_set("type")).alias("types"))
    said = lambda p: F.when(F.col("p") == p, F.coalesce(lexical(F.col("o")), F.col("o")))
    hint = F.when((F.col("p") == "x:typeHint") & is_literal(F.col("o")), lexical(F.col("o")))
    facts = triples.filter(F.col("p").isin("rdfs:label", "x:typeHint")).groupBy("s").agg(F.min(said("rdfs:label")).alias("label"), F.sort_array(F.collect_set(hint)).alias("hints"))
    none = F.array().cast("array<string>")
    return best.join(kinds, "s").join(facts, "s", "left").select("s", "type", "types", F.coalesce("label", local_name(F.col("s"))).alias("label"), F.coalesce("hints", none).alias("hints"))


def evidence(triples: DataFrame) -> DataFrame:
    """(s, anchor, exact): what an entity is represented by. A name with something behind
    its last # gives that as anchor; others are followed over their selectors to the
    smallest exact text of each."""
    by = triples.filter((F.col("p") == "lis:representedBy") & ~is_literal(F.col("o"))).select("s", F.col("o").alias("quote"))
    last = F.when(F.col("quote").contains("#"), F.nullif(F.substring_index("quote", "#", -1), F.lit("")))
    anchored = by.select("s", last.alias("anchor"), F.lit("").alias("exact")).filter("anchor is not null")
    selector = triples.filter("p = 'oa:hasSelector'").select(F.col("s").alias("quote"), F.col("o").alias("selector"))
    exact = triples.filter("p = 'oa:exact'").groupBy(F.col("s").alias("selector")).agg(F.min(F.coalesce(lexical(F.col("o")), F.col("o"))).alias("exact"))
    quoted = by.filter(last.isNull()).join(selector, "quote").join(exact, "selector").select("s", F.lit(None).cast("string").alias("anchor"), "exact")
    return anchored.unionByName(quoted)


def subject_candidates(onto: DataFrame, ns: str = "lis:", broad: str = "lis:Object", definitions: dict[str, str] | None = None) -> DataFrame:
    """(cls, label, definition): the namespace's roots, the broad one replaced by its own
    children; classes that are opted out are left out. ``definitions`` serve those that
    have none."""
    tops = ontology.roots(onto, ns).filter(F.col("cls") != broad)
    lower = onto.filter((F.col("p") == "rdfs:subClassOf") & (F.col("o") == broad) & F.col("s").startswith(ns)).select(F.col("s").alias("cls"))
    opened = lower.join(ontology.roots(onto, ns).filter(F.col("cls") == broad).select(F.lit(broad).alias("_root")), F.lit(broad) == F.col("_root"), "left_semi")
    kept = ontology.extractable(tops.unionByName(opened).distinct().withColumnRenamed("cls", "term"), onto).withColumnRenamed("term", "cls")
    known = F.create_map(*[F.lit(x) for kv in (definitions or {"": ""}).items() for x in kv])
    texts = ontology.annotations(onto)
    return kept.join(texts, "cls", "left").select("cls", F.coalesce("label", local_name(F.col("cls"))).alias("label"), F.coalesce(F.nullif("definition", F.lit("")), known[F.col("cls")], F.lit("")).alias("definition"))


# --- what may be used --------------------------------------------------------------


def declared_classes(onto: DataFrame) -> DataFrame:
    """(cls): typed as a class, or below another class."""
    typed = (F.col("p") == "rdf:type") & F.col("o").isin("owl:Class", "rdfs:Class")
    return onto.filter(typed | (F.col("p") == "rdfs:subClassOf")).select(F.col("s").alias("cls")).distinct()


def allowed_anchors(proposed: DataFrame, onto: DataFrame, ns: str = "lis:", too_general: tuple[str, ...] = TOO_GENERAL) -> DataFrame:
    """Rows of ``proposed`` (anchor ...) whose anchor is a class of the namespace, typed as
    one, and not too general."""
    fits = proposed.filter(F.col("anchor").startswith(ns) & ~F.col("anchor").isin(*too_general))
    return fits.join(ontology.classes(onto).withColumnRenamed("cls", "anchor"), "anchor", "left_semi")


def unlocked_properties(refined: DataFrame, selected: DataFrame, triples: DataFrame) -> DataFrame:
    """(s, property): what new types make askable. ``refined``: s, old, new; ``selected``:
    type, property worth asking for. Less what the old type already allowed, and what the
    entity has values of."""
    now = refined.select("s", F.col("new").alias("type")).join(selected, "type").select("s", "property").distinct()
    before = refined.select("s", F.col("old").alias("type")).join(selected, "type").select("s", "property")
    filled = triples.select("s", F.col("p").alias("property"))
    return now.join(before, ["s", "property"], "left_anti").join(filled, ["s", "property"], "left_anti")


def applicable_templates(entities: DataFrame, templates: DataFrame) -> DataFrame:
    """(s, template): templates (template, subject) whose subject is one of an entity's
    types (s, type), each once. Types are few and entities many: up to ``ontology.FEW``
    templates are sent to all tasks, and entities are dealt by their names, not by type."""
    few = templates.limit(ontology.FEW + 1).count() <= ontology.FEW
    return dealt(entities.select("s", "type"), "s").join(F.broadcast(templates) if few else templates, F.col("type") == F.col("subject")).select("s", "template").distinct()


# --- emitting ----------------------------------------------------------------------


def reify_roles(participants: DataFrame, entities: DataFrame, base: str) -> DataFrame:
    """Triples of an activity's participants (activity, name, role, hints). A name that an
    entity (s, label) has, case ignored, takes part; with a role, the role is an individual
    realised in the activity and held by the participant. Other names give nothing."""
    same = lambda c: F.lower(F.trim(c))
    who = entities.groupBy(same(F.col("label")).alias("_name")).agg(F.min("s").alias("player"))
    rows = participants.filter(F.trim("name") != "").join(who, same(F.col("name")) == F.col("_name"))
    role = F.nullif(F.trim("role"), F.lit(""))
    uri = role_uri(base, role, F.col("activity"))
    t = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    facts = F.array(
        t(F.col("activity"), "lis:hasParticipant", F.col("player")), t(uri, "rdf:type", F.when(role.isNotNull(), F.lit("lis:Role"))), t(uri, "rdfs:label", literal(role)),
        t(uri, "lis:realizedIn", F.when(role.isNotNull(), F.col("activity"))), t(F.col("player"), "lis:hasRole", uri),
    )
    hints = F.transform(F.filter(F.coalesce("hints", F.array().cast("array<string>")), lambda h: F.trim(h) != ""), lambda h: t(uri, "x:typeHint", literal(F.trim(h))))
    return rows.select(F.inline(F.concat(facts, hints))).filter("s is not null and o is not null").distinct()


def not_covered(triples: DataFrame, lowered: DataFrame) -> DataFrame:
    """Triples that no template invocation has said already."""
    return triples.join(lowered.select("s", "p", "o"), ["s", "p", "o"], "left_anti")


def without_omitted(triples: DataFrame, sentinel: str) -> DataFrame:
    """Triples none of whose terms stands for an omitted slot: those begin with
    ``sentinel``."""
    omitted = lambda c: F.col(c).startswith(sentinel)
    return triples.filter(~(omitted("s") | omitted("p") | omitted("o")))


def layer(working: DataFrame, baseline: DataFrame) -> DataFrame:
    """What a later stage adds: triples of ``working`` that ``baseline`` lacks."""
    return working.select("s", "p", "o").subtract(baseline.select("s", "p", "o"))


def union_view(*graphs: DataFrame) -> DataFrame:
    """The distinct triples of several graphs."""
    out = graphs[0].select("s", "p", "o")
    for g in graphs[1:]:
        out = out.unionByName(g.select("s", "p", "o"))
    return out.distinct()


def recorded_hash(triples: DataFrame, expected: DataFrame, kind: str = "x:FileHash") -> DataFrame:
    """``expected`` (s, hash) with ``same``: the graph's quality of that kind leads over a
    datum to this very value."""
    of = lambda p, a, b: triples.filter(F.col("p") == p).select(F.col("s").alias(a), F.col("o").alias(b))
    kinds = triples.filter((F.col("p") == "rdf:type") & (F.col("o") == kind)).select(F.col("s").alias("quality"))
    values = of("lis:datumValue", "datum", "value").select("datum", F.coalesce(lexical(F.col("value")), F.col("value")).alias("hash"))
    path = of("lis:hasQuality", "s", "quality").join(kinds, "quality", "left_semi").join(of("lis:qualityQuantifiedAs", "quality", "datum"), "quality").join(values, "datum")
    known = path.select("s", "hash").distinct().withColumn("same", F.lit(True))
    return expected.join(known, ["s", "hash"], "left").withColumn("same", F.coalesce("same", F.lit(False)))


# --- text for vectors, and figures of a scan ---------------------------------------


def class_texts(onto: DataFrame, most: int = 1500) -> DataFrame:
    """(cls, text): a class's name, label, comment, definition, note and the labels of the
    classes above it, a line each, cut to ``most`` characters."""
    first = lambda p: F.min(F.when(F.col("p") == p, lexical(F.col("o"))))
    facts = onto.groupBy(F.col("s").alias("cls")).agg(first("rdfs:label").alias("label"), first("rdfs:comment").alias("comment"), first("skos:definition").alias("definition"), first("skos:note").alias("note"))
    above = onto.filter((F.col("p") == "rdfs:subClassOf") & ~F.col("o").startswith("_:")).select(F.col("s").alias("cls"), F.col("o").alias("up"))
    labels = facts.filter("label is not null").select(F.col("cls").alias("up"), F.col("label").alias("up_label"))
    parents = above.join(labels, "up").groupBy("cls").agg(F.transform(F.array_sort(F.collect_list("up_label")), lambda x: F.concat(F.lit("subtype of: "), x)).alias("parents"))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c))
    text = F.concat_ws("\n", "cls", line("label", "label"), line("description", "comment"), line("definition", "definition"), line("note", "note"), F.array_join("parents", "\n"))
    return ontology.classes(onto).join(facts, "cls").join(parents, "cls", "left").select("cls", F.substring(text, 1, most).alias("text"))


def document_text(text: Column, most: int = 2000) -> Column:
    """The opening of a document, as far as its vector is made from."""
    return F.substring(text, 1, most)


def scan_figures(findings: DataFrame, docs: DataFrame, kinds: int = 11) -> DataFrame:
    """(doc_id, share, yes_share): characters of evidence among the document's, and yes
    answers among the kinds asked for. ``findings``: doc_id, evidence, yes."""
    found = findings.groupBy("doc_id").agg(F.sum(F.length("evidence")).alias("said"), F.sum(F.col("yes").cast("int")).alias("yes"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return docs.join(found, "doc_id", "left").select("doc_id", F.round(zero("said") / F.nullif(F.length("text"), F.lit(0)), 6).alias("share"), F.round(zero("yes") / kinds, 6).alias("yes_share"))


def declares(triples: DataFrame) -> DataFrame:
    """(scope, classes, properties, individuals): whether a source declares any."""
    kind = lambda *names: F.col("o").isin(*names)
    is_class, is_prop = kind("owl:Class", "rdfs:Class"), kind("owl:ObjectProperty", "owl:DatatypeProperty", "owl:AnnotationProperty", "rdf:Property")
    typed = triples.filter("p = 'rdf:type'")
    other = ~is_class & ~is_prop & ~F.col("o").startswith("owl:")
    return typed.groupBy("scope").agg(F.max(is_class).alias("classes"), F.max(is_prop).alias("properties"), F.max(other).alias("individuals"))


def without_scope(triples: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """A source's triples taken away: what stays, and the names that other scopes use but
    nobody defines any more, to be repaired as stubs."""
    kept = triples.filter(~F.col("scope").eqNullSafe(scope))
    gone = triples.filter(F.col("scope").eqNullSafe(scope)).select(F.col("s").alias("name")).distinct()
    used = kept.filter(~is_literal(F.col("o"))).select(F.col("o").alias("name")).distinct()
    return kept, gone.join(used, "name", "left_semi").join(kept.select(F.col("s").alias("name")), "name", "left_anti")
