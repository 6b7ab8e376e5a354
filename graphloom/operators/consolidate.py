"""Classes across scopes: grouping, merging, promotion, alignment, retyping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.terms import literal
from graphloom.operators.ontology import materialized


def candidates(defined: DataFrame, least: int = 2) -> DataFrame:
    """(slug, docs): slugs that at least ``least`` documents define. ``defined``: doc,
    slug, and flags deprecated and promoted, rows with either left out."""
    fresh = defined.filter(~F.col("deprecated") & ~F.col("promoted"))
    return fresh.groupBy("slug").agg(F.countDistinct("doc").alias("docs")).filter(F.col("docs") >= least)


def merge(defined: DataFrame) -> DataFrame:
    """One class per slug: the longest label and comment (ties: the smallest), every
    other label and all alternative labels, the smallest anchor and namespace."""
    longest = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(-F.length(c), F.col(c))))[c]
    out = defined.groupBy("slug").agg(
        longest("label").alias("label"), longest("comment").alias("comment"), F.collect_set("label").alias("labels"),
        F.flatten(F.collect_set("alt_labels")).alias("alts"), F.min("anchor").alias("anchor"),
    )
    alts = F.array_sort(F.array_distinct(F.array_except(F.concat("labels", "alts"), F.array("label"))))
    return out.select("slug", "anchor", "label", alts.alias("alt_labels"), "comment")


def merge_proposals(known: DataFrame, proposed: DataFrame) -> DataFrame:
    """Known classes take the proposal's labels as alternatives and keep the rest; new
    slugs come in as proposed."""
    p = proposed.select("slug", *[F.col(c).alias(f"new_{c}") for c in ("anchor", "label", "alt_labels", "comment")])
    j = known.join(p, "slug", "full")
    none = F.array().cast("array<string>")
    more = F.array_union(F.coalesce("alt_labels", none), F.array_union(F.coalesce("new_alt_labels", none), F.array_compact(F.array("new_label"))))
    alts = F.when(F.col("label").isNull(), F.coalesce("new_alt_labels", none)).otherwise(F.array_except(more, F.array("label")))
    return j.select("slug", *[F.coalesce(c, f"new_{c}").alias(c) for c in ("anchor", "label")], F.array_sort(alts).alias("alt_labels"), F.coalesce("comment", "new_comment").alias("comment"))


def definitions(merged: DataFrame, ns: str, provenance: str = "promoted") -> DataFrame:
    """Class definitions as triples, those without a value left out."""
    one = lambda p, o: F.struct(F.lit(p).alias("p"), o.alias("o"))
    fixed = F.array(
        one("rdf:type", F.lit("owl:Class")), one("rdfs:subClassOf", F.col("anchor")), one("rdfs:label", literal(F.col("label"))),
        one("rdfs:comment", literal(F.col("comment"))), one("x:provenance", literal(F.lit(provenance))),
    )
    alts = F.transform("alt_labels", lambda a: one("skos:altLabel", literal(a)))
    return merged.select(F.concat(F.lit(ns), "slug").alias("s"), F.inline(F.concat(fixed, alts))).filter("o is not null")


def align(local: DataFrame, higher: DataFrame) -> DataFrame:
    """(cls, target): the class of a higher scope with the same slug, the project's
    before others, the smallest of several. ``higher``: cls, slug, priority, deprecated."""
    best = higher.filter(~F.col("deprecated")).groupBy("slug").agg(F.min(F.struct("priority", F.col("cls").alias("target")))["target"].alias("target"))
    return local.join(best, "slug").filter("cls <> target").select("cls", "target")


def follow(mapping: DataFrame, replaced: DataFrame, most: int = 6) -> DataFrame:
    """(cls, target) with replacements followed to their end. ``replaced``: old, new."""
    hop = materialized(replaced.groupBy(F.col("old").alias("_old")).agg(F.min("new").alias("_new")))
    for _ in range(most):
        # every round doubles how far one hop goes; a circle ends with the rounds
        ahead = hop.select(F.col("_old").alias("_a"), F.col("_new").alias("_b"))
        longer = materialized(hop.join(ahead, F.col("_new") == F.col("_a"), "left").select("_old", F.coalesce("_b", "_new").alias("_new"), F.col("_b").isNotNull().alias("_on")))
        hop = longer.drop("_on")
        if longer.filter("_on").isEmpty():
            break
    return mapping.join(hop, F.col("target") == F.col("_old"), "left").select("cls", F.coalesce("_new", "target").alias("target"))


def retype(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """The changes (op, s, p, o) that move instances from ``old`` to ``new`` classes and
    mark the old ones as replaced."""
    moved = triples.filter("p = 'rdf:type'").join(mapping, F.col("o") == F.col("old"))
    out = moved.select(F.lit("removed").alias("op"), "s", "p", "o").unionByName(moved.select(F.lit("added").alias("op"), "s", "p", F.col("new").alias("o")))
    old = mapping.select("old", F.inline(F.array(
        F.struct(F.lit("owl:deprecated").alias("p"), F.lit('"true"^^xsd:boolean').alias("o")), F.struct(F.lit("dct:isReplacedBy").alias("p"), F.col("new").alias("o"))
    )))
    return out.unionByName(old.select(F.lit("added").alias("op"), F.col("old").alias("s"), "p", "o"))


def apply_changes(triples: DataFrame, changes: DataFrame) -> DataFrame:
    keys = ["s", "p", "o"]
    return triples.join(changes.filter("op = 'removed'").select(keys), keys, "left_anti").unionByName(changes.filter("op = 'added'").select(keys)).distinct()


def unresolved(triples: DataFrame, defined: DataFrame) -> DataFrame:
    """Terms that are used as types and nowhere defined (cls)."""
    return triples.filter("p = 'rdf:type'").select(F.col("o").alias("cls")).distinct().join(defined, "cls", "left_anti")


def unused(deprecated: DataFrame, triples: DataFrame) -> DataFrame:
    """Deprecated classes (cls) without an instance."""
    return deprecated.join(triples.filter("p = 'rdf:type'").select(F.col("o").alias("cls")), "cls", "left_anti")


def signatures(triples: DataFrame, least: int = 3, scopes: int = 2) -> DataFrame:
    """(signature, n, scopes): sets of predicates around a subject that come back."""
    shapes = triples.groupBy("scope", "s").agg(F.array_join(F.array_sort(F.collect_set("p")), " ").alias("signature"))
    return shapes.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("scope").alias("scopes")).filter((F.col("n") >= least) & (F.col("scopes") >= scopes))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def unique_slugs(rows: DataFrame, slug: str, order: str) -> DataFrame:
    """base, base-2, base-3 ... in ``order`` of those that share a slug."""
    n = F.row_number().over(Window.partitionBy(slug).orderBy(order))
    return rows.withColumn("unique_slug", F.when(n == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), n.cast("string"))))


def fresh_slugs(new: DataFrame, known: DataFrame, slug: str, order: str) -> DataFrame:
    """``new`` with ``unique_slug``, which no row of ``known`` (slug) and no other new row
    has: the slug itself where it is free, for the first in ``order``; the others go on
    behind the highest number that the slug has anywhere."""
    names = known.select(F.col("slug").alias("_name"), F.lit(True).alias("_held")).unionByName(new.select(F.col(slug).alias("_name"), F.lit(False).alias("_held"))).groupBy("_name").agg(F.max("_held").alias("_held"))
    behind = r"^(.*)-([0-9]{1,9})$"
    top = names.filter(F.col("_name").rlike(behind)).groupBy(F.regexp_extract("_name", behind, 1).alias("_base")).agg(F.max(F.regexp_extract("_name", behind, 2).cast("long")).alias("_top"))
    rank = F.row_number().over(Window.partitionBy(slug).orderBy(order))
    rows = new.join(names, F.col(slug) == F.col("_name")).join(top, F.col(slug) == F.col("_base"), "left").withColumn("_n", rank - F.when(F.col("_held"), 0).otherwise(1))
    numbered = F.concat(F.col(slug), F.lit("-"), (F.greatest(F.coalesce("_top", F.lit(1)), F.lit(1)) + F.col("_n")).cast("string"))
    return rows.withColumn("unique_slug", F.when(F.col("_n") == 0, F.col(slug)).otherwise(numbered)).drop("_name", "_held", "_base", "_top", "_n")


def replaced_once(rows: DataFrame, replaced: DataFrame) -> DataFrame:
    """``rows`` (cls ...) with ``target``: what the class was replaced by (cls, by; the
    smallest of several), one hop and no further, else the class itself."""
    step = replaced.groupBy("cls").agg(F.min("by").alias("by"))
    return rows.join(step, "cls", "left").withColumn("target", F.coalesce("by", "cls")).drop("by")
