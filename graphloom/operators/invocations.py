"""Template invocations as they come from replies: slots resolved, then said in both forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.terms import coerce, expand_name, is_literal_range, strip
from graphloom.operators.entities import without_omitted
from graphloom.operators.ontology import materialized
from graphloom.operators.templates import Template, expand, lift

#: Stands for an optional slot without a value; triples that name it are dropped.
OMITTED = "urn:omitted#"
CLASSES = ("owl:Class", "rdfs:Class")


def resolved(invocations: DataFrame, templates: list[Template], entities: DataFrame, ontology: DataFrame, prefixes: dict[str, str], key: str = "doc") -> DataFrame:
    """(key, template, id, values): the terms that fill the slots of ``invocations`` (key,
    template, slots: a map of texts). ``template`` holds a template's IRI.

    A literal slot takes the text as a literal of its range; a slot for classes takes a name
    that ``ontology`` declares as a class; any other the entity (key, uri, label, position)
    of the same key with that label in any case, the first by position, or else a name. An
    optional slot that gets nothing is ``OMITTED``; an invocation that lacks a required slot, or is of
    no known template, is left out. Equal invocations of one key are one.
    """
    spark = invocations.sparkSession
    wanted = [(t.uri, s.name, s.range, s.required) for t in templates for s in t.slots]
    slots = F.broadcast(spark.createDataFrame(wanted, "template string, name string, range string, required boolean"))  # as long as the templates are
    rows = invocations.select(key, "template", F.to_json("slots").alias("id"), "slots").dropDuplicates([key, "template", "id"])
    asked = rows.join(slots, "template").select(key, "template", "id", "name", "range", "required", F.nullif(strip(F.element_at("slots", F.col("name"))), F.lit("")).alias("raw"))
    labels = entities.groupBy(F.col(key), F.lower("label").alias("low")).agg(F.min_by("uri", F.struct("position", "uri")).alias("uri"))
    named = asked.withColumn("low", F.lower("raw")).withColumn("curie", expand_name(F.col("raw"), prefixes))
    known = ontology.filter((F.col("p") == "rdf:type") & F.col("o").isin(*CLASSES)).select(F.col("s").alias("curie"), F.lit(True).alias("declared")).distinct()
    met = named.join(labels, [key, "low"], "left").join(known, "curie", "left")
    literal, of_class = is_literal_range(F.col("range")), F.coalesce(F.col("range") == "owl:Class", F.lit(False))
    value = F.when(literal, coerce(F.col("raw"), F.col("range"))).when(of_class, F.when(F.col("declared"), F.col("curie"))).otherwise(F.coalesce("uri", "curie"))
    filled = F.coalesce(F.when(F.col("raw").isNotNull(), value), F.when(~F.col("required"), F.concat(F.lit(OMITTED), "name")))
    per = met.select(key, "template", "id", "name", filled.alias("value")).groupBy(key, "template", "id").agg(
        F.bool_and(F.col("value").isNotNull()).alias("whole"), F.map_from_entries(F.collect_list(F.struct("name", F.coalesce("value", F.lit(""))))).alias("values")
    )
    return per.filter("whole").drop("whole")


def materialize(invocations: DataFrame, templates: list[Template], entities: DataFrame, ontology: DataFrame, prefixes: dict[str, str], base: Column | str = "urn:tpl-instance/", key: str = "doc") -> DataFrame:
    """(key, side, s, p, o): what invocations say, lifted and lowered. The lowered triples
    are those that need no saying again (``entities.not_covered``). ``base`` names the
    anchors and may differ by key."""
    found = materialized(resolved(invocations, templates, entities, ontology, prefixes, key))
    parts = []
    for t in templates:
        own = found.filter(F.col("template") == t.uri).select(key, *[F.element_at("values", F.lit(s.name)).alias(s.name) for s in t.slots])
        for side, say in (("lifted", lift), ("lowered", expand)):
            parts.append(say(t, own, base, (key,)).select(key, F.lit(side).alias("side"), "s", "p", "o"))
    return without_omitted(reduce(lambda a, b: a.unionByName(b), parts), OMITTED).distinct()
