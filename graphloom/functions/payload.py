"""What language models reply, read as rows: JSON inside prose and code fences.

Replies are parsed as variants, so a field of an unexpected kind costs only itself.
Anything that can't be read gives no rows and null notes, never an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.terms import strip

_ITEMS = "array<variant>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def body(reply: Column) -> Column:
    """From the first ``{`` to the last ``}`` of a reply; of one that begins with a code
    fence that is closed, only of what the fence holds. Null without both."""
    fenced = lambda text: text.startswith("```") & (F.size(F.split(text, "```")) > 2)
    inside = _once(strip(reply), lambda text: F.when(fenced(text), F.split_part(text, F.lit("```"), F.lit(2))).otherwise(text))
    return _once(F.regexp_extract(inside, r"(?s)(\{.*\})", 1), lambda found: F.nullif(found, F.lit("")))


def parsed(reply: Column) -> Column:
    """The reply's object as a variant; null where it is none, or more than one."""
    listed = F.try_parse_json(F.concat(F.lit("["), body(reply), F.lit("]")))
    return _once(listed, lambda v: F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant")))


def said(item: Column, path: str) -> Column:
    """A field as trimmed text; null where it is missing or blank."""
    return _once(strip(F.try_variant_get(item, path, "string")), lambda text: F.nullif(text, F.lit("")))


def notes(reply: Column) -> Column:
    return F.coalesce(said(parsed(reply), "$.notes"), F.lit(""))


def items(reply: Column, field: str) -> Column:
    """The objects of an array field; empty where it is missing or no array."""
    found = F.try_variant_get(parsed(reply), f"$.{field}", _ITEMS)
    objects = F.filter(found, lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    return F.coalesce(objects, F.array().cast(_ITEMS))


def texts(item: Column, path: str) -> Column:
    """The strings of an array field, trimmed, blank ones and other kinds left out."""
    found = F.coalesce(F.try_variant_get(item, path, _ITEMS), F.array().cast(_ITEMS))
    strings = F.filter(found, lambda v: F.schema_of_variant(v) == "STRING")
    return F.filter(F.transform(strings, lambda v: strip(F.try_variant_get(v, "$", "string"))), lambda t: t != "")


def resolve(names: Column, known: Column, fallback: Column) -> Column:
    """Names (an array) by a map; unknown ones go, repeats go, and where nothing is left
    the fallback alone."""
    out = F.array_distinct(F.filter(F.transform(names, lambda n: known[n]), lambda u: u.isNotNull()))
    return F.when(F.size(out) > 0, out).otherwise(F.array(fallback))


def cited(item: Column, path: str = "$.evidence") -> Column:
    """array of struct(exact, anchor): evidence that names an anchor, # in front dropped."""
    found = F.coalesce(F.try_variant_get(item, path, _ITEMS), F.array().cast(_ITEMS))
    rows = F.transform(
        found, lambda v: F.struct(F.coalesce(said(v, "$.exact"), F.lit("")).alias("exact"), F.nullif(F.regexp_replace(F.coalesce(said(v, "$.anchor"), F.lit("")), "^#+", ""), F.lit("")).alias("anchor"))
    )
    return F.filter(rows, lambda r: r["anchor"].isNotNull())


def instances(replies: DataFrame, known: Column, fallback: Column, key: str = "reply_id", reply: str = "reply") -> DataFrame:
    """(key, name, types, evidence): the instances of a reply that have a name."""
    item = replies.select(key, F.explode(items(F.col(reply), "instances")).alias("_item"))
    rows = item.select(key, said(F.col("_item"), "$.name").alias("name"), texts(F.col("_item"), "$.types").alias("_types"), cited(F.col("_item")).alias("evidence"))
    return rows.filter("name is not null").select(key, "name", resolve(F.col("_types"), known, fallback).alias("types"), "evidence")


def values(replies: DataFrame, known: Column, key: str = "reply_id", reply: str = "reply") -> DataFrame:
    """(key, property, value, value_entity, evidence): values of known properties; those
    with neither a value nor an entity are left out."""
    item = replies.select(key, F.explode(items(F.col(reply), "values")).alias("_item"))
    v = F.col("_item")
    rows = item.select(key, known[said(v, "$.property")].alias("property"), said(v, "$.value").alias("value"), said(v, "$.value_entity").alias("value_entity"), F.coalesce(said(v, "$.evidence"), F.lit("")).alias("evidence"))
    return rows.filter("property is not null and (value is not null or value_entity is not null)")


def invocations(replies: DataFrame, known: Column, key: str = "reply_id", reply: str = "reply") -> DataFrame:
    """(key, template, slots, evidence): invocations of known templates, with the slots
    that say something. ``known`` maps names to templates; a name in <> counts as bare."""
    item = replies.select(key, F.explode(items(F.col(reply), "invocations")).alias("_item"))
    v = F.col("_item")
    name = F.regexp_replace(F.coalesce(said(v, "$.template"), F.lit("")), "^<|>$", "")
    slots = F.transform_values(F.coalesce(F.try_variant_get(v, "$.slots", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda _, x: strip(x))
    rows = item.select(key, known[name].alias("template"), F.map_filter(slots, lambda _, x: F.coalesce(x, F.lit("")) != "").alias("slots"), F.coalesce(said(v, "$.evidence"), F.lit("")).alias("evidence"))
    return rows.filter("template is not null and cardinality(slots) > 0")


def answers(reply: Column) -> Column:
    """map of question number to struct(answer, reason): each answer is a text or an object
    of answer and reason; blank answers and other kinds are left out."""
    both = F.try_variant_get(parsed(reply), "$", "map<string,variant>")

    def one(_: Column, v: Column) -> Column:
        flat = F.schema_of_variant(v) == "STRING"
        answer = F.when(flat, said(v, "$")).otherwise(said(v, "$.answer"))
        return F.struct(answer.alias("answer"), F.coalesce(said(v, "$.reason"), F.lit("")).alias("reason"))

    return F.map_filter(F.transform_values(both, one), lambda _, s: s["answer"].isNotNull())


def subjects(reply: Column, known: Column) -> Column:
    """struct(subjects, confidence, rationale): labels by a map, unknown ones left out; a
    reply that can't be read has none, with confidence 0."""

    def told(v: Column) -> Column:
        found = F.transform(texts(v, "$.subjects"), lambda n: known[n])
        return F.struct(
            F.filter(found, lambda u: u.isNotNull()).alias("subjects"), F.coalesce(F.try_variant_get(v, "$.confidence", "double"), F.lit(0.0)).alias("confidence"),
            F.when(v.isNull(), "(parse error)").otherwise(F.coalesce(said(v, "$.rationale"), F.lit(""))).alias("rationale"),
        )

    return _once(parsed(reply), told)
