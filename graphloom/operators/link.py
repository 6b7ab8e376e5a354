"""Linking entities: by label, by mention, to a reference library, by vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_label(values: DataFrame, labels: DataFrame, fold_case: bool = False) -> DataFrame:
    """``values`` (value ...) with the smallest entity that has that label, if any.
    ``labels``: s, label."""
    same = (lambda c: F.lower(c)) if fold_case else (lambda c: F.col(c))
    known = labels.groupBy(same("label").alias("_l")).agg(F.min("s").alias("entity"))
    return values.join(known, same("value") == F.col("_l"), "left").drop("_l")


#: What words are made of, as the inside of a character class; words of a label that
#: texts are looked up by.
WORD, HEAD = r"\p{L}\p{N}_", 3


def words(text: Column) -> Column:
    """The words of a text, in lower case: runs of letters, digits and _ of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]+"), 0)


def _head(found: Column, at: Column, n: Column | int) -> Column:
    return F.xxhash64(F.array_join(F.slice(found, at, n), " "))


def _marks(text: Column) -> Column:
    """Characters that are in no word, each once."""
    return F.array_distinct(F.split(F.regexp_replace(text, f"[{WORD}]+", ""), ""))


def mentions(texts: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, s): labels that stand in a text as they are, case ignored, with a word's
    edge on both sides. Empty labels and rows with a null key are left out.

    Texts and labels meet on hashes of a label's first words (or its first character,
    where it has no word); texts stay behind and come back to the rows that met, to be
    searched for the whole label. A label is looked for once, however many have it; who has
    it is joined to what was found, and rows are made distinct only for those with several.
    """
    low = labels.select("s", F.lower("label").alias("said")).filter("said <> ''").withColumn("w", words(F.col("said")))
    sign = F.xxhash64(F.concat(F.lit("\x00"), F.substring("said", 1, 1)))
    head = F.when(F.size("w") > 0, _head(F.col("w"), F.lit(1), F.lit(HEAD))).otherwise(sign)
    inner = lambda c: c.rlike(f"^[{WORD}]")
    last = F.substring("said", -1, 1)
    edge = lambda c, inside, outside: F.when(inner(c), inside).otherwise(outside)
    quoted = F.concat(F.lit("\\Q"), F.replace(F.col("said"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pattern = F.concat(edge(F.col("said"), f"(?<![{WORD}])", f"(?<=[{WORD}])"), quoted, edge(last, f"(?![{WORD}])", f"(?=[{WORD}])"))
    heads = low.select("said", "w").distinct().select("said", head.alias("head"), pattern.alias("pattern"))
    bodies = texts.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.lower(text).alias("_body"))
    starting = lambda n: lambda _, i: _head(F.col("w"), i + 1, n)
    runs = [F.transform(F.col("w"), starting(n)) for n in range(1, HEAD + 1)]
    signs = F.transform(_marks(F.col("_body")), lambda c: F.xxhash64(F.concat(F.lit("\x00"), c)))
    keys = bodies.select("_k", "_body", words(F.col("_body")).alias("w")).select("_k", F.explode(F.array_distinct(F.concat(*runs, signs))).alias("head"))
    # labels are few beside the words of all texts: what no label begins with goes first
    met = keys.join(heads.select("head").distinct(), "head", "left_semi").join(heads, "head").select("_k", "said", "pattern").distinct()
    hits = met.join(bodies, "_k").filter(F.col("_body").contains(F.col("said")) & F.rlike("_body", F.col("pattern")))
    hits = hits.select(F.col("_k").alias(key), "said").distinct()
    owners = low.groupBy("s").agg(F.collect_set("said").alias("labels"))
    one = hits.join(owners.filter(F.size("labels") == 1).select("s", F.col("labels")[0].alias("said")), "said").select(key, "s")
    several = hits.join(owners.filter(F.size("labels") > 1).select("s", F.explode("labels").alias("said")), "said").select(key, "s").distinct()
    return one.unionByName(several)


def infer_links(entities: DataFrame, allowed: DataFrame, taken: DataFrame, ok: DataFrame) -> DataFrame:
    """(s, property, other): for an entity (s, type, evidence, pos) and a property its
    type allows (type, property), the first other entity (label, pos) named in its
    evidence whose type the property takes (property, other_type), unless filled."""
    labels = entities.select(F.col("s"), F.col("label"))
    named = mentions(entities.select(F.col("s").alias("e"), F.col("evidence").alias("text")), labels, "e", "text").filter("e <> s").withColumnRenamed("s", "other")
    other = entities.select(F.col("s").alias("other"), F.col("type").alias("other_type"), F.col("pos").alias("other_pos"))
    rows = entities.select("s", "type").join(allowed, "type").join(taken.select("s", "property"), ["s", "property"], "left_anti")
    met = rows.join(named, F.col("s") == F.col("e")).join(other, "other").join(ok, ["property", "other_type"], "left_semi")
    return met.withColumn("r", F.row_number().over(Window.partitionBy("s", "property").orderBy("other_pos", "other"))).filter("r = 1").select("s", "property", "other")


def guard(statements: DataFrame, labels: DataFrame, domain: DataFrame, range_: DataFrame, object_properties: DataFrame) -> DataFrame:
    """``statements`` (name, property, value) with the verdict: ``unknown entity``,
    ``domain``, ``literal for object``, ``range`` or ``ok``. ``labels``: s, label, type;
    ``domain`` and ``range_``: the (property, type) pairs that hold."""
    subject = labels.groupBy(F.col("label").alias("name")).agg(F.min(F.struct("s", "type")).alias("e"))
    target = labels.groupBy(F.col("label").alias("value")).agg(F.min(F.struct("s", "type")).alias("t"))
    j = statements.join(subject, "name", "left").join(target, "value", "left").join(object_properties.withColumn("is_object", F.lit(True)), "property", "left")
    j = j.withColumn("type", F.col("e.type")).join(domain.select("property", "type", F.lit(True).alias("d")), ["property", "type"], "left").drop("type")
    j = j.withColumn("type", F.col("t.type")).join(range_.select("property", "type", F.lit(True).alias("r")), ["property", "type"], "left").drop("type")
    verdict = (
        F.when(F.col("e").isNull(), "unknown entity").when(F.col("d").isNull(), "domain")
        .when(F.col("is_object") & F.col("t").isNull(), "literal for object").when(F.col("t").isNotNull() & F.col("r").isNull(), "range").otherwise("ok")
    )
    return j.select("name", "property", "value", F.col("e.s").alias("s"), F.col("t.s").alias("o"), verdict.alias("verdict"))


def _grams(text: Column, n: int) -> Column:
    """Runs of ``n`` characters, each once."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n))))


def lookup(probes: DataFrame, library: DataFrame) -> DataFrame:
    """(probe, uri, label, confidence): a label, case ignored, that equals the probe is
    1.0; else the smallest of the entities with a label that holds it, 0.6 (0.7 where the
    label differs in nothing but case after all). ``library``: uri, label and, where
    there are alternative labels, ``alternative``: those count for equality alone.
    White space in probes is collapsed; empty ones find nothing.

    Of entities whose labels are equal but for case the smallest answers for all. A probe
    meets the labels on the rarest of its three-character runs (on itself if it is shorter) and
    is then looked for in them. That join is a shuffle: runs are many times their labels, which
    Spark's estimates don't know.
    """
    other = F.coalesce(F.col("alternative"), F.lit(False)) if "alternative" in library.columns else F.lit(False)
    ref = library.select("uri", "label", F.lower("label").alias("low"), other.alias("other"))
    asked = probes.select("probe", F.lower(F.trim(F.regexp_replace("probe", r"\s+", " "))).alias("p")).filter("p <> ''").distinct()
    # equal labels hold the same probes, so one of them is enough
    one_each = lambda rows: rows.groupBy("low").agg(F.min(F.struct("uri", "label")).alias("m"))
    exact = asked.join(one_each(ref), F.col("p") == F.col("low")).select("probe", "m.uri", "m.label", F.lit(1.0).alias("confidence"))
    rest = asked.join(exact, "probe", "left_anti")
    named = one_each(ref.filter(~F.col("other"))).select("low", "m.uri", "m.label")
    low = F.col("low")
    grams = named.select("uri", "label", "low", F.explode(F.array_distinct(F.concat(*[_grams(low, n) for n in (1, 2, 3)]))).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    mine = rest.select("probe", "p", F.explode(F.when(F.length("p") < 3, F.array("p")).otherwise(_grams(F.col("p"), 3))).alias("gram"))
    rare = mine.join(counts, "gram", "left").groupBy("probe", "p").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    near = rare.join(grams.hint("merge"), "gram").filter(F.col("low").contains(F.col("p"))).groupBy("probe", "p").agg(F.min(F.struct("uri", "label", "low")).alias("m"))
    found = near.select("probe", "m.uri", "m.label", F.when(F.col("m.low") == F.col("p"), 0.7).otherwise(0.6).alias("confidence"))
    return exact.unionByName(found)


def refine(entities: DataFrame, library: DataFrame, existing: DataFrame, floor: float = 0.5) -> DataFrame:
    """(s, type) to add: what the label and the hints of an entity resolve to, above the
    floor, that it doesn't have. ``entities``: s, label, hints."""
    probes = entities.select("s", F.explode(F.array_distinct(F.concat(F.array("label"), "hints"))).alias("probe")).filter("probe is not null")
    found = probes.join(lookup(probes.select("probe"), library), "probe").filter(F.col("confidence") >= floor)
    return found.select("s", F.col("uri").alias("type")).distinct().join(existing, ["s", "type"], "left_anti")


# --- vectors -----------------------------------------------------------------------


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / ((F.sqrt(dot(a, a)) + F.lit(1e-12)) * (F.sqrt(dot(b, b)) + F.lit(1e-12)))


def top_cosine(vectors: DataFrame, query: list[float], k: int = 8, restrict_to: DataFrame | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, similarity): the ``k`` nearest to one vector, ties to the smaller key. Only the
    keys that the table ``restrict_to`` has, if it is given. ``nearest.nearest`` takes many."""
    rows = vectors if restrict_to is None else vectors.join(restrict_to.select(key), key, "left_semi")
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(key, F.round(cosine(F.col(vector), q), 6).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def upsert(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return store.join(new.select(key), key, "left_anti").unionByName(new)


def remove(store: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The store without the vectors whose key ``gone`` names."""
    return store.join(gone.select(key), key, "left_anti")


def missing(wanted: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """What has no vector yet, and only that, goes to the embedding service."""
    return wanted.join(store.select(key), key, "left_anti")


def embed(wanted: DataFrame, client, key: str, text: str) -> DataFrame:
    """(key, vec) of texts through an injected client: a callable from a list of texts
    to a list of vectors, sent to the executors."""
    import pandas as pd

    def run(batches):
        for b in batches:
            yield pd.DataFrame({key: b[key], "vec": client(b[text].tolist())})

    return wanted.select(key, text).mapInPandas(run, f"{key} {wanted.schema[key].dataType.simpleString()}, vec array<float>")
