"""Queries over classes and properties: closure, disjointness, domains and ranges.

An ontology is a triple DataFrame. Transitive work is a loop of joins that doubles
the path length each round, so a chain of n takes log2(n) rounds; circles end it like
anything else, when a round adds nothing.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.terms import datatype, is_literal, local_name

_BLANK = "_:"
#: Names that are sent to all executors at most.
FEW = 100_000


def materialized(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder that the session names."""
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    path = f"{named}/closure-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame, child: str = "child", parent: str = "parent", most_rounds: int = 64) -> DataFrame:
    """(descendant, ancestor) over one hop or more, distinct. A round puts the walks of
    exactly 2^k hops before all paths known, of at most as many: in a tree each further path is made
    once. Paths are written as they are found, not again each round."""
    paths = exact = materialized(edges.select(F.col(child).alias("descendant"), F.col(parent).alias("ancestor")).distinct())
    for _ in range(most_rounds):
        front = exact.select("descendant", F.col("ancestor").alias("mid"))
        over = lambda known: front.join(known.select(F.col("descendant").alias("mid"), "ancestor"), "mid").select("descendant", "ancestor")  # noqa: B023, E731
        fresh = materialized(over(paths).join(paths, ["descendant", "ancestor"], "left_anti").distinct())
        if fresh.isEmpty():
            return paths
        exact = materialized(over(exact).distinct())
        paths = paths.unionByName(fresh)
    raise RuntimeError("the closure did not settle")


def _of(onto: DataFrame, predicate: str) -> DataFrame:
    return onto.filter((F.col("p") == predicate) & ~is_literal(F.col("o")))


def hierarchy(onto: DataFrame, predicate: str = "rdfs:subClassOf") -> DataFrame:
    """The closure of named classes (or, with another predicate, of properties)."""
    named = _of(onto, predicate).filter(~F.col("s").startswith(_BLANK) & ~F.col("o").startswith(_BLANK))
    return closure(named.select(F.col("s").alias("child"), F.col("o").alias("parent")))


def classes(onto: DataFrame) -> DataFrame:
    return onto.filter((F.col("p") == "rdf:type") & (F.col("o") == "owl:Class") & ~F.col("s").startswith(_BLANK)).select(F.col("s").alias("cls")).distinct()


def roots(onto: DataFrame, ns: str = "") -> DataFrame:
    """Classes with no named superclass other than owl:Thing."""
    below = _of(onto, "rdfs:subClassOf").filter(~F.col("o").startswith(_BLANK) & (F.col("o") != "owl:Thing")).select(F.col("s").alias("cls"))
    return classes(onto).filter(F.col("cls").startswith(ns)).join(below, "cls", "left_anti")


def opted_out(onto: DataFrame) -> DataFrame:
    off = F.lower(F.regexp_extract("o", '^"([^"]*)"', 1)).isin("false", "0")
    return onto.filter((F.col("p") == "x:extractable") & off).select(F.col("s").alias("term")).distinct()


def extractable(terms: DataFrame, onto: DataFrame) -> DataFrame:
    return terms.join(opted_out(onto), "term", "left_anti")


def properties(onto: DataFrame) -> DataFrame:
    kinds = ("owl:ObjectProperty", "owl:DatatypeProperty")
    return onto.filter((F.col("p") == "rdf:type") & F.col("o").isin(*kinds)).select(F.col("s").alias("property")).distinct()


def domainless(onto: DataFrame) -> DataFrame:
    """Properties with no domain at all, not even a blank one."""
    return properties(onto).join(onto.filter("p = 'rdfs:domain'").select(F.col("s").alias("property")), "property", "left_anti")


def class_ranged(onto: DataFrame) -> DataFrame:
    """Properties that have ranges, none of them a datatype."""
    data = F.max((F.col("o").startswith("xsd:") | (F.col("o") == "rdfs:Literal")).cast("int"))
    return _of(onto, "rdfs:range").groupBy(F.col("s").alias("property")).agg(data.alias("data")).filter("data = 0").select("property")


def annotations(onto: DataFrame) -> DataFrame:
    """(cls, label, definition): the smallest of several; label else local name."""
    first = lambda p: F.min(F.when(F.col("p") == p, F.regexp_extract("o", '(?s)^"(.*)"[^"]*$', 1)))
    out = onto.groupBy(F.col("s").alias("cls")).agg(first("rdfs:label").alias("l"), first("skos:definition").alias("d"), first("rdfs:comment").alias("c"))
    return out.select("cls", F.coalesce("l", local_name(F.col("cls"))).alias("label"), F.coalesce("d", "c", F.lit("")).alias("definition"))


def inverses(onto: DataFrame) -> DataFrame:
    """(property, inverse), read in both directions; the smallest of several."""
    pairs = _of(onto, "owl:inverseOf").select("s", "o")
    return pairs.unionByName(pairs.select(F.col("o").alias("s"), F.col("s").alias("o"))).groupBy(F.col("s").alias("property")).agg(F.min("o").alias("inverse"))


def declared(onto: DataFrame, predicate: str) -> DataFrame:
    """(property, cls) of rdfs:domain or rdfs:range; where a property has none, the
    inverse's other end."""
    other = {"rdfs:domain": "rdfs:range", "rdfs:range": "rdfs:domain"}[predicate]
    own = _of(onto, predicate).select(F.col("s").alias("property"), F.col("o").alias("cls"))
    back = _of(onto, other).select(F.col("s").alias("inverse"), F.col("o").alias("cls"))
    borrowed = inverses(onto).join(back, "inverse").select("property", "cls").join(own, "property", "left_anti")
    return own.unionByName(borrowed).distinct()


def satisfied(uses: DataFrame, onto: DataFrame, up: DataFrame, predicate: str) -> DataFrame:
    """``uses`` (property, type) with ``ok``: nothing is declared, or one declared class
    is the type or above it."""
    named = _of(onto, predicate).select(F.col("s").alias("property"), F.col("o").alias("cls"))
    above = up.select(F.col("descendant").alias("type"), F.col("ancestor").alias("cls"))
    pairs = uses.select("property", "type").distinct()
    fits = pairs.join(named, "property").filter("type = cls").select("property", "type").unionByName(pairs.join(named, "property").join(above, ["type", "cls"]).select("property", "type")).distinct()
    open_ = pairs.join(named, "property", "left_anti")
    return uses.join(fits.unionByName(open_).withColumn("ok", F.lit(True)), ["property", "type"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))


def disjoint(onto: DataFrame, up: DataFrame) -> DataFrame:
    """(a, b), both ways: declared disjoint, or below a class that is, on either side."""
    pairs = _of(onto, "owl:disjointWith").select(F.col("s").alias("a"), F.col("o").alias("b"))
    members = onto.filter("p = 'owl:members'").select(F.col("s").alias("axiom"), F.col("o").alias("m"))
    right = members.select("axiom", F.col("m").alias("n"))
    listed = members.join(right, "axiom").filter("m <> n").select(F.col("m").alias("a"), F.col("n").alias("b"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(listed).distinct()
    for side, other in (("a", "b"), ("b", "a")):
        lower = both.join(up.select(F.col("ancestor").alias(side), F.col("descendant").alias("low")), side).select(F.col("low").alias(side), other)
        both = both.unionByName(lower.select("a", "b")).distinct()
    return both


def properties_of(types: DataFrame, onto: DataFrame, up: DataFrame) -> DataFrame:
    """(type, property): the domain is the type or above it."""
    domain = _of(onto, "rdfs:domain").select(F.col("o").alias("cls"), F.col("s").alias("property"))
    reach = up.select(F.col("descendant").alias("type"), F.col("ancestor").alias("cls")).unionByName(types.select("type", F.col("type").alias("cls")))
    return types.join(reach, "type").join(domain, "cls").select("type", "property").distinct()


def select_properties(types: DataFrame, onto: DataFrame, up: DataFrame, property_up: DataFrame) -> DataFrame:
    """(type, property) worth asking for: of the type's domain or without domain, not
    opted out; of inverse pairs the one called has..., else the smaller; none that is
    above another one kept."""
    free = materialized(domainless(onto))
    # every type takes every one of them; they are sent round only where they are few
    free = F.broadcast(free) if free.count() <= FEW else free
    every = properties_of(types, onto, up).unionByName(types.crossJoin(free)).distinct()
    kept = every.withColumnRenamed("property", "term").join(opted_out(onto), "term", "left_anti").withColumnRenamed("term", "property")
    pairs = kept.join(inverses(onto), "property", "left")
    partner = kept.select("type", F.col("property").alias("inverse"), F.lit(True).alias("both"))
    has = lambda c: local_name(F.col(c)).startswith("has")
    loses = F.col("both") & (F.col("property") != F.col("inverse")) & F.when(has("property") != has("inverse"), has("inverse")).otherwise(F.col("inverse") < F.col("property"))
    single = pairs.join(partner, ["type", "inverse"], "left").filter(~F.coalesce(loses, F.lit(False))).select("type", "property")
    general = single.join(property_up.select(F.col("descendant").alias("property"), F.col("ancestor").alias("up")), "property").select("type", F.col("up").alias("property"))
    return single.join(general, ["type", "property"], "left_anti")


def most_specific(typed: DataFrame, up: DataFrame) -> DataFrame:
    """(s, type): the smallest of an entity's types with no other of its types below."""
    lower = typed.join(up.select(F.col("descendant").alias("type"), F.col("ancestor").alias("above")), "type").select("s", F.col("above").alias("type"))
    low = typed.join(lower, ["s", "type"], "left_anti")
    return low.withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("type"))).filter("r = 1").drop("r")


def in_scope(typed: DataFrame, covers: DataFrame, up: DataFrame) -> DataFrame:
    """Rows of ``typed`` whose type, or a class above it, a resolver covers (cls)."""
    reach = covers.select(F.col("cls").alias("type")).unionByName(up.join(covers, up["ancestor"] == covers["cls"]).select(F.col("descendant").alias("type"))).distinct()
    return typed.join(reach, "type", "left_semi")


def violations(triples: DataFrame, target: str, constraints: list[tuple[str, int, int | None]]) -> DataFrame:
    """(s, path, n): instances of ``target`` with too few or too many values of a path."""
    mine = triples.join(triples.filter((F.col("p") == "rdf:type") & (F.col("o") == target)).select("s"), "s", "left_semi")
    counts = mine.groupBy("s").agg(*[F.count(F.when(F.col("p") == p, 1)).alias(f"n{i}") for i, (p, _, _) in enumerate(constraints)])
    rows = F.array(*[F.struct(F.lit(p).alias("path"), F.col(f"n{i}").alias("n"), F.lit(lo).alias("lo"), F.lit(hi).cast("int").alias("hi")) for i, (p, lo, hi) in enumerate(constraints)])
    return counts.select("s", F.inline(rows)).filter("n < lo or n > hi").select("s", "path", "n")


def wrong_datatypes(triples: DataFrame, path: str, kind: str) -> DataFrame:
    """(s, path, o): values of a path, of any subject that has it, that aren't literals of
    the datatype; a plain literal is a string."""
    found = F.when(is_literal(F.col("o")), F.coalesce(datatype(F.col("o")), F.lit("xsd:string")))
    return triples.filter((F.col("p") == path) & ~F.coalesce(found == kind, F.lit(False))).select("s", F.col("p").alias("path"), "o")


def wrong_classes(triples: DataFrame, path: str, cls: str, up: DataFrame) -> DataFrame:
    """(s, path, o): values of a path that are of neither the class nor one below it."""
    below = up.filter(F.col("ancestor") == cls).select(F.col("descendant").alias("type")).unionByName(triples.sparkSession.createDataFrame([(cls,)], "type string")).distinct()
    fits = triples.filter("p = 'rdf:type'").select(F.col("s").alias("o"), F.col("o").alias("type")).join(below, "type", "left_semi").select("o").distinct()
    return triples.filter(F.col("p") == path).join(fits, "o", "left_anti").select("s", F.col("p").alias("path"), "o")
