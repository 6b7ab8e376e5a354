"""Triples and logs that the relational test tables stand for, by a fixed mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.terms import iri, literal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys to two parts a core: a table that comes in one row group would
    else be one task, however much is made of each row."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)


#: Rows of a table that one part gets.
PART_ROWS = 200_000


def dealt_by_size(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, made of a table of so many ``rows``, dealt by its keys to parts of about
    PART_ROWS of them, two a core at least: what a task holds doesn't grow with the table, and
    what goes on by these keys isn't dealt again."""
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS)), *keys)


def emit(df: DataFrame, subject: Column, *pairs: tuple[str, Column]) -> DataFrame:
    """A triple for each (predicate, object) of each row; null objects give none."""
    rows = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in pairs])
    return df.select(subject.alias("s"), F.inline(rows)).filter(F.col("o").isNotNull())


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, suppliers, nations and regions."""
    c, s, n, r = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation", "region"))
    return (
        emit(c, iri("x:customer/", c.c_custkey), ("rdf:type", F.lit("x:Customer")), ("x:inNation", iri("x:nation/", c.c_nationkey)))
        .unionByName(emit(s, iri("x:supplier/", s.s_suppkey), ("rdf:type", F.lit("x:Supplier")), ("x:inNation", iri("x:nation/", s.s_nationkey))))
        .unionByName(emit(n, iri("x:nation/", n.n_nationkey), ("rdf:type", F.lit("x:Nation")), ("x:inRegion", iri("x:region/", n.n_regionkey)), ("rdfs:label", literal(n.n_name))))
        .unionByName(emit(r, iri("x:region/", r.r_regionkey), ("rdf:type", F.lit("x:Region")), ("rdfs:label", literal(r.r_name))))
    )


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as a quantity datum in pieces, once each. A datum's name tells its
    value, so lines are made one before there are triples: these stay dealt by it."""
    li = table(spark, sf_dir, "lineitem")
    name = iri("x:line/", li.l_orderkey, F.lit("/"), li.l_linenumber, F.lit("/"), li.l_partkey, F.lit("/"), li.l_quantity.cast("int"))
    named = dealt_by_size(li.select(name.alias("datum"), li.l_quantity.cast("int").alias("pieces")).filter("datum is not null"), li.count(), "datum")
    lines = named.groupBy("datum").agg(F.first("pieces").alias("pieces"))
    return emit(
        lines, F.col("datum"), ("rdf:type", F.lit("lis:ScalarQuantityDatum")), ("lis:datumUOM", F.lit("x:piece")), ("lis:datumValue", literal(F.col("pieces"), "xsd:double"))
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and what they hold, dealt by order."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    triples = emit(o, iri("x:order/", o.o_orderkey), ("rdf:type", F.lit("x:Order")), ("x:status", literal(o.o_orderstatus))).unionByName(
        emit(li, iri("x:order/", li.l_orderkey), ("x:holds", iri("x:part/", li.l_partkey)))
    )
    return dealt_by_size(triples, li.count(), "s")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a delta log: a user's scope holds the types of its events; every third
    event removes."""
    e = table(spark, sf_dir, "events")
    return e.select(
        e.user_id.cast("string").alias("scope"), e.event_id.alias("seq"), F.lit(0).cast("long").alias("parent_seq"), F.concat(F.lit("step-"), (e.event_id % 4).cast("string")).alias("step"),
        F.lit(None).cast("string").alias("agent"), e.ts.alias("ts"), F.when(e.event_id % 3 == 0, "removed").otherwise("added").alias("op"),
        iri("x:user/", e.user_id).alias("s"), F.lit("x:did").alias("p"), iri("x:event/", e.event_type).alias("o"),
    )


def part_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent): parts as classes, each under the one with half its number."""
    return table(spark, sf_dir, "part").filter("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent"))
