"""Deltas as TriG files, one for each scope and step, written and read by Spark.

A delta's default graph says what it is, and two named graphs hold what a step added and
removed. Files lie under ``batch=<id>/scope=<scope>/seq=<n>``, so that a filter on scope and
step reads no other file. A batch counts once its job has ended and left its mark; what a
job that failed has written is never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.terms import is_literal, lexical, literal
from graphloom.sources.log import SCHEMA, TERMS
from graphloom.sources.turtle import from_turtle

#: The namespace of the words that describe a delta, and further ones used beside it.
VOCABULARY = "urn:graphloom:delta#"
NAMESPACES = {"http://www.w3.org/ns/prov#": "prov", "http://www.w3.org/2001/XMLSchema#": "xsd", "http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf"}
#: Names that Turtle takes after a prefix without escapes.
_SAFE = r"[A-Za-z0-9_](?:[A-Za-z0-9_-]|\.(?=[A-Za-z0-9_]))*"


def shown_term(term: Column, prefixes: dict[str, str]) -> Column:
    """A term as Turtle writes it: a short name where ``prefixes`` (prefix to namespace) has
    its prefix or begins it and the rest is plain, else in full."""

    def name(c: Column) -> Column:
        out = F.concat(F.lit("<"), c, F.lit(">"))
        for prefix, ns in prefixes.items():
            for head in (ns, f"{prefix}:"):
                rest = F.substring(c, len(head) + 1, 1 << 30)
                out = F.when(c.startswith(head) & rest.rlike(f"^{_SAFE}$"), F.concat(F.lit(f"{prefix}:"), rest)).otherwise(out)
        return out

    text = term
    for raw, said in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(said))
    kind = F.regexp_extract(text, r'(?s)"\^\^([^"]*)$', 1)
    typed = F.when(kind != "", F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(kind)), name(kind))).otherwise(text)
    return F.when(is_literal(term), typed).when(term.startswith("_:"), term).otherwise(name(term))


def _graph(side: str) -> Column:
    return F.concat(F.lit("urn:delta/"), F.url_encode("scope"), F.lit("/"), F.col("seq").cast("string"), F.lit(f"/{side}"))


def trig_lines(log: DataFrame, prefixes: dict[str, str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(scope, seq, at, value): the lines of every delta of ``log``, in order by ``at``. A
    delta's step, parent, agent and time are those of its smallest row."""
    names = {**{p: ns for ns, p in NAMESPACES.items()}, **(prefixes or {}), "dlt": vocabulary}
    term = lambda c: shown_term(c if isinstance(c, Column) else F.col(c), names)
    facts = log.groupBy("scope", "seq").agg(F.min(F.struct("parent_seq", "step", "agent", "ts")).alias("f"), F.bool_or(F.col("op") == "removed").alias("both")).select("scope", "seq", "both", "f.*")

    def about(side: str, kind: str) -> Column:
        said = [
            ("rdf:type", F.lit(f"{vocabulary}{kind}")), (f"{vocabulary}scope", F.concat(F.lit("urn:scope/"), F.url_encode("scope"))), (f"{vocabulary}step", literal(F.col("step"))),
            (f"{vocabulary}seq", literal(F.col("seq"), "xsd:integer")), (f"{vocabulary}parentSeq", literal(F.col("parent_seq"), "xsd:integer")), ("prov:wasGeneratedBy", F.col("agent")),
            ("prov:atTime", literal(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), "xsd:dateTime")),
        ]
        lines = F.array(*[F.when(o.isNotNull(), F.concat_ws(" ", term(_graph(side)), term(F.lit(p)), term(o), F.lit("."))) for p, o in said])
        return F.filter(lines, lambda x: x.isNotNull())

    head = F.array(*[F.struct(F.lit(-1).alias("at"), F.lit(f"@prefix {p}: <{ns}> .").alias("value")) for p, ns in names.items()])
    meta = F.concat(about("added", "GraphAddition"), F.when(F.col("both"), about("removed", "GraphRemoval")).otherwise(F.array().cast("array<string>")))
    opened = lambda side: F.concat(F.lit("GRAPH "), term(_graph(side)), F.lit(" {"))
    marks = F.array(F.struct(F.lit(1).alias("at"), opened("added").alias("value")), F.struct(F.lit(3).alias("at"), F.lit("}").alias("value")))
    more = F.array(F.struct(F.lit(4).alias("at"), opened("removed").alias("value")), F.struct(F.lit(6).alias("at"), F.lit("}").alias("value")))
    frame = facts.select("scope", "seq", F.inline(F.concat(head, F.transform(meta, lambda x: F.struct(F.lit(0).alias("at"), x.alias("value"))), marks, F.when(F.col("both"), more).otherwise(F.array().cast("array<struct<at:int,value:string>>")))))
    body = log.select("scope", "seq", F.when(F.col("op") == "removed", 5).otherwise(2).alias("at"), F.concat_ws(" ", term("s"), term("p"), term("o"), F.lit(".")).alias("value"))
    return frame.unionByName(body)


def write_trig(log: DataFrame, path: str, prefixes: dict[str, str] | None = None, vocabulary: str = VOCABULARY) -> str:
    """Write the deltas of ``log`` as a batch, a file each, and return the batch's id. Readers
    see all of it or nothing. A delta is written line by line, however long it is."""
    batch = uuid.uuid4().hex
    lines = trig_lines(log, prefixes, vocabulary).repartition("scope", "seq").sortWithinPartitions("scope", "seq", "at", "value")
    lines.select("scope", "seq", "value").write.partitionBy("scope", "seq").text(f"{path}/batch={batch}")
    return batch


def batches(spark: SparkSession, path: str) -> list[str]:
    """The folders of whole batches. There is one for each call of ``write_trig``, until
    ``compact`` puts them together."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return sorted(str(f.getPath().getParent()) for f in found or [])


def read_trig(spark: SparkSession, path: str, scope: str | None = None, up_to: int | None = None, after: int | None = None, short: dict[str, str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The log of all whole batches: rows as ``sources.log`` has them. ``scope``, ``up_to`` and
    ``after`` choose files before any is opened. A file without a graph of additions, or
    that isn't TriG, is an error that names it. Scope and step are those said in the
    file; files of one scope and step that two batches have count both."""
    folders = batches(spark, path)
    if not folders:
        return spark.createDataFrame([], SCHEMA)
    files = spark.read.schema("value string, batch string, scope string, seq long").option("basePath", path).text(folders, wholetext=True)
    for chosen, bound in ((F.col("scope") == scope, scope), (F.col("seq") <= up_to, up_to), (F.col("seq") > after, after)):
        if bound is not None:
            files = files.filter(chosen)
    return from_trig(files.select(F.col("_metadata.file_path").alias("path"), "value"), short, vocabulary)


def from_trig(files: DataFrame, short: dict[str, str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The log of ``files`` (path, value: a whole delta)."""
    rows = from_turtle(files, {**(short or {}), **NAMESPACES, vocabulary: "dlt"})
    said = rows.filter("graph = ''")
    one = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    graphs = said.groupBy("path", F.col("s").alias("graph")).agg(
        one("rdf:type").alias("kind"), one("dlt:scope").alias("scope"), one("dlt:step").alias("step"), one("dlt:seq").alias("seq"), one("dlt:parentSeq").alias("parent_seq"),
        F.min(F.when((F.col("p") == "prov:wasGeneratedBy") & ~is_literal(F.col("o")), F.col("o"))).alias("agent"), one("prov:atTime").alias("ts"),
    ).filter("kind in ('dlt:GraphAddition', 'dlt:GraphRemoval')")
    number = lambda c: F.coalesce(lexical(F.col(c)).try_cast("long"), F.lit(0)).alias(c)
    own = graphs.select(
        "path", "graph", "kind", F.url_decode(F.regexp_replace("scope", "^urn:scope/", "")).alias("scope"), number("seq"), number("parent_seq"),
        F.coalesce(lexical(F.col("step")), F.lit("")).alias("step"), "agent", lexical(F.col("ts")).try_cast("timestamp").alias("ts"),
    )
    # every file has its additions described, though the graph itself may be empty
    whole = own.groupBy("path").agg(F.bool_or(F.col("kind") == "dlt:GraphAddition").alias("whole"))
    op = F.when(F.col("kind") == "dlt:GraphAddition", "added").otherwise("removed").alias("op")
    held = rows.join(own, ["path", "graph"]).select("path", "scope", "seq", "parent_seq", "step", "agent", "ts", op, *TERMS)
    # from the files' side, so that a file of which nothing is left is looked at too
    each = files.select("path").join(whole, "path", "left").join(held, "path", "left")
    # one condition: a filter on s alone would make the join an inner one, and of an empty one Spark runs neither side
    fine = F.when(F.col("whole"), F.col("s").isNotNull()).otherwise(F.raise_error(F.concat("path", F.lit(": no graph of additions"))).cast("boolean"))
    return each.filter(fine).drop("path", "whole")


def compact(spark: SparkSession, path: str, prefixes: dict[str, str] | None = None, vocabulary: str = VOCABULARY) -> str:
    """All whole batches as one, which is written before the others go."""
    old = batches(spark, path)
    short = {ns: p for p, ns in (prefixes or {}).items()}
    batch = write_trig(read_trig(spark, path, short=short, vocabulary=vocabulary), path, prefixes, vocabulary)
    for folder in old:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    return batch
