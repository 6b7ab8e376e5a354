"""The append-only delta log: one row per triple that a step added or removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "scope string, seq long, parent_seq long, step string, agent string, ts timestamp, op string, s string, p string, o string"
TERMS = ["s", "p", "o"]


def read_log(spark: SparkSession, path: str, scope: str | None = None) -> DataFrame:
    """The log under ``path``; one scope alone is a pruned partition."""
    log = spark.read.schema(SCHEMA).parquet(path)
    return log if scope is None else log.filter(F.col("scope") == scope)


def append(log: DataFrame, path: str, by_scope: bool = True) -> None:
    """Add rows to the log. Many small scopes are better left unpartitioned."""
    writer = log.select(*[f.split()[0] for f in SCHEMA.split(", ")]).write.mode("append")
    (writer.partitionBy("scope") if by_scope else writer).parquet(path)


def step_delta(before: DataFrame, after: DataFrame, scope: str, seq: int, step: str, agent: str | None = None, ts=None) -> DataFrame:
    """The delta from one triple set to another: what was added, what was removed."""
    changes = after.select(TERMS).subtract(before.select(TERMS)).withColumn("op", F.lit("added")).unionByName(
        before.select(TERMS).subtract(after.select(TERMS)).withColumn("op", F.lit("removed"))
    )
    return changes.select(
        F.lit(scope).alias("scope"), F.lit(seq).cast("long").alias("seq"), F.lit(seq - 1).cast("long").alias("parent_seq"), F.lit(step).alias("step"),
        F.lit(agent).cast("string").alias("agent"), F.lit(ts).cast("timestamp").alias("ts"), "op", *TERMS,
    )


def scopes(log: DataFrame) -> DataFrame:
    return log.select("scope").distinct()


# --- N-Triples, the exchange format ------------------------------------------------


def ntriple() -> Column:
    """A row's line of text; line ends and tabs in literals are escaped."""

    def shown(c: str) -> Column:
        term = F.col(c)
        for raw, said in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            term = F.replace(term, F.lit(raw), F.lit(said))
        typed = F.regexp_replace(term, r'"\^\^([^"]*)$', r'"^^<$1>')
        return F.when(term.startswith('"'), typed).when(term.startswith("_:"), term).otherwise(F.concat(F.lit("<"), term, F.lit(">")))

    return F.concat_ws(" ", shown("s"), shown("p"), shown("o"), F.lit("."))


def to_ntriples(triples: DataFrame) -> DataFrame:
    """One line of text per triple."""
    return triples.select(ntriple().alias("value"))


def from_ntriples(lines: DataFrame) -> DataFrame:
    """Triples of text lines (column ``value``). Empty lines and comments are passed
    over; any other line that is no triple is an error."""
    term = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*+"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)'
    pattern = rf"^\s*{term}\s+{term}\s+{term}\s*\.\s*(?:#.*)?$"

    def bare(c: Column) -> Column:
        text = F.regexp_replace(c, r'"\^\^<(.*)>$', r'"^^$1')
        for raw, said in (("\n", "n"), ("\r", "r"), ("\t", "t")):
            # an escape counts only after an even number of backslashes
            text = F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\\" + said, "$1" + raw)
        return F.when(c.startswith('"'), text).otherwise(F.regexp_replace(c, "^<|>$", ""))

    said = lines.filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
    fine = F.when(F.col("value").rlike(pattern), True).otherwise(F.raise_error(F.concat(F.lit("no triple: "), F.substring("value", 1, 200))).cast("boolean"))
    return said.filter(fine).select(*[bare(F.regexp_extract("value", pattern, i)).alias(c) for i, c in enumerate(TERMS, 1)])


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return from_ntriples(spark.read.text(path))
