"""Rows to triples: facts of files and conversions, entities, quality chains."""

from __future__ import annotations

import base64
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.terms import literal


def _t(s: Column, p: str, o: Column) -> Column:
    return F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))


def scalar_quality(bearer: Column, name: str, value: Column, unit: str, link: str = "lis:hasQuality") -> Column:
    """The seven triples from a bearer over a quality to a number with its unit."""
    q, d = F.concat(bearer, F.lit(f"-{name}")), F.concat(bearer, F.lit(f"-{name}-datum"))
    return F.array(
        _t(bearer, link, q), _t(q, "rdf:type", F.lit("lis:Quality")), _t(q, "rdf:type", F.lit(f"x:{name}")), _t(q, "lis:qualityQuantifiedAs", d),
        _t(d, "rdf:type", F.lit("lis:ScalarQuantityDatum")), _t(d, "lis:datumUOM", F.lit(unit)), _t(d, "lis:datumValue", literal(value, "xsd:double")),
    )


def nominal_quality(bearer: Column, name: str, value: Column) -> Column:
    """The six triples to a plain value."""
    q, d = F.concat(bearer, F.lit(f"-{name}")), F.concat(bearer, F.lit(f"-{name}-datum"))
    return F.array(
        _t(bearer, "lis:hasQuality", q), _t(q, "rdf:type", F.lit("lis:Quality")), _t(q, "rdf:type", F.lit(f"x:{name}")), _t(q, "lis:qualityQuantifiedAs", d),
        _t(d, "rdf:type", F.lit("lis:QuantityDatum")), _t(d, "lis:datumValue", literal(value)),
    )


def triples_of(df: DataFrame, *arrays: Column) -> DataFrame:
    return df.select(F.inline(F.concat(*arrays))).filter("o is not null").distinct()


def recognized_files(files: DataFrame) -> DataFrame:
    """Triples of files (uri, path, size, hash, mime, title, author, producer, pages):
    type, qualities, maker (author else producer), pages only where they are a number."""
    u, pages = F.col("uri"), F.col("pages").try_cast("int")
    maker = F.coalesce(F.nullif(F.trim("author"), F.lit("")), F.nullif(F.trim("producer"), F.lit("")))
    facts = F.array(_t(u, "rdf:type", F.lit("x:File")), _t(u, "rdfs:label", literal(F.col("title"))), _t(u, "x:createdBy", literal(maker)))
    chain = F.when(pages.isNotNull(), scalar_quality(u, "PageCount", pages, "x:page")).otherwise(F.array().cast("array<struct<s:string,p:string,o:string>>"))
    return triples_of(files, facts, scalar_quality(u, "FileSize", F.col("size"), "x:byte"), *[nominal_quality(u, n, F.col(c)) for n, c in (("FilePath", "path"), ("FileHash", "hash"), ("MimeType", "mime"))], chain)


def converted_files(files: DataFrame) -> DataFrame:
    """Triples of conversions (uri, html_uri, markdown_uri, label, started, ended): an
    activity only where both times are known."""
    u, h, m = F.col("uri"), F.col("html_uri"), F.col("markdown_uri")
    act = F.when(F.col("started").isNotNull() & F.col("ended").isNotNull(), F.concat(h, F.lit("-conversion")))
    facts = F.array(
        _t(h, "rdf:type", F.lit("x:HtmlFile")), _t(h, "rdfs:label", literal(F.col("label"))), _t(h, "prov:wasDerivedFrom", u), _t(m, "rdf:type", F.lit("x:MarkdownFile")), _t(m, "prov:wasDerivedFrom", h),
        _t(act, "rdf:type", F.lit("prov:Activity")), _t(act, "prov:startedAtTime", literal(F.col("started"), "xsd:dateTime")), _t(act, "prov:endedAtTime", literal(F.col("ended"), "xsd:dateTime")), _t(act, "prov:used", u),
    )
    return files.select(F.inline(facts)).filter("s is not null and o is not null").distinct()


def entities(rows: DataFrame) -> DataFrame:
    """Triples of entities (uri, label, types, fragments): a type, label and
    representation each."""
    u = F.col("uri")
    return triples_of(
        rows, F.transform("types", lambda t: _t(u, "rdf:type", t)), F.array(_t(u, "rdfs:label", literal(F.col("label")))), F.transform("fragments", lambda f: _t(u, "lis:representedBy", f))
    )


def diagram(triples: DataFrame) -> DataFrame:
    """(s, text): a node of an object diagram per subject, its literals and types within
    and an arrow for each object; noise (labels, provenance, plain anchors) left out."""
    shown = triples.filter(~F.col("p").rlike("^(rdfs|prov):") & ~((F.col("p") == "lis:representedBy") & F.col("o").rlike(r"#(id|class)-\d+$")))
    part = lambda cond, text: F.array_join(F.array_sort(F.collect_set(F.when(cond, text))), "\n")
    lit = F.col("o").startswith('"')
    kinds, members, arrows = (
        part(F.col("p") == "rdf:type", F.concat(F.lit("<<"), "o", F.lit(">>"))), part(lit, F.concat("p", F.lit(" = "), "o")),
        part(~lit & (F.col("p") != "rdf:type"), F.concat("s", F.lit(" --> "), "o", F.lit(" : "), "p")),
    )
    return shown.groupBy("s").agg(F.concat(F.lit("object "), F.col("s"), F.lit(" "), kinds, F.lit(" {\n"), members, F.lit("\n}\n"), arrows).alias("text"))


# Fixed value: the alphabet in which a diagram's text goes into an address, 6 bits each.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_"
_FROM_BASE64 = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", ALPHABET)


def diagram_code(text: str) -> str:
    """A text deflated without header, in that alphabet; the last group filled with zeros."""
    raw = zlib.compress(text.encode())[2:-4]
    return base64.b64encode(raw + bytes(-len(raw) % 3)).decode().translate(_FROM_BASE64)


def with_diagram_code(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``code``, by which a diagram server is asked for the picture; null
    texts have none."""

    @F.pandas_udf("string")
    def code(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else diagram_code(t))

    return rows.withColumn("code", code(text))
