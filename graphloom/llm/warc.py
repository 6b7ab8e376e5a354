"""Derivative records of web archives: metadata and plain-text conversions.

For every response record two records are derived, a ``metadata`` and a
``conversion``. Both refer to the response by its record id and carry its target
URI, date, source headers and payload digest; each has an id of its own, made from
the response's, and the digest and length of its own block. Building the same
archive again gives the same records. Expressions only; nothing is shuffled.
"""

from __future__ import annotations

import html.entities
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_or_empty

_CRLF = "\r\n"
#: What is taken out of a page with its contents: to its end, or to the page's where it has
#: none; a head ends where the body or another head begins. Every pattern here stops at the next
#: ``<`` or takes what it has passed, so that no part of a page is gone over again and again.
DROPPED = r"(?is)<(?:!--.*?(?:-->|\z)|script\b.*?(?:</script\s*+>|\z)|style\b.*?(?:</style\s*+>|\z)|head\b[^<]*+(?:<(?!/head|body\b|head\b)[^<]*+)*+(?:</head\s*+>)?)"
#: The rest of a tag: a quoted value may hold ``>``. Tags with thousands of ``=`` are text.
_REST = r"""[^<>=]*+(?:=\s*+(?:"[^"<]*+"|'[^'<]*+')?+[^<>=]*+){0,2000}+>"""
#: What starts a new line.
BREAKS = r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|nav|section|header|footer|blockquote|body|html|title)\b" + _REST
TAGS = r"<[!/A-Za-z]" + _REST
#: A reference to a character, by number or by one of HTML's names.
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
NAMED = {f"&{name};": chr(code) for name, code in html.entities.name2codepoint.items()} | {"&apos;": "'", "&nbsp;": " "}


def decoded(text: Column) -> Column:
    """Character references as characters, each once; unknown names stay. Numbers that stand
    for no character are the replacement character."""
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def one(piece: Column) -> Column:
        hexed, digits = piece.rlike("^&#[xX]"), F.regexp_replace(piece, "[^0-9A-Fa-f]", "")
        code = F.when(hexed, F.conv(digits, 16, 10)).otherwise(digits).cast("int")
        bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        # a character from its UTF-32 bytes
        char = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")
        number = F.when(bad, F.lit("�")).when(code == 160, " ").otherwise(char)
        return F.when(piece.startswith("&#"), number).otherwise(F.coalesce(names[piece], piece))

    pieces = F.regexp_extract_all(text, F.lit(f"{ENTITY}|[^&]++|&"), 0)
    walk = F.array_join(F.transform(pieces, lambda p: F.when(F.length(p) > 2, F.when(p.startswith("&"), one(p)).otherwise(p)).otherwise(p)), "")
    return F.when(text.contains("&"), walk).otherwise(text)


def record_id(*parts: Column) -> Column:
    """<urn:uuid:...> from a hash of the parts."""
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def plain_text(page: Column) -> Column:
    """The text of a page: scripts, styles, head and comments go, to the page's end where
    they aren't closed; block elements end lines, references to characters are decoded once,
    white space collapses, empty lines vanish. Time grows with the page's length."""
    out = F.regexp_replace(page, DROPPED, " ")
    out = decoded(F.regexp_replace(F.regexp_replace(out, BREAKS, "\n"), TAGS, ""))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(out, r"^[ \n]+|[ \n]+$", "")


def as_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Response records of fetched pages: record_id, type, target_uri, date,
    http_headers, payload, payload_digest. Null addresses and bodies count as empty."""
    body = text_or_empty(html)
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(_CRLF)
    )
    name = record_id(F.lit("response"), F.coalesce(F.col(key).cast("string"), F.lit("")), text_or_empty(url))
    return pages.select(
        F.col(key).alias("page_id"), name.alias("record_id"), F.lit("response").alias("type"), text_or_empty(url).alias("target_uri"), F.lit(date).alias("date"),
        head.alias("http_headers"), body.alias("payload"), digest(body).alias("payload_digest"),
    )


def derive(responses: DataFrame) -> DataFrame:
    """Two rows per response: record_id, type, refers_to, target_uri, date,
    content_type, source_headers, source_digest, block, block_digest, content_length.

    Records of other types give none. Null payloads count as empty and give an empty
    conversion. Repeated responses give repeated records, with equal ids.
    """
    payload = text_or_empty("payload")
    title = F.trim(F.regexp_replace(F.regexp_extract(payload, r"(?is)<title\b[^<>]*+>((?:(?!</title|<title\b).)*+)</title", 1), r"\s+", " "))
    language = F.regexp_extract(payload, r"(?is)<html\b[^<>]*?\blang=[\"']?([A-Za-z-]+)", 1)
    links = F.regexp_count(payload, F.lit(r"(?i)<a\b[^<>]*?\bhref="))
    text = plain_text(payload)
    fields = F.concat_ws(
        _CRLF,
        F.concat(F.lit("title: "), title), F.concat(F.lit("languages: "), language), F.concat(F.lit("outlinks: "), links.cast("string")),
        F.concat(F.lit("text-length: "), F.length("_text").cast("string")), F.lit(""),
    )
    source = responses.filter(F.col("type") == "response").withColumn("_text", text).withColumn("_fields", fields)
    kinds = [("conversion", "text/plain", "_text"), ("metadata", "application/warc-fields", "_fields")]
    made = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(c).alias("content_type"), F.col(b).alias("block")) for t, c, b in kinds])
    return source.select("page_id", "record_id", "target_uri", "date", "http_headers", "payload_digest", F.explode(made).alias("r")).select(
        "page_id", record_id(F.col("r.type"), F.col("record_id")).alias("record_id"), F.col("r.type").alias("type"), F.col("record_id").alias("refers_to"),
        "target_uri", "date", F.col("r.content_type").alias("content_type"), F.col("http_headers").alias("source_headers"),
        F.col("payload_digest").alias("source_digest"), F.col("r.block").alias("block"), digest(F.col("r.block")).alias("block_digest"),
        F.octet_length(F.col("r.block")).cast("long").alias("content_length"),
    )


def to_warc(records: DataFrame) -> DataFrame:
    """``derive``'s rows with ``warc``: the record as it stands in a file."""
    lines = [
        ("WARC-Type", "type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"),
        ("WARC-Block-Digest", "block_digest"), ("WARC-Refers-To-Payload-Digest", "source_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    ]
    head = F.concat_ws(_CRLF, F.lit("WARC/1.1"), *[F.concat(F.lit(f"{n}: "), F.col(c).cast("string")) for n, c in lines])
    source = F.regexp_replace(F.regexp_replace("source_headers", r"\r\n$", ""), r"(?m)^", "WARC-Source-Header: ")
    return records.withColumn("warc", F.concat(head, F.lit(_CRLF), source, F.lit(_CRLF * 2), F.col("block"), F.lit(_CRLF * 2)))


def parse(raw: bytes) -> list[dict]:
    """Records of a WARC file's bytes: headers (repeated ones joined by a line feed)
    and ``block``."""
    out, at = [], 0
    while match := re.compile(rb"WARC/1\.[01]\r\n").match(raw, at):
        end = raw.index(b"\r\n\r\n", at)
        record: dict = {}
        for line in raw[match.end() : end].split(b"\r\n"):
            name, _, value = line.decode("utf-8").partition(": ")
            record[name] = f"{record[name]}\n{value}" if name in record else value
        size = int(record["Content-Length"])
        record["block"] = raw[end + 4 : end + 4 + size]
        out.append(record)
        at = end + 4 + size + 4
    return out
