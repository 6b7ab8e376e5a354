"""Documents as files: PDFs in, pages and Markdown out and back, and what is known already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.terms import escape_html, page_body, page_title, strip

# How a Markdown file says its description, stamps and issues.
DESCRIPTION, STAMPS, ISSUES = "> ", "*Stamps / annotations: ", "*Extraction issues: "


# --- PDF ---------------------------------------------------------------------------


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, problem, data): every file under ``path`` that isn't empty (Spark's readers
    pass over files of no bytes); ``data`` is its base64 where nothing is wrong with it,
    else ``problem`` says what is."""
    return check_pdfs(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"))


def check_pdfs(files: DataFrame) -> DataFrame:
    """(path, problem, data) of ``files`` (path, content)."""
    magic = F.lit("%PDF").cast("binary")
    problem = F.when(F.octet_length("content") == 0, "the file is empty").when(F.substring("content", 1, 4) != magic, "not a PDF")
    return files.select("path", problem.alias("problem"), F.when(problem.isNull(), F.base64("content")).alias("data"))


def parse_info(text: Column) -> Column:
    """map of ``key: value`` lines, the last of equal keys; lines without a colon go."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda e: e["k"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda e: e["k"] == k), -1)["v"]
    return F.map_from_arrays(names, F.transform(names, last))


# --- pages and Markdown ------------------------------------------------------------


def page_file(title: Column, language: Column, body: Column, css: str = "") -> Column:
    """A page in full: head with language, title and style; of a body that is a page
    itself only what is in it."""
    said = F.coalesce(F.nullif(strip(language), F.lit("")), F.lit("und"))
    return F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="'), escape_html(said), F.lit('">\n<head>\n<meta charset="UTF-8">\n<title>'), escape_html(F.coalesce(title, F.lit("Document"))),
        F.lit(f"</title>\n<style>\n{css}</style>\n</head>\n<body>\n"), page_body(F.coalesce(body, F.lit(""))), F.lit("\n</body>\n</html>\n"),
    )


def load_pages(files: DataFrame) -> DataFrame:
    """(path, title, html) of page files (path, text): the canonical body; titles come
    from the page, then from the file's name."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return files.select("path", F.coalesce(page_title(F.col("text")), stem).alias("title"), page_body(F.col("text")).alias("html"))


def markdown_file(title: Column, description: Column, markdown: Column, stamps: Column, issues: Column) -> Column:
    """A Markdown file: title, description, text, and footers for stamps and issues."""
    said = lambda c: F.nullif(c, F.lit(""))
    foot = lambda mark, xs: F.concat(F.lit(mark), said(F.array_join(xs, " | ")), F.lit("*"))
    return F.concat_ws("\n\n", F.concat(F.lit("## "), title), F.concat(F.lit(DESCRIPTION), said(description)), markdown, foot(STAMPS, stamps), foot(ISSUES, issues))


def markdown_name(stem: Column, title: Column, part: Column, parts: Column) -> Column:
    """stem.md for a document alone, else stem_docN_title.md."""
    name = F.regexp_replace(F.regexp_replace(title, r"(?U)[^\w\-]", "_"), "^_+|_+$", "")
    return F.when(parts == 1, F.concat(stem, F.lit(".md"))).otherwise(F.concat(stem, F.lit("_doc"), part.cast("string"), F.lit("_"), name, F.lit(".md")))


def _footer(text: Column, mark: str) -> tuple[Column, Column]:
    """The text without its last footer of this mark, and the footer's parts."""
    there = F.regexp_replace(text, r"\s+$", "").endswith("*") & text.contains(mark)
    tail = F.regexp_replace(F.substring_index(text, mark, -1), r"[*\n]+$", "")
    parts = F.transform(F.split(tail, r"\|"), lambda x: strip(x))
    head = F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - F.length(F.substring_index(text, mark, -1)) - len(mark)), r"\s+$", "")
    return F.when(there, head).otherwise(text), F.when(there, parts).otherwise(F.array().cast("array<string>"))


def load_markdown(files: DataFrame) -> DataFrame:
    """(path, title, description, markdown, stamps, issues) of Markdown files (path, text).
    Issues end a file, stamps stand before them; the first second-level heading is the
    title, a quote on the very next line the description."""
    first, issues = _footer(F.col("text"), ISSUES)
    rows = files.select("path", first.alias("_t"), issues.alias("issues"))
    body, stamps = _footer(F.col("_t"), STAMPS)
    rows = rows.select("path", body.alias("markdown"), stamps.alias("stamps"), "issues")
    head = F.regexp_extract("markdown", r"(?m)^## (.*)$", 1)
    quote = F.regexp_extract("markdown", r"(?m)\A(?:(?!## ).*\n)*## .*\n[ \t]*> (.*)$", 1)
    title = F.when(F.col("markdown").rlike(r"(?m)^## "), strip(head)).otherwise("Document")
    return rows.select("path", title.alias("title"), strip(quote).alias("description"), "markdown", "stamps", "issues")


# --- what is known already ---------------------------------------------------------


def to_convert(sources: DataFrame, cached: DataFrame, force: bool = False) -> DataFrame:
    """Sources (slug ...) that no page file is kept of; all of them when forced."""
    return sources if force else sources.join(cached.select("slug"), "slug", "left_anti")


def with_converted(sources: DataFrame, cached: DataFrame, convert, force: bool = False) -> DataFrame:
    """Pages (slug, html): kept ones, and what ``convert`` (DataFrame to DataFrame) makes
    of the other sources. Sources of which nothing comes give no row."""
    fresh = convert(to_convert(sources, cached, force)).select("slug", "html")
    return fresh if force else cached.select("slug", "html").join(sources.select("slug"), "slug", "left_semi").unionByName(fresh)


def probe_key(probe: Column, kind: Column) -> Column:
    """What an answer is kept under: the probe in lower case, behind its kind if it has one."""
    text = F.lower(strip(probe))
    return F.when(kind.isNull(), text).otherwise(F.concat(kind, F.lit("|"), text))


def answered(probes: DataFrame, cache: DataFrame, ask) -> tuple[DataFrame, DataFrame]:
    """``probes`` (probe, kind) with an answer each, and the rows that the cache (key,
    answer) lacked. ``ask`` takes (key, probe, kind), once for each key, and returns
    (key, answer, failed); failures aren't kept."""
    keyed = probes.withColumn("key", probe_key(F.col("probe"), F.col("kind")))
    open_ = keyed.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.min("probe").alias("probe"), F.min("kind").alias("kind"))
    found = ask(open_)
    fresh = found.filter(~F.col("failed")).select("key", "answer")
    return keyed.join(cache.select("key", "answer").unionByName(fresh), "key", "left"), fresh
