"""HTML documents: tags, anchors, a Markdown view, annotation.

A page is a run of tags and texts, told apart by one pattern; comments, doctypes and
scripts' contents are text. What needs a stack runs as Arrow-batched Python, a page at
a time; the rest is expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a task gathers before it hands them on.
ROWS = 2_000
# What counts as a tag and as an attribute.
TAG = r"<\s*(/?)([a-zA-Z][a-zA-Z0-9]*)\s*([^>]*)>"
ATTRIBUTE = r"\b%s\s*=\s*(['\"])(.*?)\1"
GROUP = r"\bclass-\d+\b"
_TAG = re.compile(TAG, re.DOTALL)
_ATTR = {name: re.compile(ATTRIBUTE % name) for name in ("id", "data-note", "class")}
_GROUP = re.compile(GROUP)
_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "))


def open_tags(html: Column) -> Column:
    """Names of a page's opening tags, in order, lower case."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"<\s*([a-zA-Z][a-zA-Z0-9]*)[^>]*>"), 1), F.lower)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*\bhref="([^"]*)"'), 1)


def tokens(html: str) -> Iterator[tuple[str, str, dict]]:
    """(kind, tag or text, attributes); kind is text, open, close or self."""
    at = 0
    for m in _TAG.finditer(html):
        if m.start() > at:
            yield "text", html[at : m.start()], {}
        at = m.end()
        rest = m[3] or ""
        kind = "close" if m[1] else "self" if rest.rstrip().endswith("/") else "open"
        yield kind, m[2].lower(), {n: hit[2] for n, rx in _ATTR.items() if (hit := rx.search(rest))}
    if at < len(html):
        yield "text", html[at:], {}


def inventory(html: str, most: int = 80) -> list[dict]:
    """The elements that have an id: text of all they hold (white space collapsed, cut
    at ``most``), class-N, the nearest note around them, tag. A closing tag ends an
    element or note only where that is the innermost one."""
    units: list[dict] = []
    texts: dict[str, list[str]] = {}
    notes: list[tuple[str, str]] = []
    inside: list[tuple[str, str]] = []
    for kind, value, attrs in tokens(html):
        if kind == "text":
            for _, name in inside:
                texts[name].append(value)
        elif kind == "close":
            for stack in (notes, inside):
                if stack and stack[-1][0] == value:
                    stack.pop()
        else:
            if "data-note" in attrs:
                notes.append((value, attrs["data-note"]))
            if "id" not in attrs:
                continue
            group = _GROUP.search(attrs.get("class", ""))
            units.append({"id": attrs["id"], "css_class": group[0] if group else None, "section": notes[-1][1] if notes else None, "tag": value})
            texts[attrs["id"]] = []
            if kind == "open":
                inside.append((value, attrs["id"]))
    # what follows the last tag belongs to nothing
    for u in units:
        whole = re.sub(r"\s+", " ", "".join(texts[u["id"]])).strip()
        u["text"] = whole if len(whole) <= most else whole[:most] + "…"
    return units


def inventory_rows(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, id, text, css_class, section, tag), a row per element with an id. A task
    holds the rows of a few pages, not those of a whole batch."""
    frame = lambda rows: pd.DataFrame(rows, columns=[key, "pos", "id", "text", "css_class", "section", "tag"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for k, h in zip(b[key], b[html]):
                rows += [(k, i, u["id"], u["text"], u["css_class"], u["section"], u["tag"]) for i, u in enumerate(inventory(h or ""))]
                if len(rows) >= ROWS:
                    yield frame(rows)
                    rows = []
            yield frame(rows)

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, pos int, id string, text string, css_class string, section string, tag string")


def _inline(text: str) -> str:
    for a, b in _ENTITIES:
        text = text.replace(a, b)
    return re.sub(r"\s+", " ", text)


def _marker(attrs: dict) -> str:
    group = next((t for t in attrs.get("class", "").split() if t.startswith("class-")), None)
    parts = ["#" + attrs["id"]] if attrs.get("id") else []
    parts += ["." + group] if group else []
    return " {" + " ".join(parts) + "}" if parts else ""


#: What a tag writes when it opens, and when it closes (after its anchor, if True).
_OPENS = {**{f"h{n}": "\n\n" + "#" * n + " " for n in range(1, 7)}, "p": "\n\n", "blockquote": "\n\n> ", "table": "\n\n", "br": "  \n"}
_CLOSES = {**{f"h{n}": (True, "\n") for n in range(1, 7)}, "p": (True, "\n"), "blockquote": (True, "\n"), "li": (True, ""), "span": (True, ""), "em": (False, "*"), "strong": (False, "**"), "code": (False, "`")}


def markdown(html: str) -> str:
    """A page as Markdown with anchors: headings, paragraphs, quotes, nested lists,
    table rows without a rule, notes of overlays. Unknown tags pass their text on."""
    out: list[str] = []
    lists: list[list] = []  # [kind, next number]
    row: list[list] | None = None  # cells: [text, attributes]
    table = False
    pending: list[tuple[str, dict]] = []

    def put(text: str) -> None:
        if table and row:
            row[-1][0] += text
        else:
            out.append(text)

    for kind, value, attrs in tokens(html):
        if kind == "text":
            if not table or row:
                put(_inline(value))
            continue
        tag = value
        if kind != "close":
            if kind == "open":
                pending.append((tag, attrs))
            if tag == "div":
                if attrs.get("data-note") or attrs.get("id"):
                    out.append(f"\n\n[OVERLAY: {attrs.get('data-note') or 'overlay'}]{_marker(attrs)}")
            elif tag in ("ul", "ol"):
                lists.append([tag, 1])
                out.append("\n\n")
            elif tag == "li":
                pad = "  " * (len(lists) - 1)
                if lists and lists[-1][0] == "ol":
                    out.append(f"\n{pad}{lists[-1][1]}. ")
                    lists[-1][1] += 1
                else:
                    out.append(f"\n{pad}- ")
            elif tag == "tr":
                row = []
            elif tag in ("td", "th"):
                row = [*(row or []), ["", attrs]]
            elif tag in _OPENS:
                table = table or tag == "table"
                out.append(_OPENS[tag])
        if kind != "open":
            if kind == "close":
                at = next((i for i in range(len(pending) - 1, -1, -1) if pending[i][0] == tag), None)
                attrs = pending.pop(at)[1] if at is not None else {}
            if tag == "div":
                out.append("\n")
            elif tag in ("ul", "ol"):
                if lists:
                    lists.pop()
                out.append("\n")
            elif tag == "table":
                table = False
                out.append("\n")
            elif tag == "tr":
                out.append("\n| " + " | ".join(text + _marker(a) for text, a in row or []) + " |")
                row = []
            elif tag in _CLOSES:
                marked, text = _CLOSES[tag]
                if tag in ("em", "strong", "code", "span"):
                    put((_marker(attrs) if marked else "") + text)
                else:
                    out.append(_marker(attrs) + text)
    lines = [line.rstrip() for line in "".join(out).split("\n")]
    kept = [x for i, x in enumerate(lines) if x or i == 0 or lines[i - 1]]
    return "\n".join(kept).strip() + "\n"


def markdown_view(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "markdown": [markdown(h or "") for h in b[html]]})

    return pages.select(key, html).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, markdown string")


def join_documents(parts: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """The parts of a group in order, a rule between them."""
    rows = F.array_sort(F.collect_list(F.struct(order, text)))
    return parts.groupBy(group).agg(F.array_join(F.transform(rows, lambda r: r[text]), "\n\n---\n\n").alias(text))


def annotate(pages: DataFrame, entities: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Pages with data-entity, -label and -types in the tags that entities stand on.
    ``entities``: key, id, uri, label, types; the first of several (by uri) counts."""
    by_page = entities.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", "uri", "label", "types"))).alias("es"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attr = lambda t: (t or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
        for b in batches:
            out = []
            for h, es in zip(b[html], b["es"]):
                known: dict = {}
                for e in es if es is not None else ():
                    known.setdefault(e["id"], e)

                def mark(m: re.Match) -> str:
                    hit = _ATTR["id"].search(m[3] or "")
                    e = known.get(hit[2]) if hit and not m[1] else None
                    return m[0] if e is None else f'{m[0][:-1]} data-entity="{attr(e["uri"])}" data-label="{attr(e["label"])}" data-types="{attr(e["types"])}">'

                out.append(_TAG.sub(mark, h or ""))
            yield pd.DataFrame({key: b[key], html: out})

    return pages.select(key, html).join(by_page, key, "left").mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, {html} string")


# --- citations and coverage --------------------------------------------------------


def citations(triples: DataFrame) -> DataFrame:
    """(fragment): what lis:representedBy points to, after the last #."""
    part = F.trim(F.substring_index("o", "#", -1))
    return triples.filter((F.col("p") == "lis:representedBy") & ~F.col("o").startswith('"') & F.col("o").contains("#")).select(part.alias("fragment")).filter("fragment <> ''").distinct()


def coverage(units: DataFrame, cited: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Units (id, css_class) with ``covered``: cited themselves or through their class.
    ``by`` names columns that part units and citations into documents."""
    by = by or []
    own = cited.select(*by, F.col("fragment").alias("id"), F.lit(True).alias("a")).distinct()
    group = cited.select(*by, F.col("fragment").alias("css_class"), F.lit(True).alias("b")).distinct()
    return units.join(own, [*by, "id"], "left").join(group, [*by, "css_class"], "left").withColumn("covered", F.coalesce("a", "b", F.lit(False))).drop("a", "b")


def coverage_totals(covered: DataFrame, by: list[str]) -> DataFrame:
    n = F.count(F.lit(1))
    hit = F.count(F.when(F.col("covered"), 1))
    return covered.groupBy(*by).agg(n.alias("total"), hit.alias("covered"), F.round(100.0 * hit / n, 4).alias("percent"))


def collapse(members: DataFrame, cited: DataFrame) -> DataFrame:
    """Citations in short: a class (cls) whose members (id) are all cited stands for
    them; members of other classes, and ids without a class, stand for themselves."""
    named = members.select("cls", "id").distinct()
    have = named.join(cited.select("id").distinct().withColumn("hit", F.lit(1)), "id", "left")
    full = have.groupBy("cls").agg((F.count("hit") == F.count(F.lit(1))).alias("whole"))
    split = have.filter("hit = 1").join(full, "cls")
    loose = cited.select("id").distinct().join(named, "id", "left_anti")
    return (
        split.select(F.when(F.col("whole"), F.col("cls")).otherwise(F.col("id")).alias("fragment")).unionByName(loose.select(F.col("id").alias("fragment"))).distinct()
    )


def entity_index(triples: DataFrame) -> DataFrame:
    """(fragment, s, label, types): entities by what they are represented by; the
    smallest label, else the local name; types sorted."""
    shown = triples.filter("p = 'lis:representedBy'").filter(F.col("o").contains("#")).select("s", F.substring_index("o", "#", -1).alias("fragment")).distinct()
    facts = triples.groupBy("s").agg(
        F.min(F.when(F.col("p") == "rdfs:label", F.regexp_extract("o", '(?s)^"(.*)"[^"]*$', 1))).alias("label"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("p") == "rdf:type", F.col("o")))), " ").alias("types"),
    )
    return shown.join(facts, "s").select("fragment", "s", F.coalesce("label", F.substring_index("s", "/", -1)).alias("label"), "types")
