"""Scalar functions over terms, names and text, as column expressions.

A term is one string: an IRI as it is, a literal in quotes with its datatype or
language behind it. Equal strings are equal terms, so joins compare a single column
and ``"x"`` differs from ``"x"^^xsd:string``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "xsd:"


def iri(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), *[p.cast("string") for p in parts])


def literal(value: Column, datatype: str | None = None, language: str | None = None) -> Column:
    tail = f"^^{datatype}" if datatype else f"@{language}" if language else ""
    escaped = F.replace(F.replace(value.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"' + tail))


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|(?<!\s)\s+\z", "")


def is_literal(term: Column) -> Column:
    return term.startswith('"')


def lexical(term: Column) -> Column:
    """The text of a literal; null for other terms."""
    raw = F.regexp_extract(term, r'(?s)^"(.*)"[^"]*$', 1)
    return F.when(is_literal(term), F.replace(F.replace(raw, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")))


def datatype(term: Column) -> Column:
    return F.when(is_literal(term), F.nullif(F.regexp_extract(term, r'"\^\^([^"]*)$', 1), F.lit("")))


def _dashed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug(text: Column, most: int | None = None, empty: str | Column = "source") -> Column:
    """Lower case, runs of anything else as one dash, no dash at the ends; cut to
    ``most`` characters, after which a dash may end it."""
    out = _dashed(text)
    cut = F.substring(out, 1, most) if most else out
    return F.when(out == "", empty if isinstance(empty, Column) else F.lit(empty)).otherwise(cut)


def entity_slug(text: Column) -> Column:
    return slug(text, 64, F.concat(F.lit("anon-"), F.substring(F.sha1(text), 1, 8)))


def page_slug(text: Column) -> Column:
    return slug(text, 48, "doc")


def class_slug(text: Column) -> Column:
    out = F.regexp_replace(text, "[^A-Za-z0-9]", "")
    return F.when(out == "", "Unnamed").otherwise(out)


def camel_case(text: Column) -> Column:
    """Words joined, first letters raised, the rest as it was; all-capital words stay."""
    words = F.filter(F.split(text, r"[\s_\-./]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def template_slug(uri: Column) -> Column:
    name = local_name(uri)
    return F.lower(F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "-"))


def local_name(uri: Column) -> Column:
    """After the last ``#`` if there is one, else after the last ``/``."""
    return F.when(uri.contains("#"), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(uri, "/", -1))


def local_name_both(uri: Column) -> Column:
    """After the last ``#``, then after the last ``/`` of that."""
    return F.substring_index(F.substring_index(uri, "#", -1), "/", -1)


def local_name_shown(uri: Column) -> Column:
    """After the last ``#``, then after the last ``/`` of that; the whole where nothing
    is left."""
    name = local_name_both(uri)
    return F.when(name == "", uri).otherwise(name)


def qname(uri: Column, prefixes: list[tuple[str, str]]) -> Column:
    """prefix:rest for the longest namespace that begins the IRI, only the rest for the
    empty prefix; the local name where none does. A bare namespace shows as it is."""
    out = local_name_shown(uri)
    for prefix, ns in sorted(prefixes, key=lambda x: len(x[1])):
        if ns:
            rest = F.substring(uri, len(ns) + 1, 1 << 30)
            shown = F.concat(F.lit(prefix + ":"), rest) if prefix else rest
            out = F.when(uri.startswith(ns), F.when(rest == "", uri).otherwise(shown)).otherwise(out)
    return out


def entity_uri(base: str, name: Column) -> Column:
    return F.concat(F.lit(base), entity_slug(name))


def role_uri(base: str, role: Column, activity: Column) -> Column:
    """The role's slug of at most 32 characters, in at most 48 of the activity's name."""
    short = slug(role, 32, F.concat(F.lit("anon-"), F.substring(F.sha1(role), 1, 8)))
    return F.concat(F.lit(base + "role-"), short, F.lit("-in-"), F.substring(F.substring_index(activity, "/", -1), 1, 48))


def scoped_class_uri(prefix: str, scope: Column, name: Column) -> Column:
    """Where a class that one document proposes lives."""
    return F.concat(F.lit(prefix), scope, F.lit("/"), name)


def quality_uri(bearer: Column, name: Column) -> Column:
    return F.concat_ws("/", bearer, name)


def datum_uri(bearer: Column, name: Column) -> Column:
    return F.concat(quality_uri(bearer, name), F.lit("-datum"))


def slot_predicate(template: Column, slot: Column) -> Column:
    return F.concat(F.lit("urn:tpl/"), template, F.lit("/slot/"), slot)


def question_key(template: Column, bindings: Column, slot: Column) -> Column:
    """One string for a question, whatever the order of its bindings (a map)."""
    pairs = F.array_sort(F.transform(F.map_entries(bindings), lambda e: F.concat(json_text(e["key"]), F.lit(":"), json_text(e["value"]))))
    return F.concat_ws("|", template, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")), slot)


def is_literal_range(range_: Column) -> Column:
    return F.coalesce(range_.startswith(XSD) | (range_ == "rdfs:Literal"), F.lit(False))


def namespace(uri: Column) -> Column:
    return F.substring(uri, F.lit(1), F.length(uri) - F.length(local_name(uri)))


def fragment(uri: Column) -> Column:
    """After the last ``#``, trimmed; null where there is none or nothing is left."""
    return F.when(uri.contains("#"), F.nullif(F.trim(F.substring_index(uri, "#", -1)), F.lit("")))


def fragment_uri(document: Column, anchor: Column) -> Column:
    return F.concat(document, F.lit("#"), F.regexp_replace(F.trim(anchor), "^[#\\s]+", ""))


def compact(uri: Column, prefixes: list[tuple[str, str]]) -> Column:
    """prefix:rest for the first namespace that begins the IRI, else <IRI>."""
    out = F.concat(F.lit("<"), uri, F.lit(">"))
    for prefix, ns in reversed(prefixes):
        out = F.when(uri.startswith(ns), F.concat(F.lit(prefix + ":"), F.substring(uri, len(ns) + 1, 1 << 30))).otherwise(out)
    return out


def expand_name(curie: Column, prefixes: dict[str, str]) -> Column:
    """The IRI of prefix:rest; IRIs pass, unknown prefixes give null."""
    table = F.create_map(*[F.lit(x) for pair in prefixes.items() for x in pair])
    known = F.element_at(table, F.substring_index(curie, ":", 1))
    rest = F.substring(curie, F.instr(curie, ":") + 1, F.length(curie))
    return F.when(curie.rlike("^(https?|urn):"), curie).otherwise(F.concat(known, rest))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


#: Entities in the order in which they are decoded; the ampersand comes first.
INLINE_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "))


def inline_text(text: Column) -> Column:
    for a, b in INLINE_ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(text, r"\s+", " ")


def query_escape(text: Column, most: int = 200) -> Column:
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    out = F.regexp_replace(out, r"[\x00-\x1f\x7f]", "")
    return F.substring(F.replace(F.replace(out, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), 1, most)


def shown_literal(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit('"'), F.lit("'")), F.lit("\n"), F.lit(" "))
    return F.when(F.length(out) > 80, F.concat(F.substring(out, 1, 77), F.lit("..."))).otherwise(out)


def page_title(html: Column) -> Column:
    """The title, else the first heading, without tags; null when neither says anything."""
    clean = lambda x: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", ""), r"\s+", " ")), F.lit(""))
    return F.coalesce(clean(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), clean(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)))


def page_body(html: Column) -> Column:
    inner = F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)</body>", 1)
    return F.when(html.rlike(r"(?is)<body[^>]*>.*?</body>"), strip(inner)).otherwise(strip(html))


def anchor_marker(element: Column, css: Column) -> Column:
    """`` {#id .class-N}``; empty without either."""
    group = F.nullif(F.regexp_extract(F.coalesce(css, F.lit("")), r"(?:^|\s)(class-\S*)", 1), F.lit(""))
    inner = F.concat_ws(" ", F.concat(F.lit("#"), element), F.concat(F.lit("."), group))
    return F.when(inner == "", "").otherwise(F.concat(F.lit(" {"), inner, F.lit("}")))


def coerce(value: Column, kind: Column) -> Column:
    """A literal typed as ``kind`` where the value parses as that, else a plain one."""
    v = F.trim(value)
    fits = (
        F.when(kind.isin("xsd:integer", "xsd:nonNegativeInteger"), v.rlike(r"^[+-]?[0-9]+$"))
        .when(kind == "xsd:double", v.try_cast("double").isNotNull())
        .when(kind == "xsd:boolean", F.lower(v).isin("true", "false", "1", "0", "yes", "no"))
        .when(kind.isin("xsd:date", "xsd:dateTime", "xsd:decimal"), F.lit(True))
        .otherwise(False)
    )
    return F.concat(literal(value), F.when(F.coalesce(fits, F.lit(False)), F.concat(F.lit("^^"), kind)).otherwise(""))


def json_object(text: Column) -> Column:
    """From the first ``{`` to the last ``}``, code fences and escapes JSON lacks gone."""
    bare = F.regexp_replace(text, r"(?m)^```[a-z]*\s*$", "")
    body = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.nullif(F.regexp_replace(body, r'\\(?!["\\/bfnrtu])', ""), F.lit(""))


def json_text(text: Column) -> Column:
    """A string as JSON in ASCII: quotes and backslashes escaped, all else that isn't
    printable ASCII as UTF-16 units."""
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 34: '\\"', 92: "\\\\"}

    def unit(h: Column) -> Column:
        code = F.conv(h, 16, 10).cast("int")
        out = F.when(code.between(32, 126), F.char(code)).otherwise(F.concat(F.lit("\\u"), F.lower(h)))
        for k, v in short.items():
            out = F.when(code == k, F.lit(v)).otherwise(out)
        return out

    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), 1)
    slow = F.array_join(F.transform(units, unit), "")
    return F.concat(F.lit('"'), F.when(text.rlike(r"[^\x20-\x7e]"), slow).otherwise(plain), F.lit('"'))


def binding_hash(template: str, slots: dict[str, Column], many: set[str] = frozenset(), lists: bool = True) -> Column:
    """16 hex digits of the hash of a template's bindings in canonical JSON: keys sorted,
    each value a list of the terms' texts, empty where a slot has none. Slots in ``many``
    are arrays, whose order counts. Without ``lists`` each value is one text."""
    said = lambda c: json_text(F.coalesce(lexical(c), c))
    entries = []
    for name in sorted(slots):
        if entries:
            entries.append(F.lit(", "))
        inner = F.array_join(F.transform(slots[name], said), ", ") if name in many else said(slots[name])
        entries += [F.lit(f'"{name}": ' + "[" * lists), F.coalesce(inner, F.lit("" if lists else "null")), F.lit("]" * lists)]
    return F.substring(F.sha2(F.concat(F.lit(template + "|{"), *entries, F.lit("}")), 256), 1, 16)


def scope_uri(kind: Column, name: Column) -> Column:
    return F.concat_ws("/", F.lit("urn:graph"), kind, name)


def scope_of(uri: Column) -> Column:
    """struct(kind, name) of a scope URI; kind ``unknown`` for others."""
    fits = uri.rlike("^urn:graph/(doc|project|rdl)/")
    parts = F.split(uri, "/", 3)
    return F.struct(F.when(fits, parts[1]).otherwise("unknown").alias("kind"), F.when(fits, parts[2]).otherwise(uri).alias("name"))
