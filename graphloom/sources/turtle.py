"""Turtle and TriG files as rows (graph, s, p, o).

A file is one row of text and is parsed on an executor; files are many and small, so
they are dealt to tasks by path. Names are resolved to IRIs; ``short`` names them back where
the engine's own prefixes are wanted.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.mapping import dealt

#: Rows that a task gathers from small files before it hands them on.
ROWS = 20_000
_RDF, _XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"
_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)"""
    r'''|(?P<text>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^'\\]|\\.|'(?!''))*\'\'\'|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')'''
    r"""|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<blank>_:[\w][\w.-]*(?<!\.))"""
    r"""|(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))"""
    r"""|(?P<name>[\w][\w.-]*(?<!\.):(?:[\w:%-]|\.(?=[\w:%.-])|\\.)*|:(?:[\w:%-]|\.(?=[\w:%.-])|\\.)*)|(?P<word>[A-Za-z]+)|(?P<mark>[.;,\[\](){}])""",
    re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_SCHEME = re.compile("[A-Za-z][A-Za-z0-9+.-]*:")
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def _unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _PLAIN.get(m[1], m[1]), text)


def _quoted(text: str, tail: str = "") -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"' + tail


def _joined(base: str, uri: str) -> str:
    """``urljoin``, which leaves a name of another scheme than the base's as it is."""
    scheme = _SCHEME.match(uri)
    if scheme and uri.isascii() and "[" not in uri and "]" not in uri and not base.lower().startswith(scheme[0].lower()):
        return uri
    return urljoin(base, uri)


class _Parser:
    def __init__(self, text: str, base: str, short: dict[str, str]):
        self.base, self.short, self.prefixes, self.graph = base, short, {}, ""
        self.rows: list[tuple[str, str, str, str]] = []
        self.fresh, self.at, self.tokens = itertools.count(), 0, []
        self.known: dict[str, str] = {}
        place = 0
        for m in _TOKEN.finditer(text):
            if m.start() != place:
                break
            place = m.end()
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
        if place < len(text):
            raise ValueError(f"not Turtle at character {place}: {text[place : place + 40]!r}")
        self.tokens.append(("end", ""))

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def take(self, what: str | None = None) -> tuple[str, str]:
        kind, text = self.tokens[self.at]
        if kind == "end" or what is not None and text != what:
            raise ValueError(f"{what or 'more'} expected, not {text or 'the end'!r}")
        self.at += 1
        return kind, text

    def blank(self) -> str:
        return f"_:anon{next(self.fresh)}"

    def named(self, uri: str) -> str:
        for ns, prefix in self.short.items():
            if uri.startswith(ns):
                return f"{prefix}:{uri[len(ns) :]}"
        return uri

    def iri(self, kind: str, text: str) -> str:
        """``known`` has what was named since a base or prefix was last set."""
        found = self.known.get(text)
        if found is not None:
            return found
        if kind == "iri":
            found = self.named(_joined(self.base, text[1:-1]))
        else:
            prefix, _, rest = text.partition(":")
            if kind != "name" or prefix not in self.prefixes:
                raise ValueError(f"a name was expected, not {text!r}")
            found = self.named(self.prefixes[prefix] + (re.sub(r"\\(.)", r"\1", rest) if "\\" in rest else rest))
        self.known[text] = found
        return found

    def term(self) -> str:
        kind, text = self.take()
        if kind in ("iri", "name"):
            return self.iri(kind, text)
        if kind == "blank":
            return text
        if text == "[":
            node = self.blank()
            if self.peek()[1] != "]":
                self.about(node)
            self.take("]")
            return node
        if text == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.take(")")
            nodes = [self.blank() for _ in items] + [self.named(_RDF + "nil")]
            for node, item, rest in zip(nodes, items, nodes[1:]):
                self.rows += [(self.graph, node, self.named(_RDF + "first"), item), (self.graph, node, self.named(_RDF + "rest"), rest)]
            return nodes[0]
        if kind == "number":
            of = "double" if re.search("[eE]", text) else "decimal" if "." in text else "integer"
            return _quoted(text, "^^" + self.named(_XSD + of))
        if text in ("true", "false"):
            return _quoted(text, "^^" + self.named(_XSD + "boolean"))
        if kind == "text":
            cut = 3 if text[:3] in ('"""', "'''") and len(text) >= 6 else 1
            body, tail = _unescape(text[cut:-cut]), ""
            if self.peek()[0] == "at":
                tail = self.take()[1]
            elif self.peek()[0] == "type":
                self.take()
                tail = "^^" + self.iri(*self.take())
            return _quoted(body, tail)
        raise ValueError(f"a term was expected, not {text!r}")

    def about(self, subject: str) -> None:
        """Predicates and objects of one subject."""
        while True:
            kind, text = self.take()
            predicate = self.named(_RDF + "type") if text == "a" else self.iri(kind, text)
            while True:
                self.rows.append((self.graph, subject, predicate, self.term()))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
            if self.tokens[self.at - 1][1] != ";" or self.peek()[1] in (".", "]", "}"):
                return

    def statement(self) -> None:
        """Triples up to a full stop, which the last of a graph may lack."""
        lone = self.peek()[1] == "["
        subject = self.term()
        if not (lone and self.peek()[1] in (".", "}")):
            self.about(subject)
        if self.peek()[1] != "}":
            self.take(".")

    def run(self) -> list[tuple[str, str, str, str]]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if text.lower() in ("@prefix", "prefix", "@base", "base"):
                self.take()
                name = self.take()[1][:-1] if "prefix" in text.lower() else None
                uri = _joined(self.base, self.take()[1][1:-1])
                self.known.clear()
                if name is None:
                    self.base = uri
                else:
                    self.prefixes[name] = uri
                if text[0] == "@":
                    self.take(".")
                continue
            if text.lower() == "graph":
                self.take()
                kind, text = self.peek()
            if text == "{" or kind in ("iri", "name", "blank") and self.tokens[self.at + 1][1] == "{":
                self.graph = "" if text == "{" else self.term()
                self.take("{")
                while self.peek()[1] != "}":
                    self.statement()
                self.take("}")
                self.graph = ""
                continue
            self.statement()
        return self.rows


def parse(text: str, base: str = "", short: dict[str, str] | None = None) -> list[tuple[str, str, str, str]]:
    """(graph, s, p, o) of one Turtle or TriG text; the default graph's name is empty.
    ``short`` maps namespaces to prefixes. ValueError where the text is neither."""
    return _Parser(text, base, short or {}).run()


def from_turtle(files: DataFrame, short: dict[str, str] | None = None) -> DataFrame:
    """(path, graph, s, p, o) of ``files`` (path, value: a whole text). Blank nodes are
    named apart by their file. Null texts give no rows; a bad one fails with its path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=["path", "graph", "s", "p", "o"])
        out: list[tuple[str, ...]] = []
        for b in batches:
            for path, text in zip(b["path"], b["value"]):
                try:
                    out += [(path, *r) for r in parse(text or "", path, short)]
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
                if len(out) >= ROWS:
                    yield frame(out)
                    out = []
        yield frame(out)

    apart = lambda c: F.when(F.col(c).startswith("_:"), F.concat(F.lit("_:f"), F.sha1("path"), F.lit("-"), F.substring(c, 3, 1 << 30))).otherwise(F.col(c)).alias(c)
    return dealt(files.select("path", "value"), "path").mapInPandas(run, "path string, graph string, s string, p string, o string").select("path", apart("graph"), apart("s"), "p", apart("o"))


def by_file(files: DataFrame, short: dict[str, str] | None = None) -> DataFrame:
    """(path, rows) of ``files`` (path, value): what ``from_turtle`` says of a path as one
    array of (graph, s, p, o). A file was one text before, so it is one row after; texts of
    one path come together. Null paths are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: list[str] = []
        ends: list[int] = [0]
        rows: list[tuple[str, str, str, str]] = []

        def made() -> pa.RecordBatch:
            terms = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else ((),) * 4)], ["graph", "s", "p", "o"])
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), terms)], ["path", "rows"])

        for b in batches:
            for path, text in zip(b.column("path").to_pylist(), b.column("value").to_pylist()):
                if not paths or path != paths[-1]:
                    if len(rows) >= ROWS:
                        yield made()
                        paths, ends, rows = [], [0], []
                    paths.append(path)
                    ends.append(len(rows))
                    own = "_:f" + hashlib.sha1(path.encode()).hexdigest() + "-"
                try:
                    found = parse(text or "", path, short)
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
                apart = lambda c: own + c[2:] if c[:2] == "_:" else c  # noqa: B023, E731
                rows += [(apart(g), apart(s), p, apart(o)) for g, s, p, o in found]
                ends[-1] = len(rows)
        yield made()

    told = dealt(files.select("path", "value").filter("path is not null"), "path").sortWithinPartitions("path")
    return told.mapInArrow(run, "path string, rows array<struct<graph string, s string, p string, o string>>")


def read_turtle(spark: SparkSession, path: str, short: dict[str, str] | None = None) -> DataFrame:
    """The rows of all Turtle and TriG files under ``path``."""
    return from_turtle(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"), short)
