"""Licence scans: sparse TF-IDF cosine to templates, then directory inheritance.

The passages of a text are its lines and its paragraphs, a file's header among them, and
of a licence file (LICENSE, COPYING ...) the whole. Their words, weighted by inverse
document frequency over the whole corpus, are compared with titles, notices and whole
texts of licences; the best passage that reaches the threshold names the file's licence.
Document frequencies are counted for every word; only passages that could reach the
threshold look theirs up. A file without a licence takes that of the licence file in the
nearest directory above it, found by joining paths.

A template's weight lies in its rare words. The words that make up so much of it that the
others together cannot reach the threshold are its telling words: a passage without any
of them needs no look, and nothing is lost by that.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, small_batches, text_or_empty
from graphloom.llm.licence_texts import TEMPLATES

LICENCE_FILES = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[a-z]+)?$"
_BLANK = re.compile(r"\n[ \t\r]*\n")
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
SALTS = 64
#: What a word of every text weighs; words that a task counts before it passes them on.
LEAST, HELD = 0.1, 200_000
#: Words of so large a share of the texts are known to all tasks; there are at most
#: 1 / COMMON times as many of them as a text has words on average.
COMMON = 0.02


def tokens(line: str) -> list[str]:
    return _WORD.findall(line.lower())


def _vocabulary() -> set[str]:
    return {t for texts in TEMPLATES.values() for text in texts for t in tokens(text)}


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(word, n): the number of texts (column ``body``) that hold each word of theirs.
    The number of all texts stands at the empty word."""

    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter({"": 0})
        for b in batches:
            for t in b.column("body"):
                seen[""] += 1
                seen.update(set(tokens(t.as_py())))
                if len(seen) > HELD:
                    yield rows(seen)
                    seen = Counter({"": 0})
        yield rows(seen)

    return small_batches(texts).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def passages(text: str, whole: bool) -> list[str]:
    """The lines of a text, its paragraphs of several lines and, if asked for, all of it."""
    lines = text.split("\n")
    blocks = _BLANK.split(text)
    return [*lines, *(b for b in blocks if "\n" in b.strip()), *([text] if whole and len(blocks) > 1 else [])]


def _damped(count: int) -> float:
    """What repeats of a word count for."""
    return 1 + math.log(count)


class Matcher:
    """Cosines of bags of words to the templates under fixed document frequencies."""

    def __init__(self, n: int, frequencies: dict[str, int], threshold: float):
        """``frequencies``: of the templates' words and of all common ones."""
        self.n, self.threshold = n, threshold
        # what any word weighs at least that is not among the common ones
        self.floor = self.weight(COMMON * n)
        self.common = {w: self.weight(k) for w, k in frequencies.items()}
        self.idf = {w: self.weight(frequencies.get(w, 0)) for w in _vocabulary()}
        self.names: list[str] = []
        self.holders: dict[str, list[tuple[int, float]]] = {}
        self.telling: set[str] = set()
        for name in sorted(TEMPLATES):
            for text in TEMPLATES[name]:
                unit = self._unit(Counter(tokens(text)))
                for w, x in unit.items():
                    self.holders.setdefault(w, []).append((len(self.names), x))
                self.names.append(name)
                rest = 1.0
                for w, x in sorted(unit.items(), key=lambda e: (-e[1], e[0])):
                    if rest < (threshold - 1e-6) ** 2:
                        break
                    self.telling.add(w)
                    rest -= x * x

    def weight(self, frequency: float) -> float:
        return math.log((1 + self.n) / (1 + frequency)) + LEAST

    def _unit(self, counts: Counter) -> dict[str, float]:
        v = {w: _damped(c) * self.idf[w] for w, c in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / norm for w, x in v.items()}

    def best(self, words: list[str], weights: dict[str, float]) -> tuple[float, str]:
        """The highest cosine (ties: the name that sorts first) when words of no template
        weigh what ``weights`` says, or the floor."""
        norm, sums = 0.0, [0.0] * len(self.names)
        for w, c in Counter(words).items():
            known = self.idf.get(w)
            x = _damped(c) * (known if known is not None else weights.get(w, self.floor))
            norm += x * x
            if known is not None:
                for k, y in self.holders[w]:
                    sums[k] += x * y
        top = max(range(len(sums)), key=lambda k: (sums[k], -k))
        return min(1.0, sums[top] / (math.sqrt(norm) or 1.0)), self.names[top]

    def candidates(self, text: str, whole: bool) -> list[str]:
        """The words of each passage that could reach the threshold, as sorted text: a
        word that isn't common weighs the floor at least, so the cosine with that is a
        bound."""
        if self.telling.isdisjoint(tokens(text)):
            return []
        found = set()
        for passage in passages(text, whole):
            words = tokens(passage)
            if not self.telling.isdisjoint(words) and self.best(words, self.common)[0] >= self.threshold - 1e-9:
                found.add(" ".join(sorted(words)))
        return sorted(found)


def _cosines(bags: DataFrame, frequencies: DataFrame, matcher: Matcher) -> DataFrame:
    """(bag, cosine, own) of the bags that reach the threshold. A word that stands in
    many bags is dealt to parts, so that they don't meet in one task."""
    words = bags.select("bag", F.explode(F.array_distinct(F.split("bag", " "))).alias("word"))
    words = words.withColumn("salt", F.pmod(F.xxhash64("bag"), F.lit(SALTS)).cast("int"))
    counts = words.select("word", "salt").distinct().join(frequencies, "word")
    known = words.join(counts, ["word", "salt"]).groupBy("bag").agg(F.collect_list(F.struct("word", "n")).alias("counts"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for bag, counts in zip(b.column("bag").to_pylist(), b.column("counts").to_pylist()):
                cosine, name = matcher.best(bag.split(" "), {c["word"]: matcher.weight(c["n"]) for c in counts})
                if cosine >= matcher.threshold:
                    rows.append((bag, cosine, name))
            columns = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.string()))], ["bag", "cosine", "own"])

    return small_batches(known).mapInArrow(judge, "bag string, cosine double, own string")


def scan(df: DataFrame, path: str = "path", text: str = "text", key: str = "doc_id", threshold: float = 0.6) -> DataFrame:
    """One row per row of ``df``: key, path, own_licence, cosine, licence and how it was
    found: ``own``, ``inherited`` or ``none``.

    Null texts count as empty; a null path has no directory and inherits nothing. Keys of
    any type, null ones too, come back as they are. Of several licence files in one
    directory the one with the highest cosine counts, then the name that sorts first; so
    too of several passages of a text. Directories are compared as text. Other columns
    are not read. Empty tables give no rows.
    """
    files = df.select(F.col(key).alias("id"), F.col(path).cast("string").alias("path"), text_or_empty(text).alias("body"))
    frequencies = materialize(document_frequencies(files.select("body")), "frequencies")
    n = (frequencies.filter("word = ''").first() or {"n": 0})["n"]
    known = F.col("word").isin(sorted(_vocabulary())) | (F.col("n") >= COMMON * n)
    matcher = Matcher(n, {r["word"]: r["n"] for r in frequencies.filter(known & (F.col("word") != "")).collect()}, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            bags = [matcher.candidates(t.as_py(), w) for t, w in zip(b.column("body"), b.column("whole").to_pylist())]
            made = [pa.array(range(row, row + b.num_rows), pa.int64()), pa.array(bags, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("path"), *made], ["id", "path", "row", "bags"])
            row += b.num_rows

    kind = df.schema[key].dataType.simpleString()
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    whole = F.coalesce(F.col("path").rlike(LICENCE_FILES), F.lit(False)).alias("whole")
    rows = materialize(small_batches(files.select("id", "path", "body", whole)).mapInArrow(run, f"id {kind}, path string, row long, bags array<string>"), "lines")
    lines = rows.select("row", F.explode("bags").alias("bag")).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    cosines = _cosines(lines.select("bag").distinct(), frequencies, matcher)
    # a line that stands in many texts is dealt to parts
    dealt_lines = lines.select("bag", "salt").distinct().join(cosines, "bag")
    best = lines.join(dealt_lines, ["bag", "salt"]).groupBy("row").agg(F.min(F.struct((-F.col("cosine")).alias("far"), "own")).alias("best"))
    own = materialize(
        rows.drop("bags").join(best, "row", "left")
        .select("id", "path", F.col("best.own").alias("own"), F.coalesce(-F.col("best.far"), F.lit(0.0)).alias("cosine"))
        .withColumn("dir", folder)
        .withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int")),
        "licences",
    )
    given = own.filter(F.col("own").isNotNull() & F.col("path").rlike(LICENCE_FILES)).groupBy("dir").agg(F.min_by("own", F.struct(-F.col("cosine"), "own")).alias("given"))
    # ancestors of distinct directories, not of files
    dirs = own.filter(F.col("path").isNotNull()).groupBy("dir", "salt").agg(F.count(F.lit(1)).alias("_")).select("dir", "salt")
    steps = F.split("dir", "/")
    above = dirs.select("dir").distinct().withColumn(
        "up", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))))
    )
    nearest = above.distinct().join(given.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by("given", F.length("up")).alias("given"))
    dealt = dirs.join(nearest, "dir")
    licence = F.coalesce("own", "given")
    return own.join(dealt, ["dir", "salt"], "left").select(
        F.col("id").alias(key), "path", F.col("own").alias("own_licence"), "cosine", licence.alias("licence"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("found"),
    )
