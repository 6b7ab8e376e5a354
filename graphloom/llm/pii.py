"""Personal data by gradient-boosted trees over candidate spans.

Four kinds have formats that decide alone (the base kinds). Beyond them, generators
with high recall propose spans of further kinds; boosted trees judge each candidate
by its format and its surroundings; a threshold calibrated on held-back candidates
of its kind selects. Of selected candidates that overlap the one with the highest score stays,
and base spans always stay.

The trees are fit on the driver from a few thousand generated candidates (formats
filled at random, true and look-alike, with and without telling words before them).
Everything over the corpus is DataFrame expressions: matching, positions, features,
the trees as CASE expressions, selection and redaction.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_or_empty

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "secret", "birth", "local_phone")
#: The base formats. A start inside a run is tried only where a match has just ended
#: (\\G), and repeats never give back: the same matches, in linear time and with no
#: recursion on long runs.
BASE_PATTERN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What must stand in a text for a base pattern to be worth trying.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Generators of the added kinds: high recall, many false.
ADDED_PATTERN = {
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}+\b",
    "ssn": r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+(?![A-Za-z0-9_+/=-])",
    "birth": r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9./-])",
    "local_phone": r"(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
#: Words before a span that tell of its kind.
CUES = {
    "iban": r"(?i)iban|account|konto|cuenta|compte|bank",
    "ssn": r"(?i)ssn|social|security|insurance",
    "secret": r"(?i)key|token|secret|passw|pwd|auth|bearer|api|credential",
    "birth": r"(?i)born|birth|dob|geboren|naci|n[ée]e? le",
    "local_phone": r"(?i)tel|phone|call|mobile|fax|cell|contact",
}
#: A sign that a value follows, right before a span.
ASSIGNED = r"[:=]\s*[\"'`]?$"
FEATURES = ("length", "digits", "uppers", "lowers", "marks", "cue", "assigned", "clean_edge", "distinct", *(f"is_{k}" for k in ADDED))
CONTEXT = 24
_MARK = "\x01"


# --- trees -----------------------------------------------------------------------


class Boosted:
    """Gradient boosting for two classes: trees of depth two on logistic loss."""

    def __init__(self, trees: list[tuple], start: float, thresholds: dict[str, float]):
        self.trees, self.start, self.thresholds = trees, start, thresholds

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, kinds: list[str], n_trees: int = 40, rate: float = 0.3, precision: float = 0.95) -> Boosted:
        """The first four fifths of the rows grow the trees; on the rest each kind's
        threshold is set, the lowest score from which candidates are right that often."""
        cut = len(x) * 4 // 5
        fx, fy = x[:cut], y[:cut]
        start = float(np.log(fy.mean() / (1 - fy.mean())))
        f = np.full(cut, start)
        trees = []
        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-f))
            g, h = fy - p, p * (1 - p) + 1e-9
            every = np.arange(cut)
            j, t = cls._split(fx, g, h, every)
            sides = []
            for part in (every[fx[:, j] <= t], every[fx[:, j] > t]):
                k, u = cls._split(fx, g, h, part)
                leaf = lambda m: float(rate * g[m].sum() / (h[m].sum() + 1))
                low, high = part[fx[part, k] <= u], part[fx[part, k] > u]
                sides.append((k, u, leaf(low), leaf(high)))
                f[low] += sides[-1][2]
                f[high] += sides[-1][3]
            trees.append((j, t, *sides))
        model = cls(trees, start, {})
        scores, kind = model.score(x[cut:]), np.array(kinds[cut:])
        for name in dict.fromkeys(kinds):
            own = kind == name
            s, right = scores[own], y[cut:][own]
            order = np.argsort(-s, kind="stable")
            share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
            ends = np.append(s[order][1:] < s[order][:-1], True)  # equal scores are taken together
            good = np.flatnonzero((share >= precision) & ends)
            model.thresholds[name] = float(s[order[good[-1]]]) if len(good) else float("inf")
        return model

    @staticmethod
    def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[int, float]:
        best = (-1.0, 0, 0.0)
        for j in range(x.shape[1]):
            for t in np.unique(np.quantile(x[rows, j], np.linspace(0, 0.95, 12))) if len(rows) else ():
                low = x[rows, j] <= t
                a, b = rows[low], rows[~low]
                gain = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (a, b))
                if gain > best[0]:
                    best = (gain, j, float(t))
        return best[1], best[2]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for j, t, low, high in self.trees:
            for (k, u, a, b), side in ((low, x[:, j] <= t), (high, x[:, j] > t)):
                out += np.where(side, np.where(x[:, k] <= u, a, b), 0)
        return out

    def column(self, features: list[Column]) -> Column:
        """The score as an expression."""
        out = F.lit(self.start)
        for j, t, low, high in self.trees:
            arm = lambda s: F.when(features[s[0]] <= s[1], s[2]).otherwise(s[3])
            out = out + F.when(features[j] <= t, arm(low)).otherwise(arm(high))
        return out


def _features(span: str, before: str, after: str, kind: str) -> list[float]:
    import re

    n = max(1, len(span))
    before = before[-CONTEXT:]
    return [
        len(span),
        sum("0" <= c <= "9" for c in span) / n,
        sum("A" <= c <= "Z" for c in span) / n,
        sum("a" <= c <= "z" for c in span) / n,
        sum(not (c.isascii() and c.isalnum()) for c in span) / n,
        float(bool(re.search(CUES[kind], before))),
        float(bool(re.search(ASSIGNED, before))),
        float(not re.match("[A-Za-z0-9]", after)),
        len(set(span)) / n,
        *[float(kind == k) for k in ADDED],
    ]


_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEX = "0123456789abcdef"


class _Generator:
    """Candidates filled at random: (span, before, after, whether it is one)."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def some(self, chars: str, low: int, high: int | None = None) -> str:
        return "".join(self.r.choice(list(chars), int(self.r.integers(low, (high or low) + 1))))

    def one(self, *of):
        return of[int(self.r.integers(len(of)))]

    def words(self) -> str:
        return " ".join(self.some(_LOWER, 2, 9) for _ in range(int(self.r.integers(1, 4)))) + self.one(" ", " ", " ", ": ", "\n", " (", ' "')

    def cue(self, *names: str) -> str:
        name = self.one(*names)
        return self.words() + self.one(name, name.upper(), name.capitalize()) + self.one(": ", " ", " = ", "=", ' = "', ": '", '="')

    def secret(self) -> tuple[str, str, bool]:
        """True: random strings; next to a telling word also words with numbers. False:
        words, paths, names and numbers that are as long, mostly without such a word."""
        at_random = lambda: self.one(
            self.some(_HEX, 32, 64), self.some(_HEX.upper(), 32, 64), self.some(_HEX, 16, 40), self.some(_DIGITS + _UPPER + _LOWER, 20, 64), self.some(_DIGITS + _UPPER, 16, 32),
            self.one("sk-", "ghp_", "AKIA", "xoxb-") + self.some(_DIGITS + _UPPER + _LOWER, 16, 40), self.some(_DIGITS + _UPPER + _LOWER + "+/_-", 24, 300) + self.one("", "=", "=="),
            self.some(_LOWER + _DIGITS, 20, 40),
        )
        chosen = lambda: self.one(self.some(_LOWER, 5, 9) + self.some(_DIGITS, 1, 4) + self.some(_LOWER + _DIGITS, 8, 14), (self.some(_LOWER, 4, 7) + self.some(_DIGITS, 1, 2)) * 3)
        names = ("token", "api_key", "apikey", "secret", "password", "passwd", "pwd", "auth", "credential", "access key", "bearer")
        if self.r.random() < 0.5:
            cued = self.r.random() < 0.75
            return (at_random() if not cued or self.r.random() < 0.7 else chosen()), (self.cue(*names) if cued else self.words()), True
        dash = self.one("-", "_", "/")
        like = self.one(
            self.some(_LOWER, 10, 30) + dash + self.some(_DIGITS, 1, 6), dash.join(self.some(_LOWER, 3, 9) for _ in range(4)) + dash + self.some(_DIGITS, 1, 4), self.some(_DIGITS, 16, 24),
            "/" + "/".join(self.some(_LOWER, 3, 8) for _ in range(4)) + "/" + self.some(_DIGITS, 1, 4), self.some(_LOWER, 16, 30) + self.some(_DIGITS, 1, 3),
            self.some(_DIGITS, 4) + "-" + self.some(_DIGITS, 2) + "-" + self.some(_DIGITS, 2) + dash + self.some(_LOWER, 6, 20), "=" * 20 + self.some(_DIGITS, 1, 3), self.some(_UPPER, 12, 24) + "-" + self.some(_DIGITS, 1, 4),
        )
        return like, (self.cue("version", "name", "file", "path", "number", "id") if self.r.random() < 0.4 else self.words()), False

    def iban(self) -> tuple[str, str, bool]:
        ok = self.r.random() < 0.5
        span = self.some(_UPPER, 2) + self.some(_DIGITS, 2) + (self.some(_DIGITS, 12, 24) if ok else self.one(self.some(_UPPER, 11, 24), self.some(_UPPER + _DIGITS, 11, 24)))
        if ok and self.r.random() < 0.5:
            span = " ".join(span[i : i + 4] for i in range(0, len(span), 4))
        return span, (self.cue("iban", "account", "konto", "compte") if ok and self.r.random() < 0.6 else self.words()), ok

    def _formatted(self, span: str, *names: str) -> tuple[str, str, bool]:
        """A format that also fills ordinary tables: true where a telling word says so."""
        ok = self.r.random() < 0.5
        return span, (self.cue(*names) if ok == (self.r.random() < 0.98) else self.words()), ok

    def ssn(self) -> tuple[str, str, bool]:
        sep = self.one("-", " ")
        return self._formatted(sep.join((self.some(_DIGITS, 3), self.some(_DIGITS, 2), self.some(_DIGITS, 4))), "ssn", "social security number", "insurance no")

    def birth(self) -> tuple[str, str, bool]:
        d, m, y = self.r.integers(1, 29), self.r.integers(1, 13), self.r.integers(1930, 2024)
        return self._formatted(self.one(f"{d}.{m}.{y}", f"{m:02}/{d:02}/{y}", f"{y}-{m:02}-{d:02}"), "born", "date of birth", "dob", "geboren am", "nacido el")

    def local_phone(self) -> tuple[str, str, bool]:
        a, b, c = self.some(_DIGITS, 3), self.some(_DIGITS, 3), self.some(_DIGITS, 4)
        return self._formatted(self.one(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"), "phone", "tel", "call", "mobile", "fax", "contact")

    def rows(self, n: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
        x, y, kinds = [], [], []
        for _ in range(n):
            kind = self.one(*ADDED, "secret", "secret")
            span, before, ok = getattr(self, kind)()
            after = self.one(" ", ".", "", "\n", ",", ";", ")", '"', "'", '"!!', "!", "#", " x")
            x.append(_features(span, before, after, kind))
            y.append(ok)
            kinds.append(kind)
        return np.array(x, float), np.array(y, float), kinds


@functools.cache
def fitted(seed: int = 11, rows: int = 8000) -> Boosted:
    """Trees fit on ``rows`` generated candidates; the same on every call."""
    return Boosted.fit(*_Generator(seed).rows(rows))


# --- expressions over the corpus --------------------------------------------------


def _matches(body: Column, pattern: str) -> Column:
    """array<struct<start,end,text>> of a pattern's leftmost non-overlapping matches.

    Each match is set between marks, and the text cut at them: every second part is a
    match, and the lengths add up to positions. The mark itself can't stand in
    ``body``; no pattern matches the character that takes its place.
    """
    parts = F.split(F.regexp_replace(body, F.lit(f"({pattern})"), F.lit(f"{_MARK}$1{_MARK}")), _MARK, -1)
    def span(x: Column) -> Callable[[Column, Column], Column]:
        """The part at ``i`` with its surroundings, from the parts next to it: three matches
        have more characters than are looked at."""

        def one(p: Column, i: Column) -> Column:
            first = F.greatest(i - 6, F.lit(0))
            before = F.substring(F.array_join(F.slice(x["parts"], first + 1, i - first), ""), -CONTEXT, CONTEXT)
            after = F.substring(F.array_join(F.slice(x["parts"], i + 2, F.lit(2)), ""), 1, 1)
            return F.struct(i.alias("i"), (x["ends"][i] - F.length(p)).alias("start"), x["ends"][i].alias("end"), p.alias("text"), before.alias("before"), after.alias("after"))

        return one

    every = _with(_with(parts, lambda p: F.struct(p.alias("parts"), _sums(F.transform(p, F.length)).alias("ends"))), lambda x: F.filter(F.transform(x["parts"], span(x)), lambda s: s["i"] % 2 == 1))
    return F.transform(every, lambda s: s.dropFields("i"))


def _sums(numbers: Column) -> Column:
    """Running sums. Within chunks, and over the chunks: an array that grows by one is
    copied each time, so a chunk has as many numbers as there are chunks."""
    running = lambda xs: F.aggregate(
        xs,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out")),
        lambda s: s["out"],
    )
    m = lambda x: F.greatest(F.ceil(F.sqrt(F.size(x))).cast("int"), F.lit(1))
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(x) - 1) / m(x)).cast("int"), F.lit(0))), lambda c: running(F.slice(x, c * m(x) + 1, m(x))))
    lifted = lambda y: F.flatten(F.transform(y["cut"], lambda c, i: _with(F.when(i > 0, y["before"][i - 1]).otherwise(0), lambda b: F.transform(c, lambda e: e + b))))
    both = lambda c: F.struct(c.alias("cut"), running(F.transform(c, lambda x: F.coalesce(F.get(x, F.size(x) - 1), F.lit(0)))).alias("before"))
    return _with(numbers, lambda x: _with(_with(cut(x), both), lifted))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often its expression is named."""
    return F.transform(F.array(value), use)[0]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        small = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
        low = lambda p: F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int")
        return F.forall(F.split(text, r"\."), lambda p: small(p) & (F.coalesce(low(p), F.lit(0)) <= 255))
    if kind == "card":
        digits = F.reverse(_digits(text))
        sums = F.aggregate(
            F.transform(
                F.split(F.substring(digits, 1, 19), ""),
                lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((2 * c.cast("int")) % 10 + F.floor(c.cast("int") / 5).cast("int")),
            ),
            F.lit(0),
            lambda a, b: a + F.coalesce(b, F.lit(0)),
        )
        return F.length(digits).between(13, 19) & (sums % 10 == 0)
    if kind == "phone":
        return F.length(_digits(text)).between(9, 15)
    return F.lit(True)


def _validity(kind: str):
    return lambda s: _valid(kind, s["text"])


def of_kind(kind: str):
    """A test for spans of one kind."""
    return lambda s: s["kind"] == kind


def _typed(spans: Column, kind: str) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")),
    )


def _scored(spans: Column, kind: str, model: Boosted) -> Column:
    """The generator's spans with the trees' scores, those above the threshold."""

    def features(s: Column) -> Column:
        t, n = s["text"], F.greatest(F.length(s["text"]), F.lit(1))
        told = [
            F.length(t),
            F.length(F.regexp_replace(t, "[^0-9]", "")) / n,
            F.length(F.regexp_replace(t, "[^A-Z]", "")) / n,
            F.length(F.regexp_replace(t, "[^a-z]", "")) / n,
            F.length(F.regexp_replace(t, "[A-Za-z0-9]", "")) / n,
            s["before"].rlike(CUES[kind]).cast("int"),
            s["before"].rlike(ASSIGNED).cast("int"),
            (~s["after"].rlike("[A-Za-z0-9]")).cast("int"),
            F.size(F.array_distinct(F.split(t, ""))) / n,
        ]
        return F.struct(s.alias("s"), *[f.alias(f"f{i}") for i, f in enumerate(told)])

    def score(x: Column) -> Column:
        told = [x[f"f{i}"] for i in range(len(FEATURES) - len(ADDED))] + [F.lit(int(kind == k)) for k in ADDED]
        s = x["s"]
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), model.column(told).alias("score"))

    # first all features of a span, then the trees, which name each of them many times
    return F.filter(F.transform(F.transform(spans, features), score), lambda s: s["score"] >= F.lit(model.thresholds[kind]))


_NO_BASE = "array<struct<kind:string,start:int,end:int,text:string>>"
_NO_MORE = "array<struct<kind:string,start:int,end:int,text:string,score:double>>"


def find_pii(df: DataFrame, text: str = "text", model: Boosted | None = None) -> DataFrame:
    """All columns of ``df`` plus ``base`` and ``spans``: arrays of (kind, start, end,
    text), by kind as listed in BASE and ADDED, then start; code points, end excluded.

    Null texts count as empty and have no spans. Columns named base or spans are
    replaced, others may have any name. Rows are taken as they are.
    """
    model = model or fitted()
    own = "_"
    while any(c.startswith(own) for c in df.columns):
        own += "_"
    body, more = own + "body", own + "more"
    keep = [df[c] for c in df.columns if c.lower() not in ("base", "spans")]
    out = df.select(*keep, F.translate(text_or_empty(text), _MARK, "\x02").alias(body))
    numeric = F.col(body).rlike("[0-9]")
    for kind in BASE:
        need = F.col(body).contains(NEEDS[kind]) if NEEDS[kind] else F.col(body).rlike(r"[0-9](?:[\x20-]?[0-9]){12}")
        some = need & numeric if kind != "email" else need
        out = out.withColumn(own + kind, F.when(some, _matches(F.col(body), BASE_PATTERN[kind])))
        out = out.withColumn(own + kind, F.coalesce(_typed(F.filter(own + kind, _validity(kind)), kind), F.array().cast(_NO_BASE)))
    out = out.withColumn("base", F.concat(*[F.col(own + k) for k in BASE])).drop(*[own + k for k in BASE])
    for kind in ADDED:
        out = out.withColumn(own + kind, F.when(numeric & F.col(body).rlike(ADDED_PATTERN[kind]), _matches(F.col(body), ADDED_PATTERN[kind])))
        out = out.withColumn(own + kind, F.coalesce(_scored(F.col(own + kind), kind, model), F.array().cast(_NO_MORE)))
    out = out.withColumn(more, F.concat(*[F.col(own + k) for k in ADDED])).drop(*[own + k for k in ADDED])
    return out.withColumn("spans", F.concat("base", _selected(F.col(more), F.col("base")))).drop(body, more)


def _beaten(spans: Column, kinds: tuple[str, ...], rank: Callable[[Column], Column]) -> Column:
    """``spans`` without those that meet one of smaller rank; spans of one kind must not
    meet. By kind, then start.

    One pass by start: of each kind the last span is held, with whether it is beaten, since
    of those that began before, no other can still meet what comes. What became of a kind's
    spans is written down as a text of zeros and ones: the state stays small.
    """
    meets = lambda held, s: F.coalesce(held["end"] > s["start"], F.lit(False))
    said = lambda held: F.when(held["beaten"], "1").otherwise("0")

    def step(a: Column, x: Column) -> Column:
        s, own, beaten, fields = x["s"], x["r"], F.lit(False), []
        for k in kinds:
            beaten = beaten | (meets(a[k], s) & F.coalesce(a[k]["rank"] < own, F.lit(False)))
        for k in kinds:
            loses = a[k]["beaten"] | (meets(a[k], s) & F.coalesce(own < a[k]["rank"], F.lit(False)))
            kept = F.when(a[k].isNotNull(), F.struct(a[k]["end"].alias("end"), a[k]["rank"].alias("rank"), loses.alias("beaten")))
            fields.append(F.when(s["kind"] == k, F.struct(s["end"].alias("end"), own.alias("rank"), beaten.alias("beaten"))).otherwise(kept).alias(k))
            fields.append(F.when((s["kind"] == k) & a[k].isNotNull(), F.concat(a[f"of_{k}"], said(a[k]))).otherwise(a[f"of_{k}"]).alias(f"of_{k}"))
        return F.struct(*fields)

    none = F.lit(None).cast(f"struct<end:int,rank:{_RANK},beaten:boolean>")
    start = F.struct(*[x for k in kinds for x in (none.alias(k), F.lit("").alias(f"of_{k}"))])
    end = lambda a: F.struct(*[F.concat(a[f"of_{k}"], F.when(a[k].isNull(), "").otherwise(said(a[k]))).alias(k) for k in kinds])

    def left(y: Column) -> Column:
        told = _with(F.struct(y.alias("y"), F.aggregate(y, start, step, end).alias("told")), lambda z: F.concat(*[_unbeaten(z, k) for k in kinds]))
        return told

    return _with(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("p"), s["kind"].alias("k"), rank(s).cast(_RANK).alias("r"), s.alias("s")))), left)


def _unbeaten(z: Column, kind: str) -> Column:
    own = F.filter(z["y"], lambda x: x["k"] == kind)
    return F.transform(F.filter(own, lambda x, i: F.substring(z["told"][kind], i + 1, F.lit(1)) == "0"), lambda x: x["s"])


_RANK = "struct<score:double,start:int,kind:string>"
_SPAN = "struct<kind:string,start:int,end:int,text:string,score:double>"


def _selected(more: Column, base: Column) -> Column:
    """Added spans that overlap no base span and no added one with a higher score
    (ties: the one that starts first, then by kind)."""
    scored = lambda s, score: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), score.alias("score")).cast(_SPAN)
    # base spans go before added ones, which are equal; those that are left are judged among themselves
    both = F.concat(F.transform(base, lambda s: scored(s, F.lit(None))), F.transform(more, lambda s: scored(s, s["score"])))
    first = lambda s: F.struct(F.when(s["score"].isNull(), 0.0).otherwise(1.0).alias("score"), F.lit(0).alias("start"), F.lit("").alias("kind"))
    free = F.filter(_beaten(both, (*BASE, *ADDED), first), lambda s: s["score"].isNotNull())
    second = lambda s: F.struct((-s["score"]).alias("score"), s["start"].alias("start"), s["kind"].alias("kind"))
    best = F.when(F.size(more) > 0, _beaten(free, ADDED, second)).otherwise(F.array().cast(f"array<{_SPAN}>"))
    order = F.transform(best, lambda s: F.struct(F.array_position(F.array(*map(F.lit, ADDED)), s["kind"]).alias("o"), s["start"].alias("p"), s.alias("s")))
    return F.transform(
        F.array_sort(order),
        lambda x: F.struct(x["s"]["kind"].alias("kind"), x["s"]["start"].alias("start"), x["s"]["end"].alias("end"), x["s"]["text"].alias("text")),
    )


def span_text(column: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(df: DataFrame, text: str = "text", model: Boosted | None = None) -> DataFrame:
    """``df`` with every span in ``text`` replaced by its kind in brackets. Where spans
    overlap the first in the text names the replacement and the later one's rest goes
    with it. Texts without spans, null ones too, are returned as they were."""
    names = {c: f"column{i}" for i, c in enumerate(df.columns)}
    found, text = find_pii(df.toDF(*names.values()), names[text], model), names[text]
    marks = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    whole = F.col(text).cast("string")
    walk = F.aggregate(
        marks,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(
                (-s["end"]).alias("at"),
                F.concat(a["out"], F.array(F.substring(whole, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(a["at"], -s["end"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.array_join(F.concat(a["out"], F.array(F.substring(whole, a["at"] + 1, F.length(whole)))), ""),
    )
    return found.withColumn(text, F.when(F.size("spans") > 0, walk).otherwise(F.col(text))).select(*names.values()).toDF(*df.columns)
