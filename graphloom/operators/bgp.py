"""Graph patterns as DataFrame joins.

A pattern is (subject, predicate, object); ``?name`` is a variable, anything else a
term. Every pattern is mandatory and solutions are a bag, as in a basic graph
pattern. The planner starts from the pattern with the most constants and goes on
along shared variables, so that a cross product appears only where the patterns fall
apart. A constant type test of a variable that others bind becomes a semi-join;
patterns around one subject whose predicates have one value each become a single
aggregate instead of a join apiece.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Pattern = tuple[str, str, str]


def variables(pattern: Pattern) -> list[str]:
    return list(dict.fromkeys(t[1:] for t in pattern if t.startswith("?")))


def scan(triples: DataFrame, pattern: Pattern) -> DataFrame:
    """Rows of the triples that fit, one column per variable."""
    out, seen = triples, {}
    for column, term in zip("spo", pattern):
        if not term.startswith("?"):
            out = out.filter(F.col(column) == term)
        elif term in seen:
            out = out.filter(F.col(column) == F.col(seen[term]))
        else:
            seen[term] = column
    return out.select(*[F.col(c).alias(v[1:]) for v, c in seen.items()])


def _star(triples: DataFrame, subject: str, group: Sequence[Pattern]) -> DataFrame:
    """Patterns with one subject variable and single-valued predicates, in one pass:
    a conditional aggregate by subject."""
    wanted = triples.filter(F.col("p").isin([p for _, p, _ in group]))
    cols = [F.max(F.when(F.col("p") == p, F.col("o"))).alias(f"v{i}") for i, (_, p, _) in enumerate(group)]
    out = wanted.groupBy(F.col("s").alias(subject)).agg(*cols)
    keep: dict[str, str] = {}
    for i, (_, _, o) in enumerate(group):
        if not o.startswith("?"):
            out = out.filter(F.col(f"v{i}") == o)
        elif o[1:] == subject or o[1:] in keep:
            out = out.filter(F.col(f"v{i}") == F.col(subject if o[1:] == subject else keep[o[1:]]))
        else:
            out = out.filter(F.col(f"v{i}").isNotNull())
            keep[o[1:]] = f"v{i}"
    return out.select(subject, *[F.col(c).alias(v) for v, c in keep.items()])


def match(triples: DataFrame, patterns: Iterable[Pattern], single_valued: Iterable[str] = (), given: DataFrame | None = None) -> DataFrame:
    """All solutions, one column per variable. The triples are a set; ``single_valued``
    names predicates with one object per subject. ``given`` has values that variables, its
    columns, are bound to beforehand: solutions that agree with one of its rows, as often as
    rows agree; the patterns are matched along from there."""
    todo, single = list(dict.fromkeys(patterns)), set(single_valued)
    if not todo:
        raise ValueError("no patterns")
    parts: list[tuple[list[str], DataFrame, bool]] = []
    stars: dict[str, list[Pattern]] = {}
    for p in todo:
        if p[0].startswith("?") and p[1] in single:
            stars.setdefault(p[0][1:], []).append(p)
    for subject, group in stars.items():
        if len(group) > 1:
            todo = [p for p in todo if p not in group]
            found = _star(triples, subject, group)
            parts.append((found.columns, found, False))
    bound_elsewhere = lambda v, own: any(v in variables(q) for q in [*todo, *[g for gs in stars.values() for g in gs]] if q != own)
    tests = []
    for p in sorted(todo, key=lambda p: (sum(t.startswith("?") for t in p), p)):
        free = variables(p)
        is_test = len(free) == 1 and p[1] == "rdf:type" and bound_elsewhere(free[0], p)
        (tests if is_test else parts).append((free, scan(triples, p), is_test))
    if given is not None:
        parts.insert(0, (given.columns, given, False))
    solved: list[tuple[set[str], DataFrame]] = []
    while parts:
        free, df, _ = parts.pop(0)
        bound = set(free)
        while nxt := next((x for x in parts if bound & set(x[0])), None):
            parts.remove(nxt)
            df = df.join(nxt[1], sorted(bound & set(nxt[0])))
            bound |= set(nxt[0])
        solved.append((bound, df))
    for free, test, _ in tests:
        k = next(i for i, (bound, _) in enumerate(solved) if free[0] in bound)
        solved[k] = solved[k][0], solved[k][1].join(test, free[0], "left_semi")
    return reduce(lambda a, b: a.crossJoin(b), [df for _, df in solved])


def fold(solutions: DataFrame, multi: str, separator: str = "|") -> DataFrame:
    """One row per combination of the other variables, the values of ``multi`` (repeats
    kept) in order."""
    others = [c for c in solutions.columns if c != multi]
    return solutions.groupBy(*others).agg(F.array_sort(F.collect_list(multi)).alias(multi))


def query_text(patterns: Iterable[Pattern]) -> str:
    """The patterns as a query, always in the same order."""
    body = "".join(f"  {' '.join(p)} .\n" for p in sorted(set(patterns)))
    return "SELECT * WHERE {\n" + body + "}\n"
