"""Templates: named graph patterns with slots, found, filled, folded and unfolded."""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.terms import binding_hash, is_literal, literal
from graphloom.operators import bgp
from graphloom.operators.ontology import materialized


@dataclasses.dataclass(frozen=True)
class Slot:
    name: str
    required: bool = True
    multi: bool = False
    range: str | None = None


@dataclasses.dataclass(frozen=True)
class Template:
    """``lowered`` is the pattern in full; variables that are no slot are intermediate.
    ``lifted`` is set for the pattern form: the short pattern that stands for the lowered
    one, whose variables are the slots. ``datatypes`` are those of variables that stand for
    literals."""

    uri: str
    slug: str
    subject: str
    slots: tuple[Slot, ...]
    lowered: tuple[bgp.Pattern, ...]
    lifted: tuple[bgp.Pattern, ...] = ()
    datatypes: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        if not self.lowered:
            raise ValueError(f"{self.slug}: nothing to match")
        if sum(s.multi for s in self.slots) > 1:
            raise ValueError(f"{self.slug}: more than one slot with many values")

    @property
    def multi(self) -> str | None:
        return next((s.name for s in self.slots if s.multi), None)

    def inline(self, templates: dict[str, Template], inside: tuple[str, ...] = ()) -> Template:
        """Patterns typed with another template become that template's own; a template
        that comes back to itself is refused."""
        if self.uri in inside:
            raise ValueError("templates invoke each other in a circle: " + " > ".join((*inside, self.uri)))
        out: list[bgp.Pattern] = []
        for n, (s, p, o) in enumerate(self.lowered):
            other = templates.get(o) if p == "rdf:type" else None
            if other is None:
                out.append((s, p, o))
                continue
            given = {q: v for t, q, v in self.lowered if t == s}
            body = other.inline(templates, (*inside, self.uri))
            names = {f"?{x.name}": given.get(f"{other.slug}:{x.name}", f"?i{n}_{x.name}") for x in other.slots} | {"?this": s}
            for pattern in body.lowered:
                out.append(tuple(names.get(t, f"?i{n}_{t[1:]}" if t.startswith("?") else t) for t in pattern))
        used = {t.uri for t in templates.values()}
        slugs = {f"{t.slug}:" for t in templates.values()}
        kept = [p for p in out if not (p[1] == "rdf:type" and p[2] in used) and not any(p[1].startswith(x) for x in slugs)]
        return dataclasses.replace(self, lowered=tuple(dict.fromkeys(kept)))


_TYPE, _UOM, _VALUE = "rdf:type", "lis:datumUOM", "lis:datumValue"
# The bundled templates' names, slots and patterns.
_DATUM = (("?datum", _TYPE, "lis:ScalarQuantityDatum"), ("?datum", _TYPE, "?datumType"), ("?datum", _UOM, "?uom"), ("?datum", _VALUE, "?value"))
_QUALITY = (("?quality", _TYPE, "lis:Quality"), ("?quality", _TYPE, "?qualityType"), ("?quality", "lis:qualityQuantifiedAs", "?datum"))


def _slots(text: str) -> tuple[Slot, ...]:
    return tuple(Slot(n.rstrip("?"), not n.endswith("?")) for n in text.split())


BUNDLED = {
    t.slug: t
    for t in (
        Template("tpl:QuantityDatumWithUOMandValue", "quantity-datum-with-uomand-value", "lis:ScalarQuantityDatum", _slots("datum datumType? uom value"), _DATUM),
        Template("tpl:QualityQuantifiedAsDatum", "quality-quantified-as-datum", "lis:Quality", _slots("quality qualityType? datum datumType? uom value"), _DATUM + _QUALITY),
        Template(
            "tpl:PhysicalObjectHasQuantity", "physical-object-has-quantity", "lis:PhysicalObject", _slots("object quality qualityType? datum datumType? uom value"),
            (*_DATUM, *_QUALITY, ("?object", "lis:hasPhysicalQuantity", "?quality")),
        ),
        Template(
            "tpl:ObjectHasNominalQuality", "object-has-nominal-quality", "lis:Quality", _slots("object quality qualityType? datum value"),
            (("?datum", _TYPE, "lis:QuantityDatum"), ("?datum", _VALUE, "?value"), *_QUALITY, ("?object", "lis:hasQuality", "?quality")),
        ),
        Template(
            "tpl:RoleRealizedInActivity", "role-realized-in-activity", "lis:Role", _slots("role roleType? activity player"),
            (("?role", _TYPE, "lis:Role"), ("?role", _TYPE, "?roleType"), ("?role", "lis:realizedIn", "?activity"), ("?player", "lis:hasRole", "?role")),
        ),
    )
}


def recognize(template: Template, triples: DataFrame, single_valued: tuple[str, ...] = ()) -> DataFrame:
    """Invocations found: one column per slot, the values of a many-valued slot folded.
    Every pattern must be there, those of optional slots too."""
    found = bgp.match(triples, template.lowered, single_valued)
    slots = [s.name for s in template.slots if s.name in found.columns]
    rows = found.select(*slots).filter(reduce(lambda a, b: a & b, [F.col(s.name).isNotNull() for s in template.slots if s.required and s.name in slots], F.lit(True)))
    return bgp.fold(rows, template.multi) if template.multi in slots else rows


def recognize_all(templates: list[Template], triples: DataFrame) -> DataFrame:
    parts = [recognize(t, triples).withColumn("template", F.lit(t.slug)) for t in templates]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def partial(template: Template, triples: DataFrame) -> DataFrame:
    """Matches that lack one required slot: for each such slot the patterns without
    those that name it, less what a full match already has."""
    full = recognize(template, triples)
    out = []
    for slot in (s for s in template.slots if s.required):
        rest = [p for p in template.lowered if f"?{slot.name}" not in p]
        names = {v for p in rest for v in bgp.variables(p)}
        if not rest or any(s.required and s.name != slot.name and s.name not in names for s in template.slots):
            continue
        known = [s.name for s in template.slots if s.name in names]
        found = bgp.match(triples, rest).select(*known).join(full.select(*known).distinct(), known, "left_anti")
        out.append(found.withColumn("missing", F.lit(slot.name)))
    if not out:
        raise ValueError(f"{template.slug}: no slot can be missing")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def anchor(template: Template, bindings: DataFrame, base: Column | str = "urn:tpl-instance/") -> Column:
    """The name of an invocation: its template and the hash of what fills its slots, after
    ``base``."""
    slots = {s.name: F.col(s.name) if s.name in bindings.columns else F.lit(None).cast("string") for s in template.slots}
    many = {n for n in slots if n in bindings.columns and bindings.schema[n].dataType.typeName() == "array"}
    return F.concat(F.lit(base) if isinstance(base, str) else base, F.lit(f"{template.slug}-"), binding_hash(template.slug, slots, many, not template.lifted))


def repeated_terms(template: Template) -> set[str]:
    """Terms that each value of the many-valued slot has for itself: the slot, and the
    nameless variables (``?anon-...``) that patterns tie to it. Named ones are shared."""
    if template.multi is None:
        return set()
    own = {f"?{template.multi}"}
    ties = [{t for t in (s, o) if t in own or t.startswith("?anon-")} for s, _, o in template.lowered]
    while more := {t for tie in ties if tie & own for t in tie} - own:
        own |= more
    return own


def _term(template: Template, bindings: DataFrame, term: str, own: set[str]) -> Column:
    """A slot's value, the anchor itself, a name under the anchor, or a constant."""
    if not term.startswith("?"):
        return F.lit(term)
    if any(s.name == term[1:] for s in template.slots):
        return F.col(term[1:]) if term[1:] in bindings.columns else F.lit(None).cast("string")
    if term == "?this":
        return F.col("_base")
    name = F.concat(F.col("_base"), F.lit(f"-{term[1:]}"))
    return F.concat(name, F.lit("-"), F.col("_at").cast("string")) if term in own else name


def _written(template: Template, rows: DataFrame, patterns: list[bgp.Pattern], own: set[str], keep: tuple[str, ...]) -> DataFrame:
    """Patterns filled in for each row, which knows its anchor; those that lack a value are
    left out. Where all have one subject, rows dealt by it stay so."""
    if len({s for s, _, _ in patterns}) == 1:
        pairs = F.array(*[F.struct(*[_term(template, rows, t, own).alias(c) for c, t in zip("po", p[1:])]) for p in patterns])
        return rows.select(*keep, _term(template, rows, patterns[0][0], own).alias("s"), F.inline(pairs)).dropna(subset=["s", "p", "o"])
    terms = F.array(*[F.struct(*[_term(template, rows, t, own).alias(c) for c, t in zip("spo", p)]) for p in patterns])
    return rows.select(*keep, F.inline(terms)).dropna(subset=["s", "p", "o"])


def expand(template: Template, bindings: DataFrame, base: Column | str = "urn:tpl-instance/", keep: tuple[str, ...] = ()) -> DataFrame:
    """Lowered triples of invocations; patterns of slots without a value are left out.
    What hangs on the many-valued slot is written once for each of its values. Columns
    ``keep``, which are no slots, go with the triples."""
    return _expanded(template, bindings, base, keep).distinct()


def _expanded(template: Template, bindings: DataFrame, base: Column | str = "urn:tpl-instance/", keep: tuple[str, ...] = ()) -> DataFrame:
    """As ``expand``, a triple as often as rows say it."""
    multi, own = template.multi, repeated_terms(template)
    based = bindings.withColumn("_base", anchor(template, bindings, base))
    written = lambda rows, patterns: _written(template, rows, patterns, own, keep)
    each = [p for p in template.lowered if own & set(p)]
    once = [p for p in template.lowered if not own & set(p)]
    parts = [written(based, once)] if once else []
    if each and multi in bindings.columns:
        many = bindings.schema[multi].dataType.typeName() == "array"
        others = [c for c in based.columns if c != multi]
        rows = based.select(*others, F.posexplode(multi).alias("_at", multi)) if many else based.withColumn("_at", F.lit(0))
        parts.append(written(rows, each))
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else based.select(*keep, *[F.lit("").alias(c) for c in "spo"]).limit(0)


def lift(template: Template, bindings: DataFrame, base: Column | str = "urn:tpl-instance/", keep: tuple[str, ...] = ()) -> DataFrame:
    """Lifted triples: the anchor's type and one triple for every value of a slot, or, in
    pattern form, the lifted patterns filled in."""
    if template.lifted:
        return _written(template, bindings.withColumn("_base", anchor(template, bindings, base)), list(template.lifted), set(), keep).distinct()
    slots = [s.name for s in template.slots if s.name in bindings.columns]
    listed = lambda n: F.col(n) if bindings.schema[n].dataType.typeName() == "array" else F.array(n)
    said = lambda n: lambda v: F.struct(F.lit(f"urn:tpl/{template.slug}/slot/{n}").alias("p"), v.alias("o"))
    kind = F.array(F.struct(F.lit("rdf:type").alias("p"), F.lit(template.uri).alias("o")))
    pairs = F.concat(kind, *[F.transform(F.coalesce(listed(n), F.array().cast("array<string>")), said(n)) for n in slots])
    # named before there are rows for its values, else it would be hashed for each of them
    named = bindings.withColumn("_base", anchor(template, bindings, base))
    return named.select(*keep, F.col("_base").alias("s"), F.inline(pairs)).dropna(subset=["s", "p", "o"]).distinct()


def fold_graph(templates: list[Template], triples: DataFrame) -> DataFrame:
    """The graph with what templates recognise put in lifted form. All are recognised
    before anything is taken out, so that overlapping ones each lift; what is found is written,
    since it is taken out and put in."""
    found = [(t, materialized(recognize(t, triples))) for t in templates]
    gone = reduce(lambda a, b: a.unionByName(b), [_expanded(t, b) for t, b in found]).distinct()
    made = reduce(lambda a, b: a.unionByName(b), [lift(t, b) for t, b in found])
    return triples.join(gone, ["s", "p", "o"], "left_anti").unionByName(made).distinct()


def _matched(patterns: tuple[bgp.Pattern, ...], found: DataFrame) -> DataFrame:
    """The triples that solutions of ``patterns`` rest on."""
    term = lambda t: F.col(t[1:]) if t.startswith("?") else F.lit(t)
    return found.select(F.inline(F.array(*[F.struct(*[term(t).alias(c) for c, t in zip("spo", p)]) for p in patterns]))).distinct()


def unfold_graph(templates: list[Template], triples: DataFrame) -> DataFrame:
    """The other way: lifted invocations read back, all values of a many-valued slot
    with them, and written out in full. The graph is written first where it is read for its
    invocations, their slots and the rest."""
    if not all(t.lifted for t in templates):
        triples = materialized(triples)
    out = triples
    for t in templates:
        if t.lifted:
            found = bgp.match(triples, t.lifted)
            out = out.join(_matched(t.lifted, found), ["s", "p", "o"], "left_anti").unionByName(_expanded(t, found.select(*[s.name for s in t.slots])))
            continue
        ids = triples.filter((F.col("p") == "rdf:type") & (F.col("o") == t.uri)).select("s")
        mine = triples.join(ids, "s", "left_semi")
        value = lambda s: F.when(F.col("p") == f"urn:tpl/{t.slug}/slot/{s.name}", F.col("o"))  # noqa: B023, E731
        cols = [(F.array_sort(F.collect_set(value(s))) if s.multi else F.max(value(s))).alias(s.name) for s in t.slots]
        out = out.join(ids, "s", "left_anti").unionByName(_expanded(t, mine.groupBy("s").agg(*cols).drop("s")))
    return out.distinct()


def coerced(template: Template, bindings: DataFrame) -> DataFrame:
    """``bindings`` whose plain texts are terms: literals, of the slot's range, where that
    is a datatype, else of the datatype that the patterns tell of the variable; names where
    they tell none. What is a literal already stays."""
    told = dict(template.datatypes)
    out = bindings
    for s in (s for s in template.slots if s.name in bindings.columns):
        literal_range = s.range is not None and (s.range.startswith("xsd:") or s.range == "rdfs:Literal")
        kind = s.range if literal_range else told.get(s.name) if s.range is None else None
        if kind is None:
            continue
        term = lambda v: F.when(is_literal(v), v).otherwise(literal(v, None if kind == "rdfs:Literal" else kind))  # noqa: B023, E731
        many = bindings.schema[s.name].dataType.typeName() == "array"
        out = out.withColumn(s.name, F.transform(s.name, term) if many else term(F.col(s.name)))
    return out


def validate(template: Template, bindings: DataFrame, strict: bool = True) -> DataFrame:
    """``bindings`` whose required slots all have a value and whose single-valued slots
    have one at most. Columns that are no slot are an error; with ``strict`` so are rows
    that don't fit, else they are left out."""
    names = {s.name: s for s in template.slots}
    if extra := sorted(set(bindings.columns) - set(names)):
        raise ValueError(f"{template.slug}: no such slots: {', '.join(extra)}")
    if lost := sorted(n for n, s in names.items() if s.required and n not in bindings.columns):
        raise ValueError(f"{template.slug}: required slots without values: {', '.join(lost)}")
    faults = []
    for n in bindings.columns:
        many = bindings.schema[n].dataType.typeName() == "array"
        empty = F.col(n).isNull() | (F.size(n) == 0) if many else F.col(n).isNull()
        if names[n].required:
            faults.append(F.when(empty, F.lit(f"{n} is required")))
        if many and not names[n].multi:
            faults.append(F.when(F.size(n) > 1, F.lit(f"{n} takes one value")))
    if not faults:
        return bindings
    fault = F.concat_ws("; ", *faults)
    if strict:
        return bindings.filter(F.when(fault == "", True).otherwise(F.raise_error(F.concat(F.lit(f"{template.slug}: "), fault)).cast("boolean")))
    return bindings.filter(fault == "")


def confirm(template: Template, triples: DataFrame, answers: DataFrame, rounds: int = 5, questions: int = 20) -> DataFrame:
    """Complete partial matches from a table of answers (missing, key, value): each
    round asks the matches that know most first, adds what the answers give and stops
    when there is nothing left to ask. A question is asked once, answered or not; a
    round asks ``questions`` at most."""
    known, put = triples, None
    for _ in range(rounds):
        asked = partial(template, known)
        slots = [s.name for s in template.slots if s.name in asked.columns]
        key = F.concat_ws("|", *[F.coalesce(F.col(s), F.lit("")) for s in slots])
        size = reduce(lambda a, b: a + b, [F.col(s).isNotNull().cast("int") for s in slots])
        fresh = asked.withColumn("key", key).withColumn("known", size)
        if put is not None:
            fresh = fresh.join(put, ["missing", "key"], "left_anti")
        picked = fresh.orderBy(F.desc("known"), "missing", "key").limit(questions)
        # few rows by the limit: they are kept, so that a round asks what it says
        rows = picked.collect()
        if not rows:
            break
        picked = known.sparkSession.createDataFrame(rows, picked.schema)
        now = picked.select("missing", "key")
        put = now if put is None else put.unionByName(now)
        told = picked.join(answers, ["missing", "key"])
        for slot in [s.name for s in template.slots if s.required]:
            mine = told.filter(F.col("missing") == slot)
            if slot in mine.columns:
                mine = mine.drop(slot)
            known = known.unionByName(expand(template, mine.withColumn(slot, F.col("value")).select(*[s.name for s in template.slots if s.name in mine.columns or s.name == slot]))).distinct()
    return known
