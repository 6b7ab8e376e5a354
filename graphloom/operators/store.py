"""The versioned triple store: last operation wins, time travel, diff, history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["scope", "s", "p", "o"]


def materialize(log: DataFrame, at_seq: int | None = None) -> DataFrame:
    """The triples that hold after every step, or after step ``at_seq``.

    The last operation on a triple decides; within one step removals come after
    additions. One partial aggregate and one exchange; no sort.
    """
    rows = log if at_seq is None else log.filter(F.col("seq") <= at_seq)
    last = F.max(F.struct("seq", (F.col("op") == "removed").alias("gone"))).alias("last")
    return rows.groupBy(*KEYS).agg(last).filter(~F.col("last.gone")).select(*KEYS)


def resume(state: DataFrame, steps: DataFrame, log: DataFrame, at_seq: int | None = None) -> DataFrame:
    """``materialize`` from a kept ``state`` that holds, of each scope, the steps up to its
    number in ``steps`` (scope, last): only later rows of ``log`` are looked at, so it may lack
    the others. A scope that ``steps`` doesn't name is read whole."""
    rows = log if at_seq is None else log.filter(F.col("seq") <= at_seq)
    tail = rows.join(steps.select("scope", "last"), "scope", "left").filter(F.col("last").isNull() | (F.col("seq") > F.col("last")))
    last = tail.groupBy(*KEYS).agg(F.max(F.struct("seq", (F.col("op") == "removed").alias("gone"))).alias("last"))
    kept = state.select(*KEYS).withColumn("held", F.lit(True))
    # one exchange by triple for both sides
    both = kept.join(last, KEYS, "full").filter(F.when(F.col("last").isNull(), F.col("held")).otherwise(~F.col("last.gone")))
    return both.select(*KEYS)


def compact(log: DataFrame, up_to: int) -> DataFrame:
    """The log with its steps up to ``up_to`` reduced to the operations that put there what
    held after it, under their own numbers. States from ``up_to`` on stay the same."""
    rest = [c for c in log.columns if c not in KEYS]
    old = log.filter(F.col("seq") <= up_to).groupBy(*KEYS).agg(F.max_by(F.struct(*rest), F.struct("seq", (F.col("op") == "removed").alias("gone"))).alias("x"))
    return old.select(*KEYS, "x.*").filter("op = 'added'").select(*log.columns).unionByName(log.filter(F.col("seq") > up_to))


def diff(log: DataFrame, a: int, b: int) -> DataFrame:
    """What step ``b`` has over step ``a`` (``added``) and the other way round, found
    in one pass over the log instead of two states and two differences."""
    state = lambda n: F.max(F.when(F.col("seq") <= n, F.struct("seq", (F.col("op") == "removed").alias("gone"))))
    both = log.filter(F.col("seq") <= max(a, b)).groupBy(*KEYS).agg(state(a).alias("x"), state(b).alias("y"))
    held = lambda c: F.coalesce(~F.col(f"{c}.gone"), F.lit(False))
    change = F.when(~held("x") & held("y"), "added").when(held("x") & ~held("y"), "removed")
    return both.select(*KEYS, change.alias("change")).filter("change is not null")


def history(log: DataFrame) -> DataFrame:
    n = lambda op: F.count(F.when(F.col("op") == op, 1))
    return log.groupBy("scope", "seq", "step").agg(n("added").alias("added"), n("removed").alias("removed"))


def next_seq(log: DataFrame) -> DataFrame:
    return log.groupBy("scope").agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_seq"))


def latest_of_step(log: DataFrame) -> DataFrame:
    return log.groupBy("scope", "step").agg(F.max("seq").alias("seq"))


def stale(log: DataFrame, mine: str, upstream: list[str]) -> DataFrame:
    """Whether an upstream step of a scope is newer than the scope's last ``mine``."""
    own = F.coalesce(F.max(F.when(F.col("step") == mine, F.col("seq"))), F.lit(0))
    above = F.max(F.when(F.col("step").isin(upstream), F.col("seq")))
    return log.groupBy("scope").agg(F.coalesce(above > own, F.lit(False)).alias("stale"))


def broken_chains(log: DataFrame) -> DataFrame:
    """Steps whose parent is not the step before; informational."""
    from pyspark.sql import Window

    steps = log.select("scope", "seq", "parent_seq").distinct()
    before = F.coalesce(F.lag("seq").over(Window.partitionBy("scope").orderBy("seq")), F.lit(0))
    return steps.withColumn("before", before).filter("parent_seq <> before")


# --- the registry of sources -------------------------------------------------------


def pivot(records: DataFrame, fields: dict[str, str]) -> DataFrame:
    """One row per subject; the smallest value where a field has several."""
    return records.groupBy("s").agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(name) for name, p in fields.items()])


def register(known: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with the records whose slug is not there yet."""
    return known.unionByName(new.join(known.select("slug"), "slug", "left_anti"))


def remove(registry: DataFrame, gone: DataFrame) -> DataFrame:
    """The registry without the records whose slug ``gone`` names."""
    return registry.join(gone.select("slug"), "slug", "left_anti")


def status(registry: DataFrame) -> DataFrame:
    """(slug, size, added, sources): each record with its time to the second, oldest first,
    and how many there are."""
    n = registry.groupBy().agg(F.count(F.lit(1)).alias("sources"))
    # one row, whatever the size of the registry
    return registry.crossJoin(F.broadcast(n)).select("slug", "size", F.date_format("added_at", "yyyy-MM-dd'T'HH:mm:ss").alias("added"), "sources").orderBy("added", "slug")


def resolve(probes: DataFrame, registry: DataFrame) -> DataFrame:
    """(probe, slug): by path, else by content hash, else by the slug itself."""
    by = lambda column, name: registry.groupBy(F.col(column).alias(f"_{name}")).agg(F.min("slug").alias(name))
    out = probes
    for column, name in (("path", "by_path"), ("hash", "by_hash"), ("slug", "by_slug")):
        right = by(column, name)
        out = out.join(right, out[column] == right[f"_{name}"], "left").drop(f"_{name}")
    return out.select("probe", F.coalesce("by_path", "by_hash", "by_slug").alias("slug"))
