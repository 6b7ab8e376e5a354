"""Whitening of vectors by a one-sided Jacobi decomposition.

Rows, once centred, go through a blockwise QR: each task folds its blocks into one small
triangle R, and triangles are folded sixteen by sixteen until few are left. R has the
rows' covariance (R'R over the rows' number) and nothing of their number. Plane rotations
then make R's columns orthogonal; the rotations, accumulated, are the components, and the
columns' lengths over the root of the row number are the standard deviations. No
covariance matrix is formed, so small deviations keep their digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, small_batches

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Partial results that one task folds.
FAN_IN = 16
#: Entries that are larger than this can't be exact whole numbers afterwards.
LARGEST = float(1 << 43)


def whole_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x): the vectors in whole numbers. Those that are null or hold null, non-finite
    or too large entries (over 2^43) are left out, as are those without entries."""
    v = F.col(vector).cast("array<double>")
    whole = df.select(F.col(key).alias("id"), v.alias("v")).filter((F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(F.abs(c) <= LARGEST, F.lit(False)) & ~F.isnan(c)))
    return whole.select("id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def folded(parts: DataFrame, fold: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
    """One array out of a table (i, v) of partial ones, folded in a tree. The last
    ``FAN_IN`` arrays at most come to the driver."""

    def step(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "v": [fold([np.asarray(v) for v in rows.sort_values("i")["v"]])]})

    parts = materialize(parts, "partial")
    while parts.count() > FAN_IN:
        up = parts.select("i", "v", F.floor(F.col("i") / FAN_IN).cast("int").alias("up"))
        parts = materialize(up.groupBy("up").applyInPandas(step, "i int, v array<double>"), "partial")
    return fold([np.asarray(r["v"]) for r in sorted(parts.collect(), key=lambda r: r["i"])])


def _each_part(rows: DataFrame, start: Callable[[], list], add: Callable[[list, np.ndarray], None], result: Callable[[list], np.ndarray]) -> DataFrame:
    """(i, v) of every partition that has rows: what ``add`` has made of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state, seen = start(), False
        for b in batches:
            if b.num_rows:
                add(state, b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                seen = True
        if seen:
            yield pa.RecordBatch.from_pydict({"i": pa.array([TaskContext.get().partitionId()], pa.int32()), "v": pa.array([result(state)], pa.list_(pa.float64()))})

    return small_batches(rows).select("x").mapInArrow(run, "i int, v array<double>")


class Centre:
    """Takes the mean off whole rows: first its whole part, without rounding."""

    def __init__(self, sums: list[int], n: int):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]
        self.part = np.array([r / n for r in self.rest])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums of (n * x - S)^2, exact."""
        y, rest = x - self.whole, np.array(self.rest, object)
        if float(np.abs(y).max(initial=0) + 1) * self.n < (1 << 62) ** 0.5 / x.shape[1] ** 0.5:
            y = y * self.n - rest.astype(np.int64)
            return (y * y).sum(1).tolist()
        y = y.astype(object) * self.n - rest
        return (y * y).sum(1).tolist()


def triangle(rows: DataFrame, centre: Centre) -> np.ndarray:
    """R of the centred rows. A task holds ``FAN_IN`` triangles and one block at a time."""
    d = len(centre.sums)
    fold = lambda rs: np.linalg.qr(np.vstack([r.reshape(-1, d) for r in rs]), mode="r").ravel()

    def add(state: list, x: np.ndarray) -> None:
        state[:] = [fold([*state, centre(x)])]

    return folded(_each_part(rows, list, add, lambda s: s[0]), fold).reshape(-1, d)


def jacobi(r: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of R's columns once they are orthogonal, falling, and the unit
    components as columns. Disjoint pairs of columns turn at the same time."""
    d = r.shape[1]
    a, v = np.vstack([r, np.zeros((max(0, d - len(r)), d))]), np.eye(d)
    ring = list(range(d + d % 2))
    for _ in range(most_sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            pairs = [(i, j) for i, j in zip(ring[: len(ring) // 2], ring[::-1]) if i < d and j < d]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            i, j = np.array(pairs).T
            x, y = a[:, i], a[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            now = np.abs(xy) > 1e-15 * np.sqrt(xx * yy)
            if not now.any():
                continue
            turned = True
            i, j, xx, yy, xy = i[now], j[now], xx[now], yy[now], xy[now]
            z = (yy - xx) / (2 * xy)
            t = np.where(z < 0, -1.0, 1.0) / (np.abs(z) + np.hypot(1, z))
            c = 1 / np.hypot(1, t)
            s = c * t
            for m in (a, v):
                x, y = m[:, i], m[:, j]
                m[:, i], m[:, j] = c * x - s * y, s * x + c * y
        if not turned:
            break
    length = np.sqrt((a * a).sum(0))
    by = np.argsort(-length, kind="stable")
    return length[by], v[:, by] / np.sqrt((v[:, by] ** 2).sum(0))


def _moments(parts: list[np.ndarray], k: int) -> np.ndarray:
    """Count, means and centred products of all parts, from those of each."""
    n, mean, m2 = 0.0, np.zeros(k), np.zeros((k, k))
    for p in parts:
        pn, pm, p2 = p[0], p[1 : k + 1], p[k + 1 :].reshape(k, k)
        gap = pm - mean
        mean, m2 = mean + gap * pn / (n + pn), m2 + p2 + np.outer(gap, gap) * n * pn / (n + pn)
        n += pn
    return np.concatenate([[n], mean, m2.ravel()])


def whiten(df: DataFrame, components: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (key, component, n, deviation, whitened, explained, identity_error) of each
    vector and component, at most ``components``, by falling variance.

    Left out are vectors that are null, without entries, or hold null, non-finite or too
    large entries, and those whose length isn't the commonest one (of equally common
    lengths, the longest). Components without variance aren't returned, so that a
    single vector, equal vectors and empty tables give no rows. Equal rows count as often
    as they come; null keys stay. ``deviation`` is a decimal of 38 digits. Other columns
    are not read. A task holds 16 triangles of as many numbers as a vector has, squared.
    """
    kind = df.schema[key].dataType
    rows = materialize(whole_vectors(df, key, vector), "whole")
    out = pa.schema([("component", pa.int32()), ("deviation", pa.string()), ("whitened", pa.float64())])
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    n, d = (lengths["count"], lengths["d"]) if lengths else (0, 0)
    rows = rows.filter(F.size("x") == d)
    sums = rows.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(20,0)")).alias("s")).collect() if n else []
    centre = Centre([int(r["s"]) for r in sorted(sums)], n)
    lengths, v = jacobi(triangle(rows, centre)) if n else (np.zeros(0), np.zeros((0, 0)))
    k = min(components, int((lengths > lengths.max(initial=0) * d * np.finfo(float).eps).sum()))
    turn, error = v[:, :k] * (np.sqrt(n) / lengths[:k]), 0.0
    explained = (lengths[:k] ** 2 / (lengths**2).sum()).tolist() if k else []
    if k:

        def add(state: list, x: np.ndarray) -> None:
            w = centre(x) @ turn
            mean = w.mean(0)
            state[:] = [_moments([*state, np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()])], k)]

        whole = folded(_each_part(rows, list, add, lambda s: s[0]), lambda parts: _moments(parts, k))
        error = float(np.abs(whole[k + 1 :].reshape(k, k) / n - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and k:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                ids = b.column("id").take(pa.array(np.repeat(np.arange(len(x)), k)))
                numbers = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.repeat([str(y) for y in centre.deviations(x)], k)), pa.array((centre(x) @ turn).ravel())]
                yield pa.RecordBatch.from_arrays([ids, *numbers], schema=pa.schema([b.schema.field("id"), *out]))

    each = small_batches(rows).mapInArrow(project, f"id {kind.simpleString()}, component int, deviation string, whitened double")
    shares = F.element_at(F.array(*[F.lit(e) for e in explained or [0.0]]), F.col("component"))
    return each.select(
        F.col("id").alias(key), "component", F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        "whitened", shares.alias("explained"), F.lit(error).alias("identity_error"),
    )
