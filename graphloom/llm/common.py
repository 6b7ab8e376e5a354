"""Helpers shared by the corpus operators: shared storage and column hygiene."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that go to Python at once, and bytes of text that it works on at once.
BATCH_ROWS, BATCH_BYTES, SLICE_BYTES = 2000, 8 << 20, 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    ``spark.checkpoint.dir`` names it on a cluster, and must; only on one machine (in
    tests) a temporary folder of our own is used where it is unset.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage.

    Parquet keeps columns apart, so later readers prune them, and the files
    outlive any executor. They go when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``materialize`` result that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def text_or_empty(name: str = "text") -> Column:
    """A string column with null read as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder, by a path only Spark needs to open."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` itself, in a session whose Arrow batches are bounded in rows and bytes; a
    smaller bound that is set already stays. A single long row may exceed it."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        set_to = int(str(df.sparkSession.conf.get(name)).removesuffix("b"))
        if not 0 < set_to <= most:
            df.sparkSession.conf.set(name, str(most))
    return df


def byte_slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``most`` bytes of ``text``, or one row. Whatever type
    the other columns have, their values stay as they are, nulls and large numbers too."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows on end that agree in ``keys``, across the batches' borders."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        if held:
            new[0] = any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != c[0] for k, c in zip(keys, columns))
        at = [*np.flatnonzero(new).tolist(), b.num_rows]
        if at[0]:
            held.append(b.slice(0, at[0]))
        for i, j in zip(at, at[1:]):
            if held:
                yield pa.Table.from_batches(held)
            held = [b.slice(i, j - i)]
    if held:
        yield pa.Table.from_batches(held)
