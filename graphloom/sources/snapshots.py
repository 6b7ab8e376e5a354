"""Kept states of a log, from which later states start.

A snapshot is the state after some step, the number of each scope's last step in it, and
the files of the log that it was made of. The log only grows and a scope's numbers only rise, so a
later state is the nearest snapshot that isn't beyond it and the log's tail: files that are new,
and, of a snapshot that stops at a step, later rows of the others. A snapshot is listed last,
once it is whole; snapshots are made from one another the same way.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import store
from graphloom.sources.log import SCHEMA

LIST = "id string, stop long, high long"
STATE, STEPS, FILES = "scope string, s string, p string, o string", "scope string, last long", "file string"


class Kept(NamedTuple):
    """``stop``: the step at which the snapshot stops; null if it holds all of its files."""

    id: str
    stop: int | None
    high: int


class Snapshots:
    def __init__(self, spark: SparkSession, root: str, log: str):
        self.spark, self.root, self.log = spark, root.rstrip("/"), log

    def _known(self) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/list")
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], LIST)
        return self.spark.read.schema(LIST).parquet(f"{self.root}/list")

    def nearest(self, at_seq: int | None = None) -> Kept | None:
        """The latest snapshot that holds no step after ``at_seq``."""
        fit = self._known() if at_seq is None else self._known().filter(F.col("high") <= at_seq)
        best = fit.orderBy(F.desc("high"), F.desc_nulls_first("stop"), "id").first()
        return Kept(*best) if best else None

    def _read(self, kind: str, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{kind}-{name}")

    def _rows(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("basePath", self.log).parquet(*files)

    def _files(self) -> list[str]:
        return sorted(self.spark.read.schema(SCHEMA).parquet(self.log).inputFiles())

    def state(self, at_seq: int | None = None, files: list[str] | None = None) -> DataFrame:
        """What ``store.materialize`` gives for the log, or for some of its files."""
        files = self._files() if files is None else files
        near = self.nearest(at_seq)
        if near is None:
            return store.materialize(self._rows(files), at_seq)
        known = {r["file"] for r in self._read("files", near.id, FILES).collect()}  # as many as the log has files
        tail = self._rows([f for f in files if f not in known])
        if near.stop is not None:
            tail = tail.unionByName(self._rows([f for f in files if f in known]).filter(F.col("seq") > near.stop))
        return store.resume(self._read("state", near.id, STATE), self._read("steps", near.id, STEPS), tail, at_seq)

    def write(self, at_seq: int | None = None) -> str | None:
        """Keep the state after ``at_seq``, or after all steps; of no steps nothing is kept."""
        name, files = uuid.uuid4().hex, self._files()
        rows = self._rows(files)
        rows = rows if at_seq is None else rows.filter(F.col("seq") <= at_seq)
        rows.groupBy("scope").agg(F.max("seq").alias("last")).write.parquet(f"{self.root}/steps-{name}")
        high = self._read("steps", name, STEPS).agg(F.max("last")).first()[0]
        if high is None:
            return None
        self.state(at_seq, files).write.parquet(f"{self.root}/state-{name}")
        self.spark.createDataFrame([(f,) for f in files], FILES).coalesce(1).write.parquet(f"{self.root}/files-{name}")
        self.spark.createDataFrame([(name, at_seq, high)], LIST).coalesce(1).write.mode("append").parquet(f"{self.root}/list")
        return name
