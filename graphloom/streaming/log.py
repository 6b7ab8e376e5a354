"""The delta log as a stream: what holds now, kept up to date as steps arrive.

A step may arrive late or twice; the operation with the highest number wins, whatever
the order, so the state is a maximum and the batch result its contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.store import KEYS
from graphloom.sources.log import SCHEMA


def read_log_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def live_state(log: DataFrame) -> DataFrame:
    """The streaming form of ``materialize``: (keys, seq, live) in update mode."""
    last = F.max(F.struct("seq", (F.col("op") == "removed").alias("gone"))).alias("last")
    return log.groupBy(*KEYS).agg(last).select(*KEYS, F.col("last.seq").alias("seq"), (~F.col("last.gone")).alias("live"))


def start_state(log: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """An in-memory table of the state, for tests and small logs."""
    return live_state(log).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def start_sink(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every batch's new state rows to a table; readers take the highest seq."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(path)

    return live_state(log).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).start()


def step_progress(log: DataFrame) -> DataFrame:
    """The latest number of each step, from which staleness follows."""
    return log.groupBy("scope", "step").agg(F.max("seq").alias("seq"))
