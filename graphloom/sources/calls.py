"""Questions put to a service outside, through a client that the caller brings.

Answers are kept in a table, and a key is asked once: what the table has is not asked again, so
that a run that was stopped, or in which some calls failed, is gone on with by calling again. Requests go
out in lots, each a job that adds its rows to the table, and in lanes, which keep to a rate.
A lane in which a service refuses three times on end asks no more in that lot.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, answer string, status string, error string, tries int"
#: Refusals on end after which a lane stops, seconds to wait where a refusal
#: doesn't say, and seconds between calls.
REFUSALS, WAIT, INTERVAL = 3, 60.0, 0.5


class Refused(Exception):
    """The service has too much to do; ``after`` seconds may be said."""

    def __init__(self, after: float | None = None):
        super().__init__("refused")
        self.after = after


def _lane(rows: pd.DataFrame, ask: Callable[[str], str], pause: float, tries: int, wait: Callable[[float], None]) -> Iterator[tuple]:
    refused, last = 0, None
    for key, request in zip(rows["key"], rows["request"]):
        error, done = None, 0
        while done < tries and refused < REFUSALS:
            if last is not None and (left := pause - (time.monotonic() - last)) > 0:
                wait(left)
            last, done = time.monotonic(), done + 1
            try:
                answer = ask(request)
                refused = 0
                yield key, answer, "ok", None, done
                break
            except Refused as e:
                refused, error = refused + 1, "refused"
                if refused < REFUSALS:
                    wait(WAIT if e.after is None else e.after)
            except Exception as e:  # noqa: BLE001  whatever a client raises is that call's outcome
                error = f"{type(e).__name__}: {e}"[:500]
        else:
            yield key, None, "failed" if done else "skipped", error, done


def answers(spark: SparkSession, path: str) -> DataFrame:
    """The table's answers, one row for each key that has one."""
    return _table(spark, path).filter("status = 'ok'").groupBy("key").agg(F.min("answer").alias("answer"))


def _table(spark: SparkSession, path: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def ask(
    requests: DataFrame, client: Callable[[], Callable[[str], str]], path: str, lots: int = 1, lanes: int = 4, interval: float = INTERVAL, tries: int = 2, wait: Callable[[float], None] = time.sleep
) -> dict[str, int]:
    """Ask for all of ``requests`` (key, request) that ``path`` has no answer to, and return how
    many of their keys have which outcome by now: ok, failed, or skipped once a lane had stopped.

    ``client`` is called in each lane and gives a callable from a request to its answer, which raises
    ``Refused`` for a refusal and anything else for a failure; a failure is tried ``tries``
    times in all. All lanes together keep to a call every ``interval`` seconds. Null keys and
    requests are left out; of several requests under one key the smallest is asked. A task that Spark
    runs again asks again.
    """
    spark = requests.sparkSession
    wanted = requests.select(F.col("key").cast("string").alias("key"), F.col("request").cast("string").alias("request")).dropna().groupBy("key").agg(F.min("request").alias("request"))
    pause, counts = interval * lanes, {}

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = list(_lane(rows.sort_values("key"), client(), pause, tries, wait))
        return pd.DataFrame(made, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    for lot in range(lots):
        own = wanted.filter(F.pmod(F.xxhash64("key"), F.lit(lots)) == lot)
        todo = own.join(answers(spark, path).select("key"), "key", "left_anti").withColumn("lane", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(lanes)).cast("int"))
        # written straight away: whatever else looked at these rows would ask again
        todo.groupBy("lane").applyInPandas(run, SCHEMA).write.mode("append").parquet(path)
    for r in _table(spark, path).join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.max_by("status", F.when(F.col("status") == "ok", 2).when(F.col("status") == "failed", 1).otherwise(0)).alias("status")).groupBy("status").count().collect():
        counts[r["status"]] = r["count"]
    return counts
