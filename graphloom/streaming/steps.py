"""Which steps have to run again, kept up as the log grows: a state machine by scope.

A step's output is stale once one of its upstream steps has a higher number than its own
last one. Each scope keeps the highest number of every step and what was last said of it, so
rows may come late, twice or in any order: a number below the highest changes nothing,
and what is put out is only what changed. The batch ``store.stale`` is its contract.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "scope string, step string, stale boolean, seq long, upstream long"


class Staleness(StatefulProcessor):
    """``upstream`` maps a step to those it is made from, one or more; what they are made from counts
    too, if ``cascade``: a step fires again when anything before it has."""

    def __init__(self, upstream: dict[str, list[str]], cascade: bool = True):
        self.before = {s: set(u) for s, u in upstream.items()}
        while cascade:
            more = {s: u | {w for v in u for w in self.before.get(v, ())} for s, u in self.before.items()}
            if any(s in u for s, u in more.items()):
                raise ValueError("steps are made from each other in a circle")
            if more == self.before:
                break
            self.before = more

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "step string", "seq long")
        self.said = handle.getMapState("said", "step string", "stale boolean, seq long, upstream long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        highest: dict[str, int] = {}
        for b in rows:
            for step, seq in b.groupby("step")["seq"].max().items():
                highest[step] = max(int(seq), highest.get(step, 0))
        moved = False
        for step, seq in highest.items():
            known = self.last.getValue((step,)) if self.last.containsKey((step,)) else None
            if known is None or known[0] < seq:
                self.last.updateValue((step,), (seq,))
                moved = True
        if moved:
            yield from self._changes(key[0])

    def _changes(self, scope: str) -> Iterator[pd.DataFrame]:
        last = {k[0]: v[0] for k, v in self.last.iterator()}
        out = []
        for step, before in self.before.items():
            own, above = last.get(step, 0), max((last.get(u, 0) for u in before), default=0)
            now = (above > own, own, above)
            then = tuple(self.said.getValue((step,))) if self.said.containsKey((step,)) else None
            if then != now and (then is not None or own or above):
                self.said.updateValue((step,), now)
                out.append((scope, step, *now))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def stale_steps(log: DataFrame, upstream: dict[str, list[str]], cascade: bool = True) -> DataFrame:
    """Of a log as a stream: a row of OUT whenever what is said of a step changes. Needs the
    RocksDB state store."""
    steps = log.select("scope", "step", F.col("seq").cast("long").alias("seq"))
    return steps.groupBy("scope").transformWithStateInPandas(Staleness(upstream, cascade), OUT, "Update", "None")


class LastOperation(StatefulProcessor):
    """The last operation on each triple; a row whenever it begins or ends to hold."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, gone boolean, said boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, gone, said = self.last.get() if self.last.exists() else (-1, True, False)
        for b in rows:
            # within one step removals come after additions
            best = max(zip(b["seq"], b["op"] == "removed"))
            seq, gone = max((seq, gone), (int(best[0]), bool(best[1])))
        self.last.update((seq, gone, not gone))
        if said == gone:
            yield pd.DataFrame([(*key, seq, not gone)], columns=["scope", "s", "p", "o", "seq", "live"])

    def close(self) -> None:
        pass


def changes(log: DataFrame) -> DataFrame:
    """Of a log as a stream: (scope, s, p, o, seq, live), a row whenever a triple comes to hold or
    ceases to. Rows may come late and twice."""
    return log.select("scope", "s", "p", "o", "seq", "op").groupBy("scope", "s", "p", "o").transformWithStateInPandas(
        LastOperation(), "scope string, s string, p string, o string, seq long, live boolean", "Update", "None"
    )


def start(frame: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what ``stale_steps`` or ``changes`` puts out to a table, a folder for each batch, which a
    batch that is run again overwrites."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return frame.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).start()


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of a table that ``start`` has written the last row of each key."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")
