"""State that outlives batches and restarts: a breaker and a cost cap for each key, held for a job and not for a task.

The streaming form of ``ledger.circuit_breaker`` and ``ledger.running_cap``: each call is judged by all calls of its key before it, whichever
batch or run of the query they came in. Spending from before the stream is its initial state. A timer drops a key that has been silent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docquarry.session import ship_package

#: The state store that keeps such state; sessions that run these streams are configured with it.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUT = "seq long, streak long, open boolean, spent_before double, allowed boolean, late boolean"


class CallGuard(StatefulProcessor):
    """For each key: how many calls failed in a row, whether that ever reached ``threshold``, what was spent, and the last call seen."""

    def __init__(self, key: str, threshold: int, cap: float, silent_ms: int):
        self.key, self.threshold, self.cap, self.silent_ms = key, threshold, cap, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "streak long, tripped boolean, spent double, last long")

    def _now(self) -> tuple[int, bool, float, int]:
        return tuple(self.held.get()) if self.held.exists() else (0, False, 0.0, -(1 << 62))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.held.update((0, False, float(initialState["spent"].sum()), -(1 << 62)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        streak, tripped, spent, last = self._now()
        batch = pd.concat(rows).sort_values("seq", kind="stable")
        out = []
        for seq, failed, cost in zip(batch["seq"].tolist(), batch["failed"].tolist(), batch["cost"].tolist()):
            late = seq < last  # judged by what is known now, and counted
            streak_now = streak + 1 if failed else 0
            out.append((key[0], seq, streak_now, tripped, spent, spent <= self.cap, late))
            streak, spent, last = streak_now, spent + cost, max(last, seq)
            tripped = tripped or streak >= self.threshold
        self.held.update((streak, tripped, spent, last))
        if self.silent_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), int(batch["ts"].max().timestamp() * 1000)) + self.silent_ms)
        yield pd.DataFrame(out, columns=[self.key, "seq", "streak", "open", "spent_before", "allowed", "late"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def guarded(calls: DataFrame, key: str, threshold: int, cap: float, silent_hours: float = 0, spent: DataFrame | None = None, late: str = "1 hour") -> DataFrame:
    """(key, seq, streak, open, spent_before, allowed, late) of each call of a stream (key, seq, ts, failed, cost), in order of ``seq`` inside a
    batch; a call of a later batch that should have come before is ``late``. ``spent`` (key, spent): spending before the stream. Keys without a
    call for ``silent_hours`` (0: ever), by the stream's time, are forgotten."""
    ship_package(calls.sparkSession)
    kind, millis = calls.schema[key].dataType.simpleString(), int(silent_hours * 3_600_000)
    rows = calls.withWatermark("ts", late).select(key, "seq", "ts", "failed", "cost").groupBy(key)
    start = None if spent is None else spent.select(key, F.col("spent").cast("double").alias("spent")).groupBy(key)
    return rows.transformWithStateInPandas(statefulProcessor=CallGuard(key, threshold, cap, millis), outputStructType=f"{key} {kind}, {OUT}", outputMode="Append", timeMode="EventTime" if millis else "None", initialState=start)


def guard_table(calls: DataFrame, key: str, threshold: int, cap: float) -> DataFrame:
    """The same of a table in one batch: ``ledger``'s windows."""
    from docquarry.operators import ledger

    both = ledger.running_cap(ledger.circuit_breaker(calls, key, "seq", "failed", threshold), key, "seq", "cost", cap)
    return both.select(key, "seq", F.col("streak").cast("long").alias("streak"), "open", F.col("spent_before").cast("double").alias("spent_before"), "allowed", F.lit(False).alias("late"))


def run_guarded(calls: DataFrame, key: str, threshold: int, cap: float, out: str, checkpoint: str, **kwargs: object) -> None:
    """Runs ``guarded`` over what a stream holds now, appending to the folder ``out``; run again, it goes on where it ended."""
    spark = calls.sparkSession
    for k, v in STORE.items():
        spark.conf.set(k, v)
    done = guarded(calls, key, threshold, cap, **kwargs).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    done.awaitTermination()


def event_calls(events: DataFrame) -> DataFrame:
    """Events as calls: errors fail, values are costs in cents."""
    return events.select("user_id", F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"), F.floor(F.col("value") * 10).cast("double").alias("cost"))
