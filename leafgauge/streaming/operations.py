"""Streams of operation events: final states per operation, windowed counts, stage logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "operation string, state string, warnings long"


class FinalState(StatefulProcessor):
    """Emits an operation's state once: that of its first end (by ``ts`` within a batch, if there is one) with the warnings before it, timed-out after the deadline, if there is one."""

    def __init__(self, deadline_ms: int | None = None):
        self.deadline_ms = deadline_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "warnings long, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        warnings, done = self.seen.get() if self.seen.exists() else (0, False)
        if self.deadline_ms is not None and not self.seen.exists():
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.deadline_ms)
        got = pd.concat(list(rows))
        if "ts" in got:  # otherwise in the order of arrival
            got = got.sort_values("ts", kind="stable")
        kinds = got["kind"].tolist()
        end = next((i for i, k in enumerate(kinds) if k in ("failed", "finished")), None)
        state = None if end is None else kinds[end]
        if not done:
            warnings += kinds[:end].count("warning")
        emit = state is not None and not done
        self.seen.update((int(warnings), bool(done or emit)))
        if emit:
            yield pd.DataFrame({"operation": [str(key[0])], "state": [state], "warnings": [int(warnings)]})

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[pd.DataFrame]:
        warnings, done = self.seen.get() if self.seen.exists() else (0, False)
        self.seen.clear()
        if not done:
            yield pd.DataFrame({"operation": [str(key[0])], "state": ["timed-out"], "warnings": [int(warnings)]})

    def close(self) -> None:
        pass


def final_states(events: DataFrame, deadline_ms: int | None = None) -> DataFrame:
    """One row for each operation of a stream (operation, kind) when its end is known.

    With a deadline an operation without an end comes out as timed-out; its timers keep the
    query running batches.
    """
    mode = "None" if deadline_ms is None else "ProcessingTime"
    return events.groupBy("operation").transformWithStateInPandas(statefulProcessor=FinalState(deadline_ms), outputStructType=OUT, outputMode="Append", timeMode=mode)


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts per window and kind; rows later than ``late`` behind the newest don't change closed windows."""
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(win.alias("w"), kind).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "events")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a key: events no more than ``gap`` apart."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "events")


def stage_totals(log: DataFrame) -> DataFrame:
    """Runs, failures and time of each stage of an append-only stage log."""
    return log.groupBy("stage").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("duration_ms").alias("duration_ms"))
