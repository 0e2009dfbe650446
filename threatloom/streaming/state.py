"""Keyed state with timers: one decision per attempt however late its retries, and drift from a baseline that stays.

Processors for transformWithState; they need the RocksDB state store (`use_keyed_state`). Batches have the same results from
gates.latest_attempts and monitor.drift.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threatloom.functions import refdata as R

HOUR = 3_600_000
DECIDED = "message_id string, recipient_id string, injection_attempt_id string, ok boolean, evaluation_id string, scan_time_ms double"
DRIFT = "series string, epoch long, spam_share double, drift double, drift_alert boolean"


def use_keyed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Attempts(StatefulProcessor):
    """Holds an attempt's best decision from its first event on and gives it out once, `hold` later; events after that don't
    count, whichever batch brings them. The key is then remembered for `remember`, so that a later retry gives nothing more."""

    def __init__(self, hold_ms: int, remember_ms: int) -> None:
        self.hold_ms, self.remember_ms = hold_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "ok boolean, at long, evaluation_id string, ms double, first long")
        self.done = handle.getValueState("done", "given boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            for _ in rows:
                pass
            yield pd.DataFrame()
            return
        events = sorted(((int(at), bool(ok), evaluation or "", None if pd.isna(ms) else float(ms)) for frame in rows for ok, at, evaluation, ms in frame[["ok", "at", "evaluation_id", "scan_time_ms"]].itertuples(index=False)), key=lambda e: e[:3])
        held = self.best.get() if self.best.exists() else None
        first = events[0][0] if held is None else held[4]
        for at, ok, evaluation, ms in events:
            if at <= first + self.hold_ms and (held is None or (ok, at, evaluation) > tuple(held[:3])):
                held = (ok, at, evaluation, ms, first)
        if not self.best.exists():
            # times are the events' own; a timer in the past fires with the next batch
            self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs()) + self.hold_ms)
        self.best.update(tuple(held))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            self.done.clear()
            yield pd.DataFrame()
            return
        ok, _, evaluation, ms, _ = self.best.get()
        self.best.clear()
        self.done.update((True,))
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.remember_ms)
        yield pd.DataFrame({"message_id": [key[0]], "recipient_id": [key[1]], "injection_attempt_id": [key[2]], "ok": [ok], "evaluation_id": [evaluation], "scan_time_ms": [ms]})

    def close(self) -> None:
        pass


def one_decision(decisions: DataFrame, ts: str = "inserted_at", late: str = "10 minutes", hold_hours: float = 6, remember_hours: float = 168) -> DataFrame:
    """A stream of decisions to one row per attempt: a success wins, then the latest, then the highest evaluation_id."""
    timed = decisions.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    rows = timed.select("message_id", "recipient_id", "injection_attempt_id", ts, F.coalesce(F.col("scan_status") == "success", F.lit(False)).alias("ok"), F.unix_millis(ts).alias("at"), "evaluation_id", "scan_time_ms")
    return rows.groupBy("message_id", "recipient_id", "injection_attempt_id").transformWithStateInPandas(Attempts(int(hold_hours * HOUR), int(remember_hours * HOUR)), DECIDED, "Append", "EventTime")


class Drift(StatefulProcessor):
    """The spam share's distance from the series' baseline: its first sample that isn't empty, or the one it starts with."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.baseline = handle.getValueState("baseline", "spam_share double")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.baseline.update((float(initialState["spam_share"].iloc[0]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for frame in rows:
            for epoch, spam, ham in frame[["epoch", "spam", "ham"]].sort_values("epoch").itertuples(index=False):
                share = round(spam / (spam + ham), 6) if spam + ham else None
                if share is not None and not self.baseline.exists():
                    self.baseline.update((share,))
                drift = None if share is None or not self.baseline.exists() else round(abs(share - self.baseline.get()[0]), 6)
                out.append((key[0], int(epoch), share, drift, drift is not None and drift > R.MAX_DRIFT))
        yield pd.DataFrame(out, columns=["series", "epoch", "spam_share", "drift", "drift_alert"])

    def close(self) -> None:
        pass


def drift(samples: DataFrame, baselines: DataFrame | None = None) -> DataFrame:
    """Drift of a stream of samples (series, epoch, spam, ham); `baselines` (series, spam_share) of a batch start the state."""
    start = baselines.groupBy("series") if baselines is not None else None
    return samples.groupBy("series").transformWithStateInPandas(Drift(), DRIFT, "Append", "None", start)


# --- two streams ------------------------------------------------------------------------------------------------------


def not_ahead(rows: DataFrame, ts: str, seconds: int = R.CANARY_SKEW) -> DataFrame:
    """Rows whose clock is at most `seconds` ahead of ours; others would hold the watermark up."""
    return rows.where(F.col(ts).cast("timestamp") <= F.current_timestamp() + F.expr(f"interval {int(seconds)} seconds"))


def covered(receptions: DataFrame, decisions: DataFrame, within: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """(message_id, received_at, decided_at) of receptions (message_id, received_at), decided_at being the decision
    (message_id, decided_at) that came within the bound; a stream gives null once the bound and the watermark have passed.

    Repeated decisions of a message give a row each; callers that want one use one_decision before.
    """
    ours = receptions.select("message_id", F.col("received_at").cast("timestamp").alias("received_at")).withWatermark("received_at", late).alias("r")
    theirs = decisions.select(F.col("message_id").alias("_of"), F.col("decided_at").cast("timestamp").alias("decided_at")).withWatermark("decided_at", late).alias("d")
    bound = F.expr(f"message_id = _of AND decided_at >= received_at AND decided_at <= received_at + interval {within}")
    return ours.join(theirs, bound, "left_outer").select("message_id", "received_at", "decided_at")


def coverage(receptions: DataFrame, decisions: DataFrame, within: str = "15 minutes", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, received, decided) by window of reception."""
    rows = covered(receptions, decisions, within, late)
    counts = rows.groupBy(F.window("received_at", width)).agg(F.count("*").alias("received"), F.count("decided_at").alias("decided"))
    return counts.select(F.col("window.start").alias("start"), "received", "decided")
