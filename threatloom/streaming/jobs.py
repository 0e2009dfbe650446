"""Structured Streaming: continuous scans, windowed counts, sessions, learn caps, attempt dedup and the learn-rate state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threatloom.operators import bayes
from threatloom.sources import files
from threatloom.streaming.state import not_ahead


def _timed(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a timestamp with a zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "5 minutes", late: str = "15 minutes") -> DataFrame:
    """Tumbling counts and sums; in a stream rows later than the watermark are dropped, and so are rows whose clock is more
    than a minute ahead."""
    out = _timed(not_ahead(events, ts), ts).withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "15 minutes") -> DataFrame:
    out = _timed(events, ts).withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def daily_learns(events: DataFrame, ts: str, account: str, late: str = "1 hour") -> DataFrame:
    out = _timed(events, ts).withWatermark(ts, late).groupBy(F.window(ts, "1 day"), account).agg(F.count("*").alias("learns"))
    return out.select(F.col("window.start").alias("day"), account, "learns")


def best_attempts(decisions: DataFrame, ts: str = "inserted_at", late: str = "1 hour") -> DataFrame:
    """One decision per attempt: a success wins, then the latest, then the highest evaluation_id.

    An attempt is a session that ends when nothing of it came for `late`, so no clock hour splits it; a stream gives it out
    once, when the watermark has passed its end.
    """
    rank = F.struct((F.col("scan_status") == "success").alias("ok"), F.col(ts).alias("at"), F.coalesce("evaluation_id", F.lit("")).alias("eval"), F.col("scan_time_ms").alias("ms"))
    out = _timed(decisions, ts).withWatermark(ts, late).groupBy(F.session_window(ts, late), "message_id", "recipient_id", "injection_attempt_id").agg(F.max(rank).alias("best"))
    return out.select("message_id", "recipient_id", "injection_attempt_id", F.col("best.ok").alias("ok"), F.col("best.eval").alias("evaluation_id"), F.col("best.ms").alias("scan_time_ms"))


RATE = "series string, epoch long, rate double, reset boolean"


def learn_rates(samples: DataFrame) -> DataFrame:
    """Learns per hour from cumulative samples (series, epoch, spam, ham), kept across micro-batches; a fall is a reset."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        out = []
        for row in sorted((tuple(map(int, r)) for f in frames for r in f[["epoch", "spam", "ham"]].itertuples(index=False))):
            if last is not None:
                reset = row[1] < last[1] or row[2] < last[2]
                dt = row[0] - last[0]
                out.append((key[0], row[0], None if reset or dt <= 0 else round((row[1] + row[2] - last[1] - last[2]) * 3600 / dt, 2), reset))
            last = row
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=["series", "epoch", "rate", "reset"])

    return samples.groupBy("series").applyInPandasWithState(step, RATE, "epoch long, spam long, ham long", "append", GroupStateTimeout.NoTimeout)


def run_scan(stream: DataFrame, scan: Callable[[DataFrame], DataFrame], reload: Callable[[], DataFrame] | None, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, load: Callable[[], float] | None = None) -> StreamingQuery:
    """Scan a stream of messages batch by batch; `reload` reads the reference list anew each batch, and the last good copy
    serves if that fails. `load` is asked before each batch and put beside the messages, so that the scan sheds reading
    pictures while it is high; the number of messages a batch is the source's (maxFilesPerTrigger)."""
    held: dict = {}

    def batch(df: DataFrame, n: int) -> None:
        if load is not None:
            df = df.withColumn("load", F.lit(float(load())))
        if reload is not None:
            try:
                fresh = reload()
                fresh.limit(1).count()
                held["list"] = fresh
            except Exception:
                if "list" not in held:
                    raise
            sink(scan(df, held["list"]), n)
        else:
            sink(scan(df), n)

    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")).start()


def autolearn_sink(base: str, feature: Callable[[Column], Column], condition: Column | None = None) -> Callable[[DataFrame, int], None]:
    """A sink of verdicts (text, score, fired) that teaches the token table published under `base`.

    Every batch gives a new version; the row of the null token counts messages and names the last batch, so a batch that is
    handed over again after a failure is not learnt twice.
    """

    def learn(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        old = files.current(spark, base) if files.exists(spark, base) else spark.createDataFrame([(None, 0, 0, -1)], "token string, spam long, ham long, batch long")
        totals = old.where("token is null").first()
        if totals["batch"] >= n:
            return
        new = bayes.autolearn(df, totals["spam"], totals["ham"], feature(F.col("text")), bayes.words(F.col("text")), condition)
        both = old.select("token", "spam", "ham").unionByName(new).groupBy("token").agg(F.sum("spam").alias("spam"), F.sum("ham").alias("ham"))
        files.publish(both.withColumn("batch", F.when(F.col("token").isNull(), F.lit(n).cast("long"))), base)

    return learn
