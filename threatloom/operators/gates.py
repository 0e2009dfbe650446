"""The launch-gate report over scan decisions: window, attempt dedup, aggregates, canaries and gates."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.functions import refdata as R
from threatloom.runtime import stage

ATTEMPT = ["message_id", "recipient_id", "injection_attempt_id"]


def parse_bound(text: str | None) -> datetime | None:
    """ISO 8601, naive as UTC; None for nothing or a bad value."""
    try:
        t = datetime.fromisoformat((text or "").replace("Z", "+00:00"))
    except ValueError:
        return None
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


def bounds_error(start: str | None, end: str | None, now: datetime) -> str | None:
    """Why a phase window is unusable: half given, unreadable, reversed or not over yet."""
    if not start and not end:
        return None
    a, b = parse_bound(start), parse_bound(end)
    if not start or not end:
        return "both bounds are needed"
    if a is None or b is None:
        return "a bound can't be read"
    if a > b:
        return "the start is after the end"
    return "the end is in the future" if b > now else None


def in_window(decisions: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Both ends belong to the window; rows without a time don't."""
    for limit, keep in ((start, lambda c, v: c >= v), (end, lambda c, v: c <= v)):
        if limit:
            decisions = decisions.where(keep(F.col("inserted_at"), F.to_timestamp(F.lit(limit))))
    return decisions


def latest_attempts(decisions: DataFrame) -> DataFrame:
    """One decision per attempt: successes first, then the latest, then the highest evaluation_id."""
    order = [(F.col("scan_status") == "success").desc_nulls_last(), F.col("inserted_at").desc_nulls_last(), F.coalesce("evaluation_id", F.lit("")).desc()]
    return decisions.withColumn("_n", F.row_number().over(Window.partitionBy(*ATTEMPT).orderBy(*order))).where("_n = 1").drop("_n")


def valid_latency(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c < float("inf"))


def nearest_index(values: DataFrame, column: str, percents: list[int]) -> DataFrame:
    """One row with p<percent> columns: the value at index floor(n * p / 100), at most n - 1; 0 without values.

    Values are counted by value first, so ranks come from a table of distinct values and never from all rows in one task.
    """
    counts = values.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    # written, so that both uses below see the same ranges
    parts = stage(counts.repartitionByRange("v").withColumn("_p", F.spark_partition_id()), "value-ranges")
    sums = parts.groupBy("_p").agg(F.sum("n").alias("s"))
    starts = sums.withColumn("start", F.coalesce(F.sum("s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("s").over(Window.partitionBy(F.lit(0))))
    run = F.sum("n").over(Window.partitionBy("_p").orderBy("v"))
    placed = parts.withColumn("_run", run).join(F.broadcast(starts), "_p").withColumn("upto", F.col("start") + F.col("_run")).withColumn("first", F.col("upto") - F.col("n"))
    at = lambda p: F.least(F.floor(F.col("total") * p / 100), F.col("total") - 1)
    return placed.agg(*(F.coalesce(F.max(F.when((F.col("first") <= at(p)) & (at(p) < F.col("upto")), F.col("v"))), F.lit(0.0)).alias(f"p{p}") for p in percents))


def effective_action() -> Column:
    return F.coalesce(F.nullif(F.col("policy_action"), F.lit("")), F.nullif(F.col("rspamd_action"), F.lit("")), F.lit("unknown"))


def action_breakdown(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy(effective_action().alias("action")).agg(F.count("*").alias("n"))


def canary_pass(canaries: DataFrame, now: Column) -> DataFrame:
    """passed per row of (clean, spam, phishing, timestamp): all three true, no older than 900 s, no more than 60 s ahead."""
    age = F.unix_timestamp(now) - F.unix_timestamp("timestamp")
    ok = F.coalesce(F.col("clean") & F.col("spam") & F.col("phishing"), F.lit(False))
    return canaries.withColumn("age_s", age).withColumn("passed", ok & F.coalesce(age.between(-R.CANARY_SKEW, R.CANARY_MAX_AGE), F.lit(False)))


def gate_report(decisions: DataFrame, receptions: int | None, canary_ok: bool, start: str | None = None, end: str | None = None, bounded: bool = True) -> DataFrame:
    """One row: counts, coverage, latency, days and the five gates. Only shadow-mode decisions count.

    bounded: more scans than receptions are inconsistent and leave the coverage unknown; else it is the plain ratio.
    """
    scans = latest_attempts(in_window(decisions.where("scan_mode = 'shadow'"), start, end))
    good = F.col("scan_status") == "success"
    totals = scans.agg(
        F.count("*").alias("total_scans"),
        F.count_if(good).alias("successful_scans"),
        F.count_if(F.col("scan_status") == "error").alias("failed_scans"),
        F.count_if(good & valid_latency(F.col("scan_time_ms"))).alias("valid_latencies"),
        F.coalesce(F.floor((F.unix_timestamp(F.max("inserted_at")) - F.unix_timestamp(F.min("inserted_at"))) / 86400) + 1, F.lit(0)).cast("long").alias("observation_days"),
    )
    if start and end:
        totals = totals.withColumn("observation_days", F.lit((parse_bound(end) - parse_bound(start)).days + 1).cast("long"))
    latency = nearest_index(scans.where(good & valid_latency(F.col("scan_time_ms"))), "scan_time_ms", [50, 99])
    n = F.lit(receptions).cast("long")
    known = (n > 0) & (F.col("successful_scans") <= n) if bounded else n > 0
    coverage = F.when(known, F.col("successful_scans") / n)
    complete = F.when(F.col("successful_scans") > 0, F.col("valid_latencies") / F.col("successful_scans")).otherwise(0.0)
    out = totals.crossJoin(latency).withColumns({"coverage": coverage, "latency_completeness": complete})
    gates = {
        "gate_canary": F.lit(bool(canary_ok)),
        "gate_coverage": F.coalesce(F.col("coverage") > R.GATE_COVERAGE, F.lit(False)),
        "gate_latency": (F.col("latency_completeness") == 1.0) & (F.col("valid_latencies") > 0) & (F.col("p99") < R.GATE_P99_MS),
        "gate_samples": F.col("total_scans") >= R.GATE_SAMPLES,
        "gate_days": F.col("observation_days") >= R.GATE_DAYS,
    }
    out = out.withColumns(gates)
    # a detection-quality gate outside this report must also be met, so it never says ready by itself
    return out.withColumn("operational_gates_passed", F.col("gate_canary") & F.col("gate_coverage") & F.col("gate_latency") & F.col("gate_samples") & F.col("gate_days")).withColumn("ready_for_next_phase", F.lit(False))


def canary_totals(checks: DataFrame, *by: str) -> DataFrame:
    """checks (ok boolean, null counts as failed) -> passed, failed and exit_status (0: all passed), per group if any."""
    ok = F.coalesce("ok", F.lit(False))
    out = checks.groupBy(*by).agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))
    return out.withColumn("exit_status", F.when(F.col("failed") == 0, 0).otherwise(1))
