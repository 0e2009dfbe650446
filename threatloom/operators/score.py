"""Scores, actions and rollout modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.functions import refdata as R


def weights(spark: SparkSession, candidates: bool = False) -> DataFrame:
    """symbol, weight, one_shot, group: the registry as a bounded table; candidates switches rules under review on."""
    table = R.WEIGHTS | (R.CANDIDATE_WEIGHTS if candidates else {})
    return spark.createDataFrame([(k, v, k in R.ONE_SHOT, R.GROUPS.get(k, "")) for k, v in table.items()], "symbol string, weight double, one_shot boolean, group string")


def score(symbols: DataFrame, registry: DataFrame, disabled: list[str] | None = None, groups: list[str] | None = None) -> DataFrame:
    """(message_id, score, fired): weight x multiplier over enabled symbols; a one-shot symbol counts once."""
    live = registry.where(~F.col("symbol").isin(R.SENDER_IP_SYMBOLS if disabled is None else disabled) & ~F.col("group").isin(R.DISABLED_GROUPS if groups is None else groups))
    once = (
        symbols.join(F.broadcast(live), "symbol")
        .groupBy("message_id", "symbol", "weight", "one_shot")
        .agg(F.sum("multiplier").alias("_sum"), F.max("multiplier").alias("_max"))
    )
    part = F.col("weight") * F.when(F.col("one_shot"), F.col("_max")).otherwise(F.col("_sum"))
    return once.groupBy("message_id").agg(F.sum(part).alias("score"), F.array_sort(F.collect_list("symbol")).alias("fired"))


def score_row(symbols: Column, disabled: list[str] | None = None, groups: list[str] | None = None, candidates: bool = False) -> tuple[Column, Column]:
    """(score, fired) of one row's array of (symbol, multiplier), as `score` has them, without a join or a shuffle.

    For messages whose symbols are all in one row; the registry is a constant of the plan. Nulls and unknown symbols count
    nothing, and a row without symbols scores 0.
    """
    off, off_groups = R.SENDER_IP_SYMBOLS if disabled is None else disabled, R.DISABLED_GROUPS if groups is None else groups
    table = R.WEIGHTS | (R.CANDIDATE_WEIGHTS if candidates else {})
    live = {k: v for k, v in table.items() if k not in off and R.GROUPS.get(k, "") not in off_groups}
    weight = F.create_map(*(F.lit(x) for k, v in live.items() for x in (k, float(v))))
    one_shot = F.array(*(F.lit(k) for k in live if k in R.ONE_SHOT)).cast("array<string>")
    known = F.filter(F.coalesce(symbols, F.array()), lambda x: F.map_contains_key(weight, F.coalesce(x["symbol"], F.lit(""))))
    fired = F.array_sort(F.array_distinct(F.transform(known, lambda x: x["symbol"])))

    def part(name: Column) -> Column:
        own = F.filter(F.transform(F.filter(known, lambda x: x["symbol"] == name), lambda x: x["multiplier"].cast("double")), lambda x: x.isNotNull())
        total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return weight[name] * F.when(F.array_contains(one_shot, name), F.coalesce(F.array_max(own), F.lit(0.0))).otherwise(total)

    return F.aggregate(fired, F.lit(0.0), lambda a, n: a + part(n)), fired


def action(score_col: Column, profile: str) -> Column:
    limits = R.PROFILES[profile]
    return F.when(score_col >= limits["reject"], "reject").when(score_col >= limits["add_header"], "add_header").otherwise("no_action")


def policy(mode: str, act: Column, score_col: Column, fired: Column) -> Column:
    """What a rollout mode does: shadow observes, quarantine holds rejects, the two reject modes reject on their evidence."""
    certain = F.arrays_overlap(fired, F.array(*(F.lit(s) for s in R.DETERMINISTIC)))
    return {
        "shadow": F.lit("observe"),
        "quarantine": F.when(act == "reject", "hold").otherwise("deliver"),
        "deterministic_reject": F.when(certain, "reject").otherwise("deliver"),
        "score_reject": F.when(score_col >= R.REJECT_SCORE, "reject").otherwise("deliver"),
    }[mode]


def verdicts(symbols: DataFrame, registry: DataFrame, profile: str = "outbound", mode: str = "shadow") -> DataFrame:
    s = score(symbols, registry)
    sure = F.array_contains("fired", "GTUBE")  # the test text is refused whatever its score
    return s.withColumn("action", F.when(sure, "reject").otherwise(action(F.col("score"), profile))).withColumn("policy_action", policy(mode, F.col("action"), F.col("score"), F.col("fired")))


def positive_below_reject(score_col: Column, reject: float = 15.0) -> Column:
    """A score that counts against a message without refusing it; null is no score."""
    return F.coalesce((score_col > 0) & (score_col < reject), F.lit(False))
