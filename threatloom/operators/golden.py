"""Golden suite: pairing fixtures with expectations, judging outcomes and counting them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair(messages: DataFrame, expected: DataFrame) -> DataFrame:
    """Full outer pairing by stem, with orphan = 'message' or 'expected' where the other side is missing."""
    a, b = messages.withColumn("_m", F.lit(True)), expected.withColumn("_e", F.lit(True))
    orphan = F.when(F.col("_e").isNull(), "message").when(F.col("_m").isNull(), "expected")
    return a.join(b, "stem", "full_outer").withColumn("orphan", orphan).drop("_m", "_e")


def judge(rows: DataFrame) -> DataFrame:
    """rows: corpus, category, expected_action, actual_action, expected_symbols, actual_symbols -> missing and outcome.

    Attacks need the action and all expected symbols; stress cases need the symbols and only warn about the action; other
    legitimate mail needs the action.
    """
    missing = F.array_except("expected_symbols", "actual_symbols")
    same, has = F.col("expected_action") == F.col("actual_action"), F.size(missing) == 0
    outcome = (
        F.when(F.col("corpus") == "attacks", F.when(same & has, "pass").otherwise("fail"))
        .when(F.col("category") == "fp_stress", F.when(~has, "fail").when(same, "pass").otherwise("warning"))
        .otherwise(F.when(same, "pass").otherwise("fail"))
    )
    return rows.withColumn("missing", missing).withColumn("outcome", outcome)


def confusion(judged: DataFrame) -> DataFrame:
    """Per category: caught and evaded attacks, false positives among legitimate mail, warnings."""
    attack, flagged = F.col("corpus") == "attacks", F.col("actual_action") != "no_action"
    return judged.groupBy("corpus", "category").agg(
        F.count_if(attack & flagged).alias("caught"), F.count_if(attack & ~flagged).alias("evaded"),
        F.count_if(~attack & flagged).alias("false_positives"), F.count_if(F.col("outcome") == "warning").alias("warnings"),
    )


TRAINING_CAP = 25


def training_sample(messages: DataFrame, label: str, name: str, cap: int = TRAINING_CAP) -> DataFrame:
    """The first messages of each class in byte order of their names; a class's candidates are cut per task first."""
    here = Window.partitionBy(label, "_threatloom_part").orderBy(F.encode(name, "UTF-8"))
    all_ = Window.partitionBy(label).orderBy(F.encode(name, "UTF-8"))
    own = messages.withColumn("_threatloom_part", F.pmod(F.xxhash64(name), F.lit(64)))
    few = own.withColumn("_threatloom_n", F.row_number().over(here)).where(F.col("_threatloom_n") <= cap)
    return few.withColumn("_threatloom_n", F.row_number().over(all_)).where(F.col("_threatloom_n") <= cap).drop("_threatloom_n", "_threatloom_part")


def profile_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two profiles holds, with side 'first' or 'second'; none if the profiles are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))
