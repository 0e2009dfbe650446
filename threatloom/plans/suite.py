"""The golden suite from files: mails beside their expectations, scanned, judged and counted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.operators import golden
from threatloom.plans.scan import scan
from threatloom.runtime import stage
from threatloom.sources import files
from threatloom.sources.mime import parse_messages

#: corpus/<attacks or legitimate>/<category>/<name>.eml beside <name>.expected
_PLACE = r"([^/]+)/([^/]+)/[^/]+$"


def outcomes(mails: DataFrame, expected: DataFrame, scanned: Callable[[DataFrame], DataFrame] = scan) -> DataFrame:
    """(stem, corpus, category, expected_action, actual_action, expected_symbols, actual_symbols, missing, outcome, orphan).

    mails: path (the stem), content; expected: stem, corpus, category, action, symbols. A mail without expectations, or the
    other way round, is an `orphan` and has no outcome. A mail that nothing fires for has no action but no_action.
    """
    judged = scanned(parse_messages(mails)).select(F.col("message_id").alias("stem"), F.col("action").alias("_action"), F.col("fired").alias("_fired"))
    found = mails.select(F.col("path").alias("stem")).join(judged, "stem", "left")
    paired = golden.pair(found, expected)
    rows = paired.select(
        "stem", "corpus", "category", F.col("action").alias("expected_action"), F.when(F.col("orphan").isNull(), F.coalesce("_action", F.lit("no_action"))).alias("actual_action"),
        F.col("symbols").alias("expected_symbols"), F.coalesce("_fired", F.array().cast("array<string>")).alias("actual_symbols"), "orphan",
    )
    return golden.judge(rows).withColumn("outcome", F.when(F.col("orphan").isNull(), F.col("outcome")))


def run_suite(spark: SparkSession, folder: str, scanned: Callable[[DataFrame], DataFrame] = scan) -> tuple[DataFrame, DataFrame]:
    """Outcomes and the confusion by category of the suite below a folder."""
    stem = lambda c: F.regexp_replace(c, r"\.[a-z]+$", "")
    mails = files.corpus_dir(spark, folder, "*.eml", recursive=True).select(stem("path").alias("path"), "content")
    place = lambda k: F.regexp_extract("stem", _PLACE, k)
    expected = files.expectations(spark, folder).withColumns({"corpus": place(1), "category": place(2)})
    out = stage(outcomes(mails, expected, scanned), "suite")
    return out, golden.confusion(out.where("orphan is null"))
