"""A training corpus from raw documents: quality, repeated lines, near duplicates, mixture, packing.

Each stage works on all that the one before kept and its decisions take effect; all but the last return the columns of
documents. Nulls, empty tables, repeated rows and extra columns are treated as the operators' docstrings say; a document
without any word left after line dedup goes, since nothing is left to keep.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.llm import jaccard, lines, mixing, packing, quality
from threatloom.runtime import stage, table, unstage

#: Near duplicates: five words, similarity of 0.8 or more.
NEAR = (5, 80, 100)
#: Share of the tokens that the mixture keeps.
TOKEN_SHARE = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labels reject go."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted; n_chars follows the text."""
    out = lines.dedup_lines(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: of those with the smallest id, the one with the smallest set class
    and then text hash. Rows that share an id, or have none, are documents of their own unless their sets are near."""
    found = stage(jaccard.near_duplicate_sets(docs, *NEAR), "near")
    again = stage(found.groupBy("_d").count().where("count > 1").select("_d"), "repeated-ids")
    some = again.count()
    again = F.broadcast(again) if some <= jaccard.BROADCAST_TOKENS else again  # ids only
    mine = docs.withColumn("_near_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(jaccard.NO_ID)))
    gone = found.where("n_shingles > 0 and _d <> _c").select(F.col("_d").alias("_near_id")).distinct()
    gone = F.broadcast(gone) if gone.count() <= jaccard.BROADCAST_TOKENS else gone  # ids only
    if not some:
        return mine.join(gone, "_near_id", "left_anti").select(*docs.columns)
    repeated = again.withColumnRenamed("_d", "_near_id")
    out = mine.join(repeated, "_near_id", "left_anti").join(gone, "_near_id", "left_anti").select(*docs.columns)
    # an id doesn't tell these rows apart, so their sets do
    rows = mine.join(repeated, "_near_id", "left_semi").withColumns({"_near_cls": jaccard.class_of(NEAR[0])(F.col("text")), "_near_text": F.xxhash64("text")})
    rows = stage(rows, "repeated-rows")
    of_ids = found.join(again, "_d", "left_semi").select(F.col("_d").alias("_near_id"), F.col("cls").alias("_near_cls"), "n_shingles", "_c", "_top")
    empty = of_ids.where("n_shingles = 0").select("_near_id", "_near_cls").distinct()
    first = of_ids.where("n_shingles > 0 and _near_id = _c and _near_cls = _top").select("_near_id", "_near_cls").distinct()
    held = rows.join(first, ["_near_id", "_near_cls"])
    least = held.groupBy("_near_id", "_near_cls").agg(F.min("_near_text").alias("_near_text"))
    held = held.join(least, ["_near_id", "_near_cls", "_near_text"]).dropDuplicates(["_near_id", "_near_cls"])
    return out.unionByName(held.select(*docs.columns)).unionByName(rows.join(empty, ["_near_id", "_near_cls"]).select(*docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics meet their tempered target weights."""
    return mixing.mix(docs, budget=TOKEN_SHARE).where("kept").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their training sequence and offset."""
    return packing.pack(packing.token_pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packing", pack),
]

#: The line labels and the tokenizer are beyond SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        before, docs = docs, stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
        unstage(before)  # written anew, so nothing reads it any more
    return docs
