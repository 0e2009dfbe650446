"""Registered domains by a table of suffix rules: every tail of a host is joined to the rules, the longest match wins.

Rules are written as public lists write them: `com`, `co.uk`, `*.ck` (any one label below), `!www.ck` (an exception: its own
name is no suffix), with // comments. A host's tails are equal keys, so the table may have any size; distinct hosts are
looked up, and a rule that all hosts share (`com`) meets them once each.

Edge cases: a host without labels or null has no row; a host no rule knows has its last label as suffix; a host that is a
suffix itself has no registered domain (null); an exception goes before any other match; rules repeat harmlessly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.functions import domains as D
from threatloom.functions import refdata as R
from threatloom.operators.maps import small_or_dealt


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule) of a list in the public format: a rule a line up to the first blank, // comments and empty lines left out."""
    first = F.regexp_extract("value", r"^\s*(\S+)", 1)
    return spark.read.text(path).select(F.lower(first).alias("rule")).where("rule <> '' and not startswith(rule, '//')").distinct()


def fixed_rules(spark: SparkSession) -> DataFrame:
    """The default table: the two-label suffixes that detectors know."""
    return spark.createDataFrame([(s,) for s in R.SUFFIXES], "rule string")


def _keyed(rules: DataFrame) -> DataFrame:
    rule = F.col("rule")
    kind = F.when(rule.startswith("!"), "exception").when(rule.startswith("*."), "wildcard").otherwise("plain")
    return rules.where("rule is not null").select(F.regexp_replace(F.regexp_replace(F.lower(rule), r"^(!|\*\.)", ""), r"^\.+|\.+$", "").alias("_tail"), kind.alias("kind")).where("_tail <> ''").distinct()


def _last(labels: Column, n: Column) -> Column:
    return F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")


def registered(hosts: DataFrame, host: str, rules: DataFrame) -> DataFrame:
    """(host, suffix, domain) of the distinct hosts of a column."""
    names = hosts.select(F.col(host).alias("host")).distinct().withColumn("_labels", D.host_labels(D.normalize_host(F.col("host")))).where("size(_labels) > 0")
    tails = names.select("host", F.size("_labels").alias("_size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("_labels")), lambda n: F.struct(n.alias("n"), _last(F.col("_labels"), n).alias("tail")))).alias("_t"))
    tails = tails.select("host", "_size", F.col("_t.n").alias("_n"), F.col("_t.tail").alias("_tail"))
    length = F.when(F.col("kind") == "exception", F.col("_n") - 1).when(F.col("kind") == "wildcard", F.col("_n") + 1).otherwise(F.col("_n"))
    found = tails.join(small_or_dealt(_keyed(rules)), "_tail").withColumn("_length", length).where("_length between 1 and _size")
    best = found.groupBy("host").agg(F.max(F.struct((F.col("kind") == "exception").alias("sure"), F.col("_length").alias("length"))).alias("_best"))
    size = F.coalesce("_best.length", F.lit(1))
    out = names.join(best, "host", "left").withColumn("_n", size)
    return out.select("host", _last(F.col("_labels"), F.col("_n")).alias("suffix"), F.when(F.size("_labels") > F.col("_n"), _last(F.col("_labels"), F.col("_n") + 1)).alias("domain"))
