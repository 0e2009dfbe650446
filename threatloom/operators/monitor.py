"""Poisoning monitor of the classifier: ratio, drift, learn rate and concentration. Alerts compare rounded values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.functions import refdata as R


def learned(report: Column, symbol: str) -> Column:
    """The `learned` count of a class in a status report line; digits only."""
    hit = F.regexp_extract(report, rf"Statfile:\s*{symbol}\b[^\n]*?learned:\s*([0-9,. ]+)", 1)
    return F.when(hit == "", None).otherwise(F.regexp_replace(hit, "[^0-9]", "").cast("long"))


def class_ratio(counts: DataFrame) -> DataFrame:
    """counts (spam, ham): ham/spam to four places; without spam any ham is an alert."""
    ratio = F.round(F.col("ham") / F.nullif(F.col("spam"), F.lit(0)), 4)
    alert = F.when(F.col("spam") == 0, F.col("ham") > 0).otherwise(ratio > R.MAX_HAM_SPAM)
    return counts.withColumn("ratio", ratio).withColumn("ratio_alert", alert)


def shares(counts: DataFrame) -> DataFrame:
    total = F.nullif(F.col("spam") + F.col("ham"), F.lit(0))
    return counts.withColumn("spam_share", F.round(F.col("spam") / total, 6)).withColumn("ham_share", F.round(F.col("ham") / total, 6))


def drift(counts: DataFrame, by: str, order: str) -> DataFrame:
    """Drift of each sample's shares from the series' first non-empty sample, which stays the baseline."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.first(F.when(F.col("spam") + F.col("ham") > 0, F.col("spam_share")), ignorenulls=True).over(w)
    d = F.round(F.abs(F.col("spam_share") - base), 6)
    return shares(counts).withColumn("drift", d).withColumn("drift_alert", F.coalesce(d > R.MAX_DRIFT, F.lit(False)))


def learn_rate(samples: DataFrame, by: str, epoch: str) -> DataFrame:
    """Learns per hour between cumulative samples (two places); a falling counter is a reset and has no rate."""
    w = Window.partitionBy(by).orderBy(epoch)
    total = F.col("spam") + F.col("ham")
    out = samples.withColumns({"_dt": F.col(epoch) - F.lag(epoch).over(w), "_dn": total - F.lag(total).over(w), "reset": F.coalesce((F.col("spam") < F.lag("spam").over(w)) | (F.col("ham") < F.lag("ham").over(w)), F.lit(False))})
    rate = F.when((F.col("_dt") > 0) & ~F.col("reset"), F.round(F.col("_dn") * 3600 / F.col("_dt"), 2))
    return out.withColumn("rate", rate).withColumn("rate_alert", F.coalesce(rate > R.MAX_LEARNS_HOUR, F.lit(False))).drop("_dt", "_dn")


def audit_counts(lines: DataFrame) -> DataFrame:
    """(account_id, learns) of an audit log (value): an account and a whole number a line; blank lines and # comments don't
    count. One malformed line makes the report invalid: the rows then fail with it rather than tell half the truth."""
    words = F.filter(F.split(F.col("value"), r"[\t-\r ]+"), lambda w: w != "")
    rows = lines.select(words.alias("w"), "value").where("size(w) > 0 and not startswith(w[0], '#')")
    valid = (F.size("w") == 2) & ~F.get("w", F.lit(0)).contains("|") & F.get("w", F.lit(1)).rlike("^[0-9]+$")
    checked = F.when(valid, F.get("w", F.lit(1)).cast("long")).otherwise(F.raise_error(F.concat(F.lit("malformed audit line: "), "value")).cast("long"))
    return rows.select(F.get("w", F.lit(0)).alias("account_id"), checked.alias("learns"))


def account_share(audit: DataFrame) -> DataFrame:
    """One row: the account with most learns (ties: the smaller name), its share to four places and the alert."""
    per = audit.groupBy("account_id").agg(F.sum("learns").alias("learns"))
    # minimum on the negated count: one aggregate finds the largest, then the smallest name
    top = per.agg(F.sum("learns").alias("total"), F.min(F.struct((-F.col("learns")).alias("n"), F.col("account_id").alias("account"))).alias("top"))
    share = F.round(-F.col("top.n") / F.nullif(F.col("total"), F.lit(0)), 4)
    return top.select(F.col("top.account").alias("account_id"), (-F.col("top.n")).alias("learns"), "total", share.alias("share"), F.coalesce(share > R.MAX_ACCOUNT_SHARE, F.lit(False)).alias("share_alert"))


def learn_delta(before: DataFrame, after: DataFrame, least: int = 100) -> DataFrame:
    """New learnings between two one-row samples (spam, ham) and whether they suffice."""
    n = (F.col("a.spam") + F.col("a.ham")) - (F.col("b.spam") + F.col("b.ham"))
    return after.alias("a").crossJoin(before.alias("b")).select(n.alias("learned"), (n >= least).alias("enough"))


def daily_learn_cap(learns: DataFrame, account: str, ts: str, cap: int = 10) -> DataFrame:
    """Learns per account and UTC day, and how many the daily cap admits."""
    per = learns.groupBy(F.col(account).alias("account_id"), F.to_date(ts).cast("string").alias("day")).agg(F.count("*").alias("learns"))
    return per.withColumn("admitted", F.least("learns", F.lit(cap)).cast("long"))
