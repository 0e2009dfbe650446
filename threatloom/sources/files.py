"""Sources and sinks: feeds, corpora, decisions, canary logs, fixtures, maps, reports and snapshots."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threatloom.runtime import stage

DECISIONS = (
    "message_id string, recipient_id string, injection_attempt_id string, evaluation_id string, score double, rspamd_action string,"
    " policy_action string, scan_time_ms double, scan_status string, scan_mode string, deterministic boolean, fallback boolean, inserted_at timestamp"
)
HTTP = "^https?://"


def text_feed(spark: SparkSession, path: str) -> DataFrame:
    """One URL a line; carriage returns and other lines are dropped."""
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("url")).where(F.col("url").rlike(HTTP))


def quoted_csv_feed(spark: SparkSession, path: str, column: int = 2) -> DataFrame:
    """A quoted CSV feed with # comments: the URLs of its third column."""
    rows = spark.read.option("comment", "#").option("quote", '"').csv(path)
    name = rows.columns[column] if len(rows.columns) > column else None
    return rows.select(F.col(name).alias("url")).where(F.col("url").rlike(HTTP)) if name else spark.createDataFrame([], "url string")


def first_column_feed(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.trim(F.col(f"`{column or rows.columns[0]}`")).alias("url"))


def labelled_csv(spark: SparkSession, path: str, text: str = "text", label: str = "label", spam: tuple = ("1",), ham: tuple = ("0",)) -> DataFrame:
    """(text, is_spam); rows with other labels are dropped."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return labelled(rows, F.col(f"`{text}`"), F.trim(F.col(f"`{label}`")), spam, ham)


def labelled_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {text, is_spam}, where is_spam is 1/0 or true/false in any spelling."""
    rows = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    return labelled(rows, F.col("text"), F.col("is_spam"), ("1", "True", "true"), ("0", "False", "false"))


def labelled(rows: DataFrame, text: Column, label: Column, spam: tuple, ham: tuple) -> DataFrame:
    return rows.select(text.alias("text"), F.when(label.isin(*spam), True).when(label.isin(*ham), False).alias("is_spam")).where("is_spam is not null")


def corpus_dir(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """(path, content) of a folder's files in byte order; command files, dot files and READMEs are skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return files.select("path", "content").where((name != "cmds") & ~name.rlike(r"^(\.|README)")).orderBy("path")


def key_values(text: Column, key: str) -> Column:
    """A `key: value` line's value, without a trailing # comment; null where there is no such line."""
    hit = F.regexp_extract(text, rf"(?m)^{key}:[ \t]*([^\n#]*)", 1)
    return F.when(text.rlike(rf"(?m)^{key}:"), F.trim(hit))


def expectations(spark: SparkSession, path: str) -> DataFrame:
    """stem, action, symbols and description of .expected files below a folder."""
    rows = corpus_dir(spark, path, "*.expected", recursive=True).withColumn("t", F.col("content").cast("string"))
    symbols = F.filter(F.split(F.coalesce(key_values(F.col("t"), "symbols"), F.lit("")), r"\s*,\s*"), lambda x: x != "")
    return rows.select(F.regexp_replace("path", r"\.expected$", "").alias("stem"), key_values(F.col("t"), "action").alias("action"), symbols.alias("symbols"), key_values(F.col("t"), "description").alias("description"))


def decisions_json(spark: SparkSession, path: str) -> DataFrame:
    """Scan decisions from a JSON array; created_at stands in for a missing inserted_at."""
    rows = spark.read.schema(DECISIONS.replace("inserted_at timestamp", "inserted_at string, created_at string")).option("multiLine", True).json(path)
    return rows.withColumn("inserted_at", F.try_to_timestamp(F.coalesce("inserted_at", "created_at"))).drop("created_at")


def decisions_jdbc(spark: SparkSession, url: str, table: str, start: str | None = None, end: str | None = None, days: int = 7, partitions: int = 8, **options: str) -> DataFrame:
    """Scan decisions from a database, newest first: the window (both ends included), or the last `days`, is read in equal
    ranges of time, one query each, and the mode is filtered by the database too."""
    import datetime as dt

    def instant(text: str) -> dt.datetime:
        t = dt.datetime.fromisoformat(text)
        return (t if t.tzinfo else t.replace(tzinfo=dt.UTC)).astimezone(dt.UTC)

    now = dt.datetime.now(dt.UTC)
    until = instant(end) if end else None
    since = instant(start) if start else (until or now) - dt.timedelta(days=days)
    last = until or max(now, since)
    cuts = [since + (last - since) * k / partitions for k in range(1, partitions)]
    when = lambda t: f"{{ts '{t.strftime('%Y-%m-%d %H:%M:%S.%f')}'}}"
    edges = [since, *sorted(set(cuts) - {since, last}), None]
    ranges = [f'"inserted_at" >= {when(a)}' + (f' AND "inserted_at" < {when(b)}' if b else f' AND "inserted_at" <= {when(until)}' if until else "") for a, b in zip(edges, edges[1:], strict=False)]
    rows = spark.read.jdbc(url, table, predicates=ranges, properties=options)
    return rows.where("scan_mode = 'shadow'").orderBy(F.col("inserted_at").desc())


def canary_log(spark: SparkSession, path: str) -> DataFrame:
    """One row (clean, spam, phishing, timestamp) from an object or from JSON lines: the last summary's mode, else the last
    status of each canary. Lines that aren't JSON are skipped."""
    schema = "event string, canary string, status string, mode string, clean boolean, spam boolean, phishing boolean, timestamp string, generated_at string"
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).withColumn("j", F.from_json("value", schema))
    lines = lines.where("j is not null").select("at", "j.*").where("coalesce(event, canary, timestamp, generated_at) is not null or coalesce(clean, spam, phishing) is not null")
    of = lambda name: F.coalesce(F.max_by(F.col(name), F.when(F.col(name).isNotNull(), F.col("at"))), F.max_by(F.col("status") == "pass", F.when((F.col("canary") == name) & F.col("status").isNotNull(), F.col("at"))))
    time_of = F.coalesce("timestamp", "generated_at")
    return lines.agg(*(of(n).alias(n) for n in ("clean", "spam", "phishing")), F.try_to_timestamp(F.max_by(time_of, F.when(time_of.isNotNull(), F.col("at")))).alias("timestamp"))


def refreshed_map(feeds: list[DataFrame]) -> DataFrame | None:
    """The distinct URLs of all feeds in byte order; None (publish nothing) if any feed is empty."""
    if any(not f.limit(1).count() for f in feeds):
        return None
    out = feeds[0].select("url")
    for f in feeds[1:]:
        out = out.union(f.select("url"))
    return out.distinct().orderBy("url")


def feed_counts(feeds: dict[str, DataFrame]) -> DataFrame:
    """(feed, entries, distinct_entries) of named feeds (url); an empty feed is counted too."""
    parts = [f.agg(F.lit(name).alias("feed"), F.count("url").alias("entries"), F.countDistinct("url").alias("distinct_entries")) for name, f in feeds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def put_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def switch(spark: SparkSession, base: str, text: str) -> None:
    """Put text into the pointer file CURRENT in one step, so that a reader finds the old pointer or the new one."""
    put_text(spark, f"{base}/_next", text)
    fs, tmp = _fs(spark, f"{base}/_next")
    hadoop, jvm = "org.apache.hadoop.fs.", spark._jvm
    overwrite = jvm.java.lang.Enum.valueOf(jvm.java.lang.Class.forName(hadoop + "Options$Rename"), "OVERWRITE")
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = overwrite
    here = fs.makeQualified(tmp)
    there = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{base}/CURRENT"))
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(here.toUri(), spark._jsc.hadoopConfiguration()).rename(here, there, options)


def children(spark: SparkSession, path: str) -> list[str]:
    """Paths in a folder, in order; none where there is no folder."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def publish(df: DataFrame, base: str) -> str:
    """Write a new version beside the old ones and switch the pointer file last, so readers never see half a map."""
    version = f"{base}/v{time.time_ns()}"
    df.write.parquet(version)
    switch(df.sparkSession, base, version)
    return version


def exists(spark: SparkSession, base: str) -> bool:
    """Whether a version has been published under base."""
    fs, p = _fs(spark, f"{base}/CURRENT")
    return fs.exists(p)


def current(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(spark.read.text(f"{base}/CURRENT").first()[0])


def retain(spark: SparkSession, base: str, keep: int = 10) -> list[str]:
    """Drop all but the newest versions; returns what went."""
    fs, p = _fs(spark, base)
    names = sorted((s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory()), reverse=True)
    for n in names[keep:]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(n), True)
    return names[keep:]


def restore(spark: SparkSession, base: str, version: str) -> str:
    return publish(spark.read.parquet(version), base)


def report_json(report: DataFrame, path: str | None = None) -> list[dict]:
    """A one-row report as JSON, to a folder or back to the caller."""
    rows = report.select(F.to_json(F.struct(*report.columns)).alias("value"))
    if path:
        rows.write.mode("overwrite").text(path)
    return [json.loads(r[0]) for r in rows.collect()]


def event_lines(events: DataFrame) -> DataFrame:
    """Events as JSON lines; control characters become blanks."""
    plain = [F.regexp_replace(c, r"[\x00-\x1f]", " ").alias(c) if t == "string" else F.col(c) for c, t in events.dtypes]
    return events.select(F.to_json(F.struct(*plain)).alias("value"))


def training_message(text: Column) -> Column:
    """A text as a mail: a subject of its first 80 characters unless it has one, and CR LF line ends."""
    mail = F.when(text.startswith("Subject:"), text).otherwise(F.concat(F.lit("Subject: "), F.substring(text, 1, 80), F.lit("\r\n\r\n"), text))
    return F.replace(F.replace(mail, F.lit("\n"), F.lit("\r\n")), F.lit("\r\r\n"), F.lit("\r\n"))


def numbered(rows: DataFrame, by: str, order: str, name: str = "number") -> DataFrame:
    """rows with their place (from 1) within `by`, in `order`: dealt by ranges, numbered inside them, and moved on by what
    earlier ranges hold, so that no class is sorted in one task."""
    dealt = rows.repartitionByRange(by, order).withColumn("_range", F.spark_partition_id())
    held = stage(dealt, "ranges")  # the ranges are written, so both uses see the same
    counts = held.groupBy(by, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(by, "_range", before.alias("_start"))
    inside = F.row_number().over(Window.partitionBy(by, "_range").orderBy(order))
    return held.withColumn("_in", inside).join(starts, [by, "_range"]).withColumn(name, (F.col("_in") + F.col("_start")).cast("long")).select(*rows.columns, name)


def numbered_messages(rows: DataFrame, order: str, min_chars: int = 20) -> DataFrame:
    """(class, number, mail): labelled texts of min_chars or more as mails, numbered %06d within their class."""
    rows = rows.where(F.length(F.trim("text")) >= min_chars).withColumn("class", F.when(F.col("is_spam"), "spam").otherwise("ham"))
    n = numbered(rows.select(order, "class", "text"), "class", order)
    digits = F.col("number").cast("string")
    return n.select(order, "class", F.lpad(digits, F.greatest(F.length(digits), F.lit(6)), "0").alias("number"), training_message(F.col("text")).alias("mail"))
