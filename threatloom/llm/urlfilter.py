"""URL filters: dated list entries become validity intervals; an as-of join judges captures at their fetch time.

A list entry adds or removes a pattern (a domain, or a host with a path prefix) at a date. Per list and pattern the
changes give intervals [valid_from, valid_to). A capture is looked up under its host, every parent domain and its host
with each leading path segment, so the join is on equal keys; the entry that counts is the one in force at fetch time.
Of the entries in force the longest pattern decides, and among equally long ones `allow` goes before `block`.

Edge cases: several changes of a pattern at one time: the larger entry_id counts; adding twice or removing what isn't
there changes nothing; null patterns, lists or dates are no entries; a capture without a host or time has no entry in
force and is kept; every row of captures has its own row in the result, whether its id is null or repeated, with the same
or another URL (under one id and time, URLs are told apart by a 64-bit hash); empty tables give empty or all-kept results;
extra columns are ignored. A hot host is split by time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.llm.asof import asof_join


def validity(entries: DataFrame) -> DataFrame:
    """entries: entry_id long, list_name, pattern, action ('add' or 'remove'), changed long -> list_name, pattern, valid_from, valid_to, entry_id."""
    ok = entries.where("list_name is not null and pattern is not null and changed is not null and action in ('add', 'remove')")
    last = ok.groupBy("list_name", "pattern", "changed").agg(F.max(F.struct("entry_id", "action")).alias("e")).select("list_name", "pattern", "changed", "e.*")
    by = Window.partitionBy("list_name", "pattern").orderBy("changed")
    change = last.withColumn("_was", F.lag("action").over(by)).where("_was is null and action = 'add' or _was <> action")
    return change.withColumn("valid_to", F.lead("changed").over(by)).where("action = 'add'").select("list_name", "pattern", F.col("changed").alias("valid_from"), "valid_to", "entry_id")


def lookup_keys(url: Column) -> Column:
    """Patterns that could name this URL: host, parent domains of two labels or more, host plus each number of leading path segments."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    deep = F.size(parts)
    paths = F.when(deep > 0, F.transform(F.sequence(F.lit(1), deep), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, paths)))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures: capture_id, url, fetch_time long -> these, n_active, verdict ('block', 'allow' or 'none'), rule, entry_id; a row for every row."""
    spans = validity(entries)
    held = captures.select("capture_id", "url", "fetch_time", F.xxhash64("url").alias("_u"))
    keyed = held.distinct().select("capture_id", "fetch_time", "_u", F.explode(lookup_keys(F.col("url"))).alias("pattern"))
    listed = keyed.join(spans.select("list_name", "pattern").distinct(), "pattern")
    events = spans.select("list_name", "pattern", F.col("valid_from").alias("fetch_time"), F.col("entry_id").alias("_order"), F.struct("valid_to", "entry_id").alias("_span"))
    hits = asof_join(listed, events, ["list_name", "pattern"], "fetch_time", "_order", "_span", strict=False)
    hits = hits.where(F.col("_span").isNotNull() & (F.col("_span.valid_to").isNull() | (F.col("fetch_time") < F.col("_span.valid_to"))))
    top = F.max(F.struct(F.length("pattern").alias("size"), (F.col("list_name") == "allow").alias("allow"), "pattern", "list_name", F.col("_span.entry_id").alias("entry_id"))).alias("top")
    verdicts = hits.groupBy("capture_id", "fetch_time", "_u").agg(F.count("*").alias("n_active"), top)
    mine, found = held.alias("c"), verdicts.alias("v")
    same = F.col("c.capture_id").eqNullSafe(F.col("v.capture_id")) & (F.col("c.fetch_time") == F.col("v.fetch_time")) & (F.col("c._u") == F.col("v._u"))
    return mine.join(found, same, "left").select(
        "c.capture_id", "c.url", "c.fetch_time", F.coalesce("n_active", F.lit(0)).alias("n_active"), F.coalesce("top.list_name", F.lit("none")).alias("verdict"),
        F.coalesce("top.pattern", F.lit("")).alias("rule"), F.col("top.entry_id").alias("entry_id"),
    )


#: Dated entries drawn from the pages' own hosts and paths, in SQL that both engines read.
ENTRIES_SQL = r"""
SELECT page_id * 4 + k AS entry_id,
       CASE WHEN page_id % 4 = 1 AND k < 2 THEN 'allow' ELSE 'block' END AS list_name,
       CASE WHEN page_id % 6 = 0 THEN regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)
            WHEN page_id % 6 = 3 THEN regexp_extract(url, '^[a-z]+://[a-z]+[.]([^/?#]+)', 1)
            WHEN page_id % 6 = 1 THEN regexp_extract(url, '^[a-z]+://([^?#]*[^/?#])', 1)
            ELSE regexp_extract(url, '^[a-z]+://([^/?#]+/[a-z]+)', 1) END AS pattern,
       CASE WHEN k % 2 = 0 THEN 'add' ELSE 'remove' END AS action,
       page_id * 31 + k * 5000 + (page_id % 7) * 100 AS changed
FROM (SELECT page_id, url, k FROM pages CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) ks) p WHERE page_id % 2 = 0 OR page_id % 4 = 1 OR page_id % 6 = 3
"""
FETCHES_SQL = """SELECT page_id * 2 + k AS capture_id, url, page_id * 31 + k * 12000 AS fetch_time FROM (SELECT page_id, url, k FROM pages CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) ks) p"""


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/pages.parquet").createOrReplaceTempView("threatloom_pages")
    read = lambda q: spark.sql(q.replace("FROM pages", "FROM threatloom_pages"))
    judged = judge(read(FETCHES_SQL), read(ENTRIES_SQL)).drop("url", "fetch_time")
    return judged.withColumn("entry_id", F.coalesce("entry_id", F.lit(-1)))


OP2_SQL = rf"""
WITH e AS ({ENTRIES_SQL}), f AS ({FETCHES_SQL}),
e1 AS (SELECT list_name, pattern, changed, max(entry_id) AS entry_id, arg_max(action, entry_id) AS action FROM e GROUP BY 1, 2, 3),
e2 AS (SELECT *, lag(action) OVER (PARTITION BY list_name, pattern ORDER BY changed) AS was FROM e1),
e3 AS (SELECT *, lead(changed) OVER (PARTITION BY list_name, pattern ORDER BY changed) AS valid_to FROM e2 WHERE (was IS NULL AND action = 'add') OR was <> action),
v AS (SELECT list_name, pattern, changed AS valid_from, valid_to, entry_id FROM e3 WHERE action = 'add'),
h AS (SELECT *, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host, list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM f),
k AS (SELECT DISTINCT capture_id, fetch_time, pattern FROM (
        SELECT capture_id, fetch_time, array_to_string(string_split(host, '.')[i:], '.') AS pattern FROM (SELECT *, unnest(generate_series(1, greatest(len(string_split(host, '.')) - 1, 1))) AS i FROM h)
        UNION ALL SELECT capture_id, fetch_time, host || '/' || array_to_string(parts[:i], '/') FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM h WHERE len(parts) > 0))),
a AS (SELECT k.capture_id, v.* FROM k JOIN v ON v.pattern = k.pattern AND k.fetch_time >= v.valid_from AND (v.valid_to IS NULL OR k.fetch_time < v.valid_to)),
t AS (SELECT *, count(*) OVER (PARTITION BY capture_id) AS n, row_number() OVER (PARTITION BY capture_id ORDER BY length(pattern) DESC, (list_name = 'allow') DESC, pattern DESC, list_name DESC, entry_id DESC) AS rn FROM a)
SELECT f.capture_id, coalesce(t.n, 0) AS n_active, coalesce(t.list_name, 'none') AS verdict, coalesce(t.pattern, '') AS rule, coalesce(t.entry_id, -1) AS entry_id FROM f LEFT JOIN t ON t.capture_id = f.capture_id AND t.rn = 1
"""
