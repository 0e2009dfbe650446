"""WARC: resolution of not-modified revisits by an as-of join on the canonical URL.

A revisit takes the payload of the latest earlier full response of its canonical URL, if the validators agree: the
entity tag where the revisit has one (weak comparison), else Last-Modified, and the payload digest where both have one.
Of the revisit's headers only those that a 304 answer may update replace the stored ones.

Edge cases: a null or empty URL or a null time never resolves (`no_prior`); several full responses at one time: the
larger capture_id counts; a response at the revisit's own time is not earlier; repeated rows resolve alike; null headers
are no headers; a null record_type is a response that nothing refers to; an empty table gives an empty result; extra
columns pass through, but for those named as the four that are added, which the new ones replace. A hot URL is split by time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.llm.asof import asof_join
from threatloom.runtime import stage

#: Header fields that a 304 answer may update in a stored response (RFC 9110, 15.4.5; RFC 9111, 3.2).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment, no utm_ parameters, no empty query; null if no host."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(host)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.startswith("utm_") & (p != "")), "&")
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def _tag(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def resolve_revisits(captures: DataFrame, permitted: list[str] = PERMITTED) -> DataFrame:
    """Columns needed: capture_id long, url, fetch_time long, record_type ('response' or 'revisit'), etag,
    last_modified, digest, headers map<string,string> (lower-case names).

    Adds canonical_url, refers_to (capture_id of the response a revisit stands for), resolution ('response', 'resolved',
    'no_prior' or 'validator_mismatch') and merged_headers.
    """
    captures = captures.drop("canonical_url", "refers_to", "resolution", "merged_headers")
    # read five times by the join, so written once: URLs are taken apart and pages hashed once
    held = stage(captures.withColumn("canonical_url", canonical_url(F.col("url"))), "captures")
    full = held.where("record_type = 'response' and capture_id is not null").select(
        "canonical_url", "fetch_time", F.col("capture_id").alias("_threatloom_order"), F.struct("capture_id", "etag", "last_modified", "digest", "headers").alias("_threatloom_prior")
    )
    again = asof_join(held.where("record_type = 'revisit'"), full, ["canonical_url"], "fetch_time", "_threatloom_order", "_threatloom_prior", strict=True)
    agree = F.when(F.col("etag").isNotNull(), F.coalesce(_tag(F.col("etag")) == _tag(F.col("_threatloom_prior.etag")), F.lit(False))).otherwise(
        F.col("last_modified").isNull() | F.coalesce(F.col("last_modified") == F.col("_threatloom_prior.last_modified"), F.lit(False))
    ) & F.coalesce(F.col("digest") == F.col("_threatloom_prior.digest"), F.lit(True))
    ok = F.col("_threatloom_prior").isNotNull() & agree
    empty = F.create_map().cast("map<string,string>")
    update = F.map_filter(F.coalesce("headers", empty), lambda k, _: k.isin(permitted))
    stays = F.map_filter(F.coalesce("_threatloom_prior.headers", empty), lambda k, _: ~F.array_contains(F.map_keys(update), k))
    again = (
        again.withColumn("refers_to", F.when(ok, F.col("_threatloom_prior.capture_id")))
        .withColumn("resolution", F.when(F.col("_threatloom_prior").isNull(), "no_prior").when(ok, "resolved").otherwise("validator_mismatch"))
        .withColumn("merged_headers", F.when(ok, F.map_concat(stays, update)).otherwise(F.col("headers")))
        .select(*held.columns, "refers_to", "resolution", "merged_headers")
    )
    rest = held.where("record_type is null or record_type <> 'revisit'").select(
        "*", F.lit(None).cast("long").alias("refers_to"), F.lit("response").alias("resolution"), F.col("headers").alias("merged_headers")
    )
    return rest.unionByName(again)


#: Captures of the pages table, in SQL that both engines read (from page_id, url, md5 of the html and k): every page is
#: fetched three times and robots.txt of its host with it; later fetches are mostly 304s.
CAPTURES_SQL = r"""
SELECT page_id * 8 + k AS capture_id,
       CASE WHEN k >= 4 THEN concat(regexp_extract(url, '^[a-z]+://[^/]+', 0), '/robots.txt')
            WHEN k = 1 THEN concat(url, '#again') ELSE url END AS url,
       (page_id * 37 + k * 86400 + (page_id % 11) * 3600) AS fetch_time,
       CASE WHEN k IN (0, 4) AND page_id % 9 <> 5 THEN 'response' WHEN (page_id + k) % 5 = 0 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id % 3 = 0 THEN NULL
            WHEN k >= 4 THEN concat('W/"r', CAST((page_id * 37 + (page_id % 11) * 3600) % 3 AS STRING), '"')
            WHEN page_id % 7 = 1 AND k = 2 THEN '"other"' ELSE concat('"', substr(md5, 1, 12), '"') END AS etag,
       CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN concat('day ', CAST(page_id % 13 AS STRING)) ELSE NULL END AS last_modified,
       CASE WHEN k < 4 AND page_id % 4 <> 0 THEN md5 ELSE NULL END AS digest
FROM fetches
"""
FETCHES = (0, 1, 2, 4, 5)


def op1_warc_revisits(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    fetches = pages.select("page_id", "url", F.md5("html").alias("md5")).select("*", F.explode(F.array(*map(F.lit, FETCHES))).alias("k"))
    captures = spark.sql(CAPTURES_SQL.replace("FROM fetches", "FROM {fetches}"), fetches=fetches)
    heads = F.create_map(
        F.lit("date"), F.col("fetch_time").cast("string"), F.lit("content-type"), F.when(F.col("record_type") == "revisit", "none").otherwise("text/html"), F.lit("server"), F.concat(F.lit("s"), (F.col("capture_id") % 3).cast("string"))
    )
    out = resolve_revisits(captures.withColumn("headers", heads))
    return out.select(
        "capture_id", "canonical_url", "resolution", F.coalesce("refers_to", F.lit(-1)).alias("refers_to"),
        *(F.coalesce(F.element_at("merged_headers", h), F.lit("")).alias(h.replace("-", "_")) for h in ("date", "content-type", "server")),
    )


OP1_SQL = rf"""
WITH fetches AS (SELECT page_id, url, md5(html) AS md5, unnest([{', '.join(map(str, FETCHES))}]) AS k FROM pages),
c AS ({CAPTURES_SQL.replace('AS STRING', 'AS VARCHAR')}),
u AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS sch, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host,
             regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path,
             array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: NOT starts_with(p, 'utm_') AND p <> ''), '&') AS q FROM c),
k AS (SELECT *, sch || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical_url FROM u),
r AS (SELECT * FROM k WHERE record_type = 'response'),
l AS (SELECT canonical_url, fetch_time, max(capture_id) AS capture_id FROM r GROUP BY 1, 2),
p AS (SELECT k.capture_id AS id, l.capture_id AS prior FROM k ASOF JOIN l ON k.canonical_url = l.canonical_url AND k.fetch_time > l.fetch_time WHERE k.record_type = 'revisit'),
j AS (SELECT k.*, p.prior, r.fetch_time AS r_time, r.capture_id AS r_id,
             p.prior IS NOT NULL AND CASE WHEN k.etag IS NOT NULL THEN coalesce(regexp_replace(k.etag, '^W/', '') = regexp_replace(r.etag, '^W/', ''), false)
               ELSE k.last_modified IS NULL OR coalesce(k.last_modified = r.last_modified, false) END AND coalesce(k.digest = r.digest, true) AS ok
      FROM k LEFT JOIN p ON p.id = k.capture_id LEFT JOIN r ON r.capture_id = p.prior)
SELECT capture_id, canonical_url,
       CASE WHEN record_type = 'response' THEN 'response' WHEN prior IS NULL THEN 'no_prior' WHEN ok THEN 'resolved' ELSE 'validator_mismatch' END AS resolution,
       CASE WHEN record_type = 'revisit' AND ok THEN prior ELSE -1 END AS refers_to,
       CAST(fetch_time AS VARCHAR) AS date,
       CASE WHEN record_type = 'response' OR ok THEN 'text/html' ELSE 'none' END AS content_type,
       's' || CAST(CASE WHEN record_type = 'revisit' AND ok THEN r_id ELSE capture_id END % 3 AS VARCHAR) AS server
FROM j
"""
