"""Look-ups in reference lists: semi joins on equal keys, broadcast only behind a size check, and pattern lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def small_or_dealt(table: DataFrame) -> DataFrame:
    """A broadcast hint where the list is counted small; larger lists are joined by shuffling both sides."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def listed(rows: DataFrame, key: str, entries: DataFrame, entry: str) -> DataFrame:
    """Rows whose key is on the list; an empty list hits nothing."""
    known = small_or_dealt(entries.select(F.col(entry).alias(key)).distinct())
    return rows.join(known, key, "left_semi")


def unlisted(rows: DataFrame, key: str, entries: DataFrame, entry: str) -> DataFrame:
    known = small_or_dealt(entries.select(F.col(entry).alias(key)).distinct())
    return rows.join(known, key, "left_anti")


def map_symbols(urls: DataFrame, senders: DataFrame, blocklist: DataFrame, shorteners: DataFrame, canaries: DataFrame, lookalikes: DataFrame) -> DataFrame:
    """(message_id, symbol) of all exact maps. urls: message_id, url, host; senders: message_id, from_domain."""
    name = lambda df, s: df.select("message_id", F.lit(s).alias("symbol")).distinct()
    return (
        name(listed(urls, "url", blocklist, "url"), "PHISHED_URL_BLOCKLIST")
        .unionByName(name(listed(urls, "host", shorteners, "host"), "SHORT_URL_FLAG"))
        .unionByName(name(listed(urls, "host", canaries, "host"), "OPENPHISH_CANARY"))
        .unionByName(name(listed(senders, "from_domain", lookalikes, "domain"), "KNOWN_LOOKALIKE_DOMAIN"))
    )


def matching(rows: DataFrame, column: str, patterns: list[str], ignore_case: bool = True) -> DataFrame:
    """Rows that any pattern of a list matches: one alternation, compiled once."""
    return rows.where(F.col(column).rlike(("(?i)" if ignore_case else "") + "(" + "|".join(patterns) + ")")) if patterns else rows.limit(0)


def phished(urls: DataFrame, feed: DataFrame) -> DataFrame:
    """(message_id, symbol, multiplier, options) of messages with a URL (message_id, url) of the phishing feed (url)."""
    hit = urls.join(small_or_dealt(feed.select("url").distinct()), "url", "left_semi")
    return hit.groupBy("message_id").agg(F.lit("PHISHED_OPENPHISH").alias("symbol"), F.lit(1.0).alias("multiplier"), F.array_sort(F.collect_set("url")).alias("options"))


def listed_hosts(hosts: DataFrame, zones: DataFrame, symbol: str) -> DataFrame:
    """Reputation zones as a dimension instead of look-ups by name: (message_id, host) against (host, zone)."""
    hit = hosts.join(small_or_dealt(zones.select("host", "zone").distinct()), "host")
    return hit.groupBy("message_id").agg(F.lit(symbol).alias("symbol"), F.lit(1.0).alias("multiplier"), F.array_sort(F.collect_set("zone")).alias("options"))
