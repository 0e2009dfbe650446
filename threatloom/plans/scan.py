"""The scan plan: messages to symbols to verdicts, the same for a batch and for a stream's micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.functions import domains as D
from threatloom.operators import bayes, detect, maps, patterns, ranges, score
from threatloom.runtime import stage
from threatloom.sources.mime import parse_messages


@dataclass
class Known:
    """What a scan is told beside the mail; every list is optional, and of any size.

    blocklist, phishing: url; shorteners, canaries: host; lookalikes: domain; networks: network, zone (for the mail's
    `address`); terms: list_name, term, boundary with term_symbols: list_name, symbol; tokens: token, spam, ham learnt from
    n_spam and n_ham messages.
    """

    blocklist: DataFrame | None = None
    phishing: DataFrame | None = None
    shorteners: DataFrame | None = None
    canaries: DataFrame | None = None
    lookalikes: DataFrame | None = None
    networks: DataFrame | None = None
    terms: DataFrame | None = None
    term_symbols: DataFrame | None = None
    tokens: DataFrame | None = None
    n_spam: int = 0
    n_ham: int = 0


def known_symbols(prepared: DataFrame, known: Known) -> DataFrame | None:
    """(message_id, symbol, multiplier, options) of lists, networks, terms and the classifier over prepared messages."""
    spark, parts = prepared.sparkSession, []
    none = lambda schema: spark.createDataFrame([], schema)
    urls = prepared.select("message_id", F.explode("urls").alias("url")).withColumn("host", D.normalize_host(D.url_host(F.col("url")))).distinct()
    if any(x is not None for x in (known.blocklist, known.shorteners, known.canaries, known.lookalikes)):
        senders = prepared.select("message_id", D.normalize_host(F.col("from_domain")).alias("from_domain"))
        or_none = lambda x, schema: x if x is not None else none(schema)
        hits = maps.map_symbols(urls, senders, or_none(known.blocklist, "url string"), or_none(known.shorteners, "host string"), or_none(known.canaries, "host string"), or_none(known.lookalikes, "domain string"))
        parts.append(hits.select("message_id", "symbol", F.lit(1.0).alias("multiplier"), F.array().cast("array<string>").alias("options")))
    if known.phishing is not None:
        parts.append(maps.phished(urls, known.phishing))
    if known.networks is not None and "address" in prepared.columns:
        parts.append(ranges.listed_addresses(prepared.where("address is not null").select("message_id", "address"), known.networks, "RBL_LISTED"))
    if known.terms is not None and known.term_symbols is not None:
        parts.append(patterns.list_symbols(patterns.term_hits(prepared, "message_id", "scan_text", known.terms), known.term_symbols))
    if known.tokens is not None:
        parts.append(bayes.symbols(prepared, known.tokens, known.n_spam, known.n_ham))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def scan(messages: DataFrame, profile: str = "outbound", mode: str = "shadow", extra_symbols: DataFrame | None = None, candidates: bool = False, ocr: Callable[[Column], Column] | None = None, known: Known | None = None) -> DataFrame:
    """Verdicts of parsed messages; `known` brings lists and the classifier, extra_symbols whatever else fired (message_id,
    symbol, multiplier, options). ocr reads pictures, see extract.reader."""
    if known is not None:
        # prepared once and written, since lists and detectors read the same URLs
        messages = stage(detect.with_urls(messages, ocr), "prepared")
        found = known_symbols(messages, known)
        extra_symbols = found if extra_symbols is None else extra_symbols if found is None else extra_symbols.unionByName(found)
    symbols = detect.detect(messages, ocr=ocr)
    if extra_symbols is not None:
        symbols = symbols.unionByName(extra_symbols)
    return score.verdicts(symbols, score.weights(messages.sparkSession, candidates), profile, mode)


def scan_mail(spark: SparkSession, path: str, profile: str = "outbound", mode: str = "shadow") -> DataFrame:
    """Verdicts of the .eml files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", True).load(path)
    return scan(parse_messages(files), profile, mode)
