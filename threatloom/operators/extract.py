"""URL extractors: columns that turn headers, text and markup into arrays of URLs, first seen first, each once."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from threatloom.functions import domains as D
from threatloom.functions import refdata as R
from threatloom.functions import text as T
from threatloom.functions.codecs import base64_text, decode_entities, decode_quoted_printable, fully_decode, percent_decode
from threatloom.functions.markup import markup

MAX_URLS, MAX_DATA_URIS, MAX_BASE64, MAX_DECODED = 100, 100, 5, 10_240
MAX_BASE64_CHARS, MAX_DATA_CHARS, MAX_PART = 13_656, 13_658, 1_048_576


def header_urls(header: Column) -> Column:
    """List-Unsubscribe: http(s) URLs in angle brackets, at most 100."""
    inner = F.transform(F.regexp_extract_all(F.coalesce(header, F.lit("")), F.lit("<([^<>]*)>"), F.lit(1)), lambda x: F.trim(x))
    return F.slice(F.array_distinct(F.filter(inner, lambda u: u.rlike("^[hH][tT][tT][pP][sS]?://"))), 1, MAX_URLS)


def text_urls(text: Column, trailing: str) -> Column:
    """http(s) URLs of free text without trailing punctuation."""
    found = F.regexp_extract_all(text, F.lit(r"[hH][tT][tT][pP][sS]?://[^\t-\r <>\"'`]+"), F.lit(0))
    return F.transform(found, lambda u: F.regexp_replace(u, trailing, ""))


def base64_candidates(body: Column) -> Column:
    """Tokens that look like base64, 20 payload characters or more; the first five count, whether they decode or not."""
    tokens = F.transform(F.split(body, r"[\t-\r ]+"), lambda t: F.regexp_replace(F.regexp_replace(t, "^[(\\[{<\"'`]+", ""), "[)\\]}>\"'`,;:.!?]+$", ""))
    ok = F.filter(tokens, lambda t: t.rlike(r"^[A-Za-z0-9+/]{20,}={0,2}$") & (F.octet_length(t) <= MAX_BASE64_CHARS))
    return F.slice(ok, 1, MAX_BASE64)


def base64_urls(body: Column) -> Column:
    decoded = F.filter(F.transform(base64_candidates(body), base64_text), lambda d: d.isNotNull() & (F.octet_length(d) <= MAX_DECODED))
    return F.array_distinct(F.flatten(F.transform(decoded, lambda d: text_urls(d, r"[\])}>,;.!?]+$"))))


def data_uri_text(uri: Column) -> Column:
    """The text of a data URI of type text/plain (the default) or text/html; null otherwise or beyond 10,240 bytes."""
    head = F.lower(F.regexp_extract(uri, r"^[dD][aA][tT][aA]:([^,]*),", 1))
    payload = F.regexp_extract(uri, r"^[dD][aA][tT][aA]:[^,]*,([\s\S]*)$", 1)
    kind = F.trim(F.regexp_extract(head, r"^([^;]*)", 1))
    plain = percent_decode(payload, False)
    packed = F.regexp_replace(plain, r"[\t-\r ]+", "")
    text = F.when(head.rlike(r";\s*base64\s*(;|$)"), F.when(F.octet_length(packed) <= MAX_DATA_CHARS, base64_text(packed))).otherwise(plain)
    ok = uri.rlike(r"^[dD][aA][tT][aA]:[^,]*,") & kind.isin("", "text/plain", "text/html") & (F.octet_length(text) <= MAX_DECODED)
    return F.when(ok, text)


def data_uri_urls(uris: Column, known: Column) -> Column:
    """New URLs inside data URIs (the first 100 different ones)."""
    texts = F.filter(F.transform(F.slice(F.array_distinct(uris), 1, MAX_DATA_URIS), data_uri_text), lambda t: t.isNotNull())
    found = F.array_distinct(F.flatten(F.transform(texts, lambda t: text_urls(t, r"[\])}>,;]+$"))))
    return F.array_except(found, known)


def attribute_uris(attrs: Column) -> Column:
    """Data URIs of navigating attributes ARRAY<STRUCT<tag, attr, value>> (see markup), each once."""
    values = F.transform(attrs, lambda a: F.trim(T.basic_entities(a["value"])))
    return F.array_distinct(F.filter(values, lambda v: v.rlike("^[dD][aA][tT][aA]:")))


def page_markup(pages: Column) -> Column:
    """struct(anchors, attrs, images) of a message's HTML parts (ARRAY<STRING>), attrs being those that may carry data URIs."""
    return markup(pages, R.DATA_URI_ATTRS)


def http_href(href: Column) -> Column:
    """A link target as http(s): entities decoded, // and ws(s) rewritten; null for other schemes."""
    h = F.trim(T.basic_entities(href))
    h = F.when(h.startswith("//"), F.concat(F.lit("https:"), h)).otherwise(h)
    h = F.when(F.lower(h).startswith("ws://"), F.concat(F.lit("http://"), F.substr(h, F.lit(6)))).when(F.lower(h).startswith("wss://"), F.concat(F.lit("https://"), F.substr(h, F.lit(7)))).otherwise(h)
    return F.when(F.lower(h).rlike("^https?://"), h)


def hrefs(anchors: Column) -> Column:
    """Targets of links (ARRAY<STRUCT<href, text>>) that lead to http(s), entities decoded, each once."""
    return F.array_distinct(F.filter(F.transform(anchors, lambda a: http_href(a["href"])), lambda h: h.isNotNull()))


def redirect_targets(url: Column) -> Column:
    """ARRAY<STRUCT<parameter, target>>: URLs inside a URL's query, under a redirect parameter or behind a redirect path."""
    last = F.regexp_extract(F.regexp_replace(F.lower(D.url_path(url)), "/+$", ""), "/([^/]+)$", 1)
    query = F.regexp_replace(D.url_query(url), "&amp;|&AMP;", "&")
    pairs = F.filter(F.split(query, "[&;]"), lambda p: p.rlike("^[^=]+="))
    named = F.transform(pairs, lambda p: F.struct(F.lower(fully_decode(F.regexp_extract(p, "^([^=]+)=", 1))).alias("parameter"), fully_decode(F.regexp_extract(p, r"^[^=]+=([\s\S]*)$", 1)).alias("target")))
    return F.filter(named, lambda t: (D.among(t["parameter"], R.REDIRECT_PARAMS) | D.among(last, R.REDIRECT_PATHS)) & F.lower(t["target"]).rlike("^(https?|wss?)://"))


_ICAL_URL = re.compile(r"[A-Za-z][A-Za-z0-9_+.-]*://[A-Za-z0-9.\-_%:/?=&~#+]+")


def ical_links(content: str | None) -> list[str]:
    """URLs of a calendar's events: URL, DESCRIPTION and ATTACH lines inside VEVENT, after unfolding."""
    if content is None or len(content.encode("utf-8", "replace")) > MAX_PART or "begin:vcalendar" not in content.lower():
        return []
    text = re.sub(r"\n[ \t]", "", re.sub(r"\r\n|[\r\v\f]", "\n", content))
    depth, out = 0, {}
    for line in text.split("\n"):
        name, _, value = line.partition(":")
        prop, _, params = name.partition(";")
        prop = prop.strip().upper()
        if prop in ("BEGIN", "END") and value.strip().upper() == "VEVENT":
            depth = max(0, depth + (1 if prop == "BEGIN" else -1))
        elif depth and prop in ("URL", "DESCRIPTION", "ATTACH"):
            if "ENCODING=QUOTED-PRINTABLE" in params.upper():
                value = decode_quoted_printable(value) or ""
            for u in _ICAL_URL.findall(value):
                scheme, _, rest = u.partition("://")
                if scheme.lower() in ("http", "https", "ws", "wss") and rest:
                    out.setdefault({"ws": "http", "wss": "https"}.get(scheme.lower(), scheme) + "://" + rest)
    return list(out)[:MAX_URLS]


_SVG_ATTRS = {"foreignobject": ["data"], "image": ["href", "xlink:href"], "use": ["href"], "a": ["href"]}


def svg_links(content: str | None) -> list[str]:
    """URLs of an SVG's navigating attributes; comments and processing instructions don't count."""
    if content is None:
        return []
    text = re.sub(r"<!--.*?-->|<\?.*?\?>", "", content, flags=re.S)
    out: dict[str, None] = {}
    for name, attrs in re.findall(r"<([A-Za-z_][\w.:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", text):
        wanted = _SVG_ATTRS.get(name.rpartition(":")[2].lower(), [])
        for key, a, b in re.findall(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", attrs):
            u = (decode_entities(a or b) or "").strip()
            u = "https:" + u if u.startswith("//") else u
            m = re.match(r"(https?|wss?)://\S", u, re.I)
            if key.lower() in wanted and m:
                out.setdefault(re.sub(r"^[wW][sS]", "http", u) if m[1].lower().startswith("ws") else u)
    return list(out)


@F.pandas_udf(ArrayType(StringType()))
def ical_urls(content: pd.Series) -> pd.Series:
    return content.map(ical_links)


@F.pandas_udf(ArrayType(StringType()))
def svg_urls(content: pd.Series) -> pd.Series:
    return content.map(svg_links)


CALENDARS, DRAWINGS = ["text/calendar", "application/calendar"], ["image/svg+xml"]


def part_contents(parts: Column, kinds: list[str], most: int | None = None) -> Column:
    """ARRAY<BINARY>: the contents of a message's parts of some types, at most `most` bytes each."""
    fits = lambda p: F.lit(True) if most is None else F.octet_length(p["content"]) <= most
    return F.transform(F.filter(parts, lambda p: F.lower(p["mime"]).isin(kinds) & p["content"].isNotNull() & fits(p)), lambda p: p["content"])


def _each(contents: pd.Series, read) -> pd.Series:
    """Links of all parts of a message, first seen first, each once."""
    return contents.map(lambda cs: [] if cs is None else list(dict.fromkeys(u for c in cs for u in read(bytes(c).decode("utf-8", "replace")))))


@F.pandas_udf(ArrayType(StringType()))
def calendar_part_urls(contents: pd.Series) -> pd.Series:
    return _each(contents, ical_links).map(lambda us: us[:MAX_URLS])


@F.pandas_udf(ArrayType(StringType()))
def drawing_part_urls(contents: pd.Series) -> pd.Series:
    return _each(contents, svg_links)


def image_attachments(parts: Column) -> Column:
    """ARRAY<BINARY>: attached PNG, JPEG and GIF images of at most 1 MiB."""
    wanted = lambda p: p["attached"] & F.lower(p["mime"]).isin(R.ATTACHMENT_OCR_TYPES) & p["length"].between(0, R.ATTACHMENT_OCR_MAX)
    return F.transform(F.filter(parts, wanted), lambda p: p["content"])


def reader(read, seconds: float = 0.4):
    """A function of bytes to text as a function of Columns, ARRAY<BINARY> to ARRAY<STRING>; what fails or takes longer
    than `seconds` gives null, and the scan goes on."""

    @F.pandas_udf(ArrayType(StringType()))
    def apply(images: pd.Series) -> pd.Series:
        from concurrent.futures import ThreadPoolExecutor

        pool = ThreadPoolExecutor(8)

        def one(image) -> str | None:
            try:
                return pool.submit(read, bytes(image)).result(seconds)
            except Exception:  # whatever a reader raises, the message is scanned without its text
                return None

        out = images.map(lambda xs: [] if xs is None else [None if x is None else one(x) for x in xs])
        pool.shutdown(wait=False, cancel_futures=True)
        return out

    return apply


def ocr_attachments(parts: DataFrame) -> DataFrame:
    """Attachments that are worth reading: small PNG, JPEG or GIF; the filter stands before any content is touched."""
    kind = F.concat_ws("/", F.lower("main_type"), F.lower("subtype"))
    return parts.where("is_attachment").where(kind.isin(R.ATTACHMENT_OCR_TYPES) & F.col("length").between(0, R.ATTACHMENT_OCR_MAX))


def attachment_scan(parts: DataFrame, known: DataFrame, ocr=lambda c: c.cast("string")) -> DataFrame:
    """Per message: attachments tried and the new URLs read from them. ocr maps image bytes to text (default: as is).

    A message fires when one attachment was tried, even if nothing was read.
    """
    read = ocr_attachments(parts).withColumn("_text", F.substring(T.clean_ocr_text(ocr(F.col("content"))), 1, R.OCR_TEXT_MAX))
    urls = read.groupBy("message_id").agg(F.count("*").alias("attachments"), F.array_distinct(F.flatten(F.collect_list(text_urls(F.coalesce("_text", F.lit("")), r"[\])}>,;.!?]+$")))).alias("found"))
    return urls.join(known.select("message_id", "urls"), "message_id", "left").select("message_id", "attachments", F.array_sort(F.array_except("found", F.coalesce("urls", F.array().cast("array<string>")))).alias("new_urls"))


def training_text(url: Column, template: str) -> Column:
    """A training message about a URL: the template with every {url} replaced."""
    parts = [F.lit(p) for p in template.split("{url}")]
    return F.concat(*(x for k, p in enumerate(parts) for x in ((url, p) if k else (p,))))
