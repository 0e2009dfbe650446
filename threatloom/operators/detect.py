"""Detectors as Column expressions and the registry that names, weighs and orders them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.functions import domains as D
from threatloom.functions import refdata as R
from threatloom.functions import text as T
from threatloom.functions.codecs import decode_host_udf, decode_hosts_udf
from threatloom.operators import extract as X


@dataclass
class Detector:
    """A symbol: test gives a Column (null or false: silent), options what it reports; `after` names earlier symbols.

    A virtual symbol has a `parent`: it reads what the parent found and comes with it.
    """

    name: str
    score: float
    group: str
    phase: str
    test: Callable[[], Column]
    options: Callable[[], Column] | None = None
    after: list[str] = field(default_factory=list)
    priority: int = 0
    parent: str | None = None
    multiplier: Callable[[], Column] | None = None


REGISTRY: dict[str, Detector] = {}


def detector(name: str, group: str, phase: str = "prefilter", after: tuple[str, ...] = (), priority: int = 0, options=None, parent: str | None = None, multiplier=None):
    """Register a function that returns a Column as the detector `name`; its weight comes from the reference values."""

    def add(test: Callable[[], Column]) -> Callable[[], Column]:
        REGISTRY[name] = Detector(name, R.WEIGHTS.get(name, 0.0), group, phase, test, options, [*after, *([parent] if parent else [])], priority, parent, multiplier)
        return test

    return add


def execution_order(names: list[str] | None = None) -> list[str]:
    """Prefilters before normal rules, higher priority first, and every detector after those it depends on."""
    wanted = set(names or REGISTRY)
    wanted |= {n for n, d in REGISTRY.items() if d.parent in wanted}
    todo = sorted(wanted, key=lambda n: (REGISTRY[n].phase != "prefilter", -REGISTRY[n].priority, n))
    out: list[str] = []

    def visit(n: str, path: tuple[str, ...] = ()) -> None:
        if n in path:
            raise ValueError(f"circular dependency: {' > '.join((*path, n))}")
        if n not in out:
            for d in REGISTRY[n].after:
                if d in REGISTRY:
                    visit(d, (*path, n))
            out.append(n)

    for n in todo:
        visit(n)
    return out


def with_urls(messages: DataFrame, ocr: Callable[[Column], Column] | None = None) -> DataFrame:
    """messages with what the extractors find, each in a column, and ``urls`` of all of them: the mail's own, its links' and
    the injected ones, each once, so that URL detectors see them all; own_urls keeps the mail's own. A redirect's finding
    and a decoded xn-- host are made once a message too.

    ocr reads pictures (ARRAY<BINARY> to ARRAY<STRING>, see extract.reader); without it no picture gives a text. A column
    ``load`` holds the machine's load; where it is missing nothing is shed. Missing ``parts`` are no parts.
    """
    page = F.coalesce("html", F.lit(""))
    none = F.array().cast("array<string>")
    if "html_parts" not in messages.columns:
        messages = messages.withColumn("html_parts", F.array("html"))
    if "from_all" not in messages.columns:
        messages = messages.withColumn("from_all", F.array(F.struct(F.col("from_name").alias("name"), F.col("from_domain").alias("domain"))))
    if "parts" not in messages.columns:
        messages = messages.withColumn("parts", F.array().cast("array<struct<mime string, length bigint, width int, height int, multipart boolean, filename string, attached boolean, content binary>>"))
    if "load" not in messages.columns:
        messages = messages.withColumn("load", F.lit(0.0))
    read = lambda images: F.transform(ocr(images), lambda t: F.substring(T.clean_ocr_text(t), 1, R.OCR_TEXT_MAX)) if ocr else none
    pictures = X.image_attachments(F.col("parts"))
    found = messages.withColumn("markup", X.page_markup(F.col("html_parts")))
    found = found.withColumns({
        "own_urls": F.coalesce("urls", none), "link_urls": X.hrefs(F.col("markup.anchors")), "header_urls": X.header_urls(F.col("list_unsubscribe")),
        "base64_urls": X.base64_urls(F.concat_ws(" ", "text_raw", page) if "text_raw" in messages.columns else page),
        "svg_urls": X.drawing_part_urls(X.part_contents(F.col("parts"), X.DRAWINGS)), "ical_urls": X.calendar_part_urls(X.part_contents(F.col("parts"), X.CALENDARS, X.MAX_PART)),
        "ocr": ocr_selection(F.col("parts"), F.col("load")), "attachments": F.coalesce(F.size(pictures), F.lit(0)), "attachment_texts": read(pictures),
    })
    chosen = F.transform(ocr_eligible(F.col("parts")), lambda p: p["content"])
    found = found.withColumn("ocr_text", F.nullif(F.array_join(read(F.when(F.col("ocr.reason") == "process", chosen)), "\n"), F.lit("")))
    found = found.withColumn("scan_text", F.concat_ws("\n", "text", T.ascii_lower(F.col("ocr_text"))))
    found = found.withColumn("data_uri_urls", X.data_uri_urls(X.attribute_uris(F.col("markup.attrs")), F.concat("own_urls", "link_urls")))
    injected = ("own_urls", "link_urls", "header_urls", "base64_urls", "data_uri_urls", "svg_urls", "ical_urls")
    found = found.withColumn("urls", F.array_distinct(F.concat(*(F.coalesce(c, none) for c in injected))))
    seen = F.flatten(F.transform("attachment_texts", lambda t: X.text_urls(F.coalesce(t, F.lit("")), r"[\])}>,;.!?]+$")))
    found = found.withColumn("attachment_urls", F.array_except(seen, "urls")).withColumn("urls", F.concat("urls", "attachment_urls"))
    # host, path and registered domain of every URL are made once, and so is every finding: detectors and options read them
    found = found.withColumn("sites", F.transform("urls", lambda u: F.struct(D.normalize_host(D.url_host(u)).alias("host"), D.url_path(u).alias("path"))))
    found = found.withColumn("sites", F.transform("sites", lambda s: F.struct(s["host"].alias("host"), s["path"].alias("path"), D.registered_domain(s["host"]).alias("domain"))))
    hosts = F.array_distinct(F.filter(F.col("sites.host"), lambda h: h.isNotNull() & (h != "")))
    found = found.withColumns({"hosts": hosts, "redirects": F.filter(F.transform("urls", open_redirect), lambda r: r.isNotNull())})
    encoded = lambda h: h.contains("xn--")
    found = found.withColumn("idn_from", F.filter(F.array(F.coalesce(D.normalize_host(F.col("from_domain")), F.lit(""))), encoded))
    found = found.withColumn("idn_names", F.concat(F.filter("hosts", encoded), "idn_from"))
    found = found.withColumn("idn_hosts", decode_hosts_udf(F.col("idn_names")))
    return found.withColumns({"phish": _phish_found(), "lookalike": _lookalike_found(), "mismatches": _mismatches()})


def detect(messages: DataFrame, names: list[str] | None = None, ocr: Callable[[Column], Column] | None = None) -> DataFrame:
    """(message_id, symbol, multiplier, options): all detectors in one projection over one scan, then one explode.

    messages may have been through with_urls already.
    """
    messages = messages if "markup" in messages.columns else with_urls(messages, ocr)
    fired = []
    for n in execution_order(names):
        d = REGISTRY[n]
        opts = d.options() if d.options else F.array().cast("array<string>")
        times = d.multiplier() if d.multiplier else F.lit(1.0)
        fired.append(F.when(F.coalesce(d.test(), F.lit(False)), F.struct(F.lit(n).alias("symbol"), times.alias("multiplier"), opts.alias("options"))))
    hits = messages.select("message_id", F.explode(F.filter(F.array(*fired), lambda x: x.isNotNull())).alias("_s"))
    return hits.select("message_id", "_s.symbol", "_s.multiplier", "_s.options")


# --- text -----------------------------------------------------------------------------------------------------------


def bec(text: Column, from_domain: Column, reply_domain: Column) -> Column:
    has = lambda terms: T.has_terms(text, terms)
    other = F.coalesce(from_domain != reply_domain, F.lit(False))
    return (has(R.GIFT) & has(R.PURCHASE)) | (has(R.WIRE) & has(R.URGENCY)) | (has(R.CONFIDENTIAL) & has(R.TRANSACTION)) | (other & has(R.TRANSACTION))


def social_engineering(text: Column, plain_only: Column, has_links: Column, from_domain: Column, rcpt_domains: Column) -> Column:
    """A plain message without links from another domain that claims authority, urges, asks for action and has a phone."""
    outside = from_domain.isNotNull() & F.exists(rcpt_domains, lambda d: d != from_domain)
    has = lambda terms: T.has_strict_terms(text, terms)
    return plain_only & ~has_links & outside & has(R.AUTHORITY) & has(R.SOCIAL_URGENCY) & has(R.SOCIAL_ACTION) & (F.size(T.phone_candidates(text)) > 0)


def spaced_brand(brand: str) -> str:
    """A brand spelt by whole tokens of a name, wherever the token borders fall."""
    return "(^| )" + " ?".join(brand) + "( |$)"


#: Any brand spelt by tokens: most names are through with one match.
_ANY_SPACED = "(^| )(?:" + "|".join(" ?".join(b) for b in R.BRAND_DOMAINS) + ")( |$)"


def display_brand(name: Column) -> Column:
    """In brand order, the first brand that consecutive tokens of a display name spell."""
    tokens = F.array_join(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), " ")
    spelt = lambda b: F.rlike(tokens, F.concat(F.lit("(^| )"), F.array_join(F.split(b, ""), " ?"), F.lit("( |$)")))
    return F.when(tokens.rlike(_ANY_SPACED), F.get(F.filter(D.values(R.BRAND_DOMAINS), spelt), F.lit(0)))


def impersonates(name: Column, domain: Column) -> Column:
    brand = display_brand(name)
    own = F.coalesce(F.exists(D.brand_home(brand), lambda d: D.under_domain(domain, d)), F.lit(False))
    return brand.isNotNull() & domain.isNotNull() & (domain != "") & ~own


OBFUSCATED = "(?i)(^|[^A-Za-z0-9_])(" + "|".join(R.OBFUSCATED) + ")($|[^A-Za-z0-9_])"
OCR_SPAM = "(?i)(" + "|".join(x.replace(r"\s", r"[\t-\r ]") for x in R.OCR_SPAM) + ")"
IP_HOST = r"^(([0-9]{1,3}\.){3}[0-9]{1,3}|\[?[0-9a-fA-F:]*:[0-9a-fA-F:]*:[0-9a-fA-F:.]*\]?)$"
#: One label that mixes ASCII Latin with Cyrillic or Greek.
MIXED_LABEL = f"[A-Za-z][^.]*[{R.GREEK}{R.CYRILLIC}]|[{R.GREEK}{R.CYRILLIC}][^.]*[A-Za-z]"

# --- URLs -----------------------------------------------------------------------------------------------------------


def phish_finding(h: Column, path: Column, domain: Column) -> Column:
    """struct(reason, brand) of a normalized host under its registered domain: brand in a label, too many subdomains, brand
    in the path; null if clean."""
    brand = D.brand_label(h)
    foreign = brand.isNotNull() & ~F.coalesce(F.array_contains(D.brand_home(brand), domain), F.lit(False)) & ~D.among(domain, R.RESERVED_EXAMPLES)
    extra = F.size(D.host_labels(h)) - F.size(D.host_labels(domain))
    in_path = D.path_brand(path, domain)
    give = lambda reason, b: F.struct(F.lit(reason).alias("reason"), b.alias("brand"))
    none = F.lit(None).cast("string")
    return F.when(h == "", None).when(foreign, give("subdomain_impersonation", brand)).when(extra >= 4, give("excessive_subdomains", none)).when(in_path.isNotNull(), give("brand_in_path", in_path))


def phish_reason(host: Column, path: Column) -> Column:
    """phish_finding of a host as it is written."""
    h = D.normalize_host(host)
    return phish_finding(h, path, D.registered_domain(h))


def lookalike_finding(h: Column, domain: Column) -> Column:
    """struct(reason, label, brand) of a normalized host: confusable spelling, then edit distance of the registered name;
    null if clean. Punycode homographs need a decoder in Python and are judged by idn_homograph."""
    spelt, near = D.confusable(h, domain), D.near_brand(domain)
    give = lambda reason, m: F.struct(F.lit(reason).alias("reason"), m["label"].alias("label"), m["brand"].alias("brand"))
    return F.when(spelt.isNotNull(), give("homoglyph", spelt)).when(near.isNotNull(), give("levenshtein", near))


def lookalike_reason(host: Column) -> Column:
    """lookalike_finding of a host as it is written."""
    h = D.normalize_host(host)
    return lookalike_finding(h, D.registered_domain(h))


def idn_homograph(host: Column) -> Column:
    """struct(label, brand) of an xn-- host whose letters mix Latin with Cyrillic or Greek and spell a brand."""
    return decoded_homograph(decode_host_udf(D.normalize_host(host)))


def decoded_homograph(decoded: Column) -> Column:
    """idn_homograph of a host that is decoded already."""
    mixed = decoded.rlike(f"[{R.LATIN}]") & decoded.rlike(f"[{R.CYRILLIC}{R.GREEK}]")
    parts = F.flatten(F.transform(F.transform(D.host_labels(decoded), D.skeleton), D.components))
    hit = D.first_match(parts, lambda p, b: p == b)
    return F.when(mixed & hit.isNotNull(), hit)


def reply_distance(from_domain: Column, reply_domain: Column) -> Column:
    """Edits between two different registered domains under one suffix, 1 or 2; null otherwise."""
    a, b = D.registered_domain(D.normalize_host(from_domain)), D.registered_domain(D.normalize_host(reply_domain))
    d = F.levenshtein(a, b, 2)
    return F.when((a != b) & (D.public_suffix(D.normalize_host(from_domain)) == D.public_suffix(D.normalize_host(reply_domain))) & d.between(1, 2), d)


def display_domain(text: Column) -> Column:
    """The first domain that a link's visible text shows."""
    shown = T.ascii_lower(T.squeeze(T.strip_tags(T.basic_entities(text))))
    found = F.regexp_extract_all(shown, F.lit(r"[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z0-9-]+"), F.lit(0))

    def valid(c: Column) -> Column:
        labels = D.host_labels(c)
        return (F.octet_length(c) <= 253) & F.forall(labels, lambda x: x.rlike("^[^-]") & x.rlike("[^-]$") & (F.length(x) <= 63) & ~x.rlike("^[0-9]+$")) & F.get(labels, F.size(labels) - 1).rlike("^[a-z][a-z0-9]+$")

    return F.get(F.filter(found, valid), F.lit(0))


def link_mismatch(href: Column, text: Column) -> Column:
    """struct(display, href) of registered domains where a link shows one domain and leads to another; null if not."""
    to, shown = D.registered_domain(D.normalize_host(D.url_host(X.http_href(href)))), D.registered_domain(display_domain(text))
    return F.when((to != "") & (shown != "") & (to != shown), F.struct(shown.alias("display"), to.alias("href")))


def redirect_finding(outer: Column, target: Column) -> Column:
    """struct(outer, target, evidence) for a redirect that leaves its registered domain; null if it stays."""
    a, host = D.registered_domain(D.normalize_host(D.url_host(outer))), D.normalize_host(D.url_host(target))
    b = D.registered_domain(host)
    parts = D.components(F.get(D.host_labels(b), F.lit(0)))
    owned = sorted({d for ds in R.BRAND_DOMAINS.values() for d in ds})
    close = D.first_match(parts, lambda p, brand: F.levenshtein(p, brand, 2).between(1, 2)).isNotNull()
    modified = ~D.among(b, owned) & F.exists(parts, lambda p: D.among(p, R.BRAND_DOMAINS))
    threat = F.get(F.filter(D.host_labels(host), lambda x: D.among(x, R.THREAT_LABELS)), F.lit(0))
    evidence = (
        F.when(D.confusable(host, b).isNotNull() | close | modified, "LOOKALIKE_DOMAIN")
        .when(phish_reason(host, F.lit(""))["reason"] == "subdomain_impersonation", "PHISH_URL_HEURISTIC")
        .when(threat.isNotNull(), F.concat(F.lit("reserved_threat_label:"), threat))
        .otherwise("cross_domain_redirect")
    )
    return F.when((a != "") & (b != "") & (a != b), F.struct(a.alias("outer"), b.alias("target"), evidence.alias("evidence")))


def open_redirect(url: Column) -> Column:
    """The first finding among a URL's redirect targets, in order, with its parameter."""
    judged = F.transform(X.redirect_targets(url), lambda t: F.struct(t["parameter"].alias("parameter"), redirect_finding(url, t["target"]).alias("found")))
    return F.get(F.filter(judged, lambda j: j["found"].isNotNull()), F.lit(0))


# --- parts ----------------------------------------------------------------------------------------------------------


def ocr_eligible(parts: Column) -> Column:
    """The first pictures that are worth reading: of a known type, neither tiny nor huge."""
    pixels_ok = lambda p: p["width"].isNull() | p["height"].isNull() | (p["width"].cast("long") * p["height"] <= R.OCR_PIXELS)
    return F.slice(F.filter(parts, lambda p: ~p["multipart"] & p["mime"].isin(R.OCR_TYPES) & p["length"].between(R.OCR_MIN, R.OCR_MAX) & pixels_ok(p)), 1, R.OCR_IMAGES)


def ocr_selection(parts: Column, load: Column) -> Column:
    """struct(reason, image_bytes, total_bytes, eligible) over parts ARRAY<STRUCT<mime, length, width, height, multipart>>.

    reason: overloaded, no_eligible_images, image_ratio_below_threshold or process.
    """
    leaves = F.filter(parts, lambda p: ~p["multipart"])
    total = F.aggregate(leaves, F.lit(0).cast("long"), lambda a, p: a + p["length"])
    images = F.filter(leaves, lambda p: p["mime"].startswith("image/"))
    image_bytes = F.aggregate(images, F.lit(0).cast("long"), lambda a, p: a + p["length"])
    good = F.size(ocr_eligible(parts))
    reason = F.when(load >= R.OCR_LOAD, "overloaded").when(good == 0, "no_eligible_images").when(~(image_bytes > R.OCR_RATIO * total), "image_ratio_below_threshold").otherwise("process")
    return F.struct(reason.alias("reason"), image_bytes.alias("image_bytes"), total.alias("total_bytes"), good.alias("eligible"))


def bad_extension(filename: Column) -> Column:
    """Multiplier of a file name's last extension; null for harmless ones."""
    table = F.expr("map(" + ", ".join(f"'{k}', {float(v)}D" for k, v in R.BAD_EXTENSIONS.items()) + ")")
    return F.element_at(table, F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1)))


def empty_image(html_bytes: Column, width: Column, height: Column, linked: Column) -> Column:
    """Hardly any HTML text beside a large picture that isn't a link."""
    return (html_bytes < 50) & (width + height >= 400) & ~linked


# --- registered symbols over the messages table -----------------------------------------------------------------------


def _counted(column: str) -> Callable[[], Column]:
    return lambda: F.array(F.concat(F.lit("count="), F.size(column).cast("string")))


@detector("HEADER_URL_EXTRACTION", "url", priority=9, options=_counted("header_urls"))
def _header() -> Column:
    return F.size("header_urls") > 0


@detector("BASE64_URL_EXTRACTION", "url", priority=9, options=_counted("base64_urls"))
def _base64() -> Column:
    return F.size("base64_urls") > 0


@detector("DATA_URI_URL_EXTRACTION", "url", priority=9, options=_counted("data_uri_urls"))
def _data_uri() -> Column:
    return F.size("data_uri_urls") > 0


@detector("SVG_URL_EXTRACTION", "url", priority=9, options=lambda: F.col("svg_urls"))
def _svg() -> Column:
    return F.size("svg_urls") > 0


@detector("ICAL_URL_EXTRACTION", "url", options=_counted("ical_urls"))
def _ical() -> Column:
    return F.size("ical_urls") > 0


def _tried() -> Column:
    return F.array(F.concat(F.lit("attachments="), F.col("attachments").cast("string")), F.concat(F.lit("urls="), F.size("attachment_urls").cast("string")))


@detector("ATTACHMENT_OCR_SCAN", "url", options=_tried)
def _attachments() -> Column:
    """Fires for a try, whether anything was read or not."""
    return F.col("attachments") > 0


@detector("OCR_CHECK", "ocr")
def _ocr_check() -> Column:
    """Decides for its virtual symbols and never fires itself."""
    return F.lit(False)


def _pictured() -> Column:
    """Options of a picture that was read: why, how many, and the pictures' share of the bytes."""
    ratio = F.format_string("%.3f", F.col("ocr.image_bytes") / F.nullif(F.col("ocr.total_bytes"), F.lit(0)))
    return F.array(F.lit("reason=process"), F.concat(F.lit("images="), F.col("ocr.eligible").cast("string")), F.concat(F.lit("ratio="), ratio))


@detector("OCR_PROCESSED", "ocr", parent="OCR_CHECK", options=_pictured)
def _ocr_processed() -> Column:
    return F.col("ocr_text").isNotNull()


@detector("OCR_SKIPPED", "ocr", parent="OCR_CHECK", options=lambda: F.array(F.when(F.col("ocr.reason") == "process", "no_text").when(F.col("ocr.reason") == "overloaded", "overloaded:load").otherwise(F.col("ocr.reason"))))
def _ocr_skipped() -> Column:
    return F.col("ocr_text").isNull()


@detector("OCR_SPAM_TEXT", "ocr", parent="OCR_CHECK", options=lambda: F.array(F.concat(F.lit("pattern="), F.regexp_extract("ocr_text", OCR_SPAM, 1)), F.substring(T.squeeze(F.col("ocr_text")), 1, 160)))
def _ocr_spam() -> Column:
    return F.col("ocr_text").rlike(OCR_SPAM)


@detector("R_EMPTY_IMAGE", "mime")
def _empty_image() -> Column:
    loose = F.exists("markup.images", lambda i: ~i["linked"])
    shown = F.octet_length(T.squeeze(T.strip_tags(F.coalesce("html", F.lit("")))))
    return loose & F.exists("parts", lambda p: empty_image(shown, p["width"], p["height"], F.lit(False)))


@detector("BEC_PATTERN", "bec")
def _bec() -> Column:
    return bec(F.col("text"), F.col("from_domain"), F.col("reply_domain"))


@detector("TEXT_SOCIAL_ENGINEERING", "social_engineering", phase="normal")
def _social() -> Column:
    links = (F.size("own_urls") > 0) | F.coalesce(F.col("text").rlike(r"(?i)\b(mailto|tel):[^\s]"), F.lit(False))
    # the sender's name reads first, and a term may run over a line's end
    text = T.ascii_lower(F.regexp_replace(F.concat_ws("\n", "from_name", "text"), r"[\t-\r ]+", " "))
    return social_engineering(text, F.col("plain_only"), links, F.col("from_domain"), F.col("rcpt_domains"))


def _impersonator() -> Column:
    first = F.get(F.filter("from_all", lambda m: impersonates(m["name"], m["domain"])), F.lit(0))
    return F.array(F.concat(F.lit("brand="), display_brand(first["name"])), F.concat(F.lit("from_domain="), first["domain"]))


@detector("FROM_DISPLAY_IMPERSONATION", "headers", options=_impersonator)
def _display() -> Column:
    return F.exists("from_all", lambda m: impersonates(m["name"], m["domain"]))


_EXTRACTORS = ("HEADER_URL_EXTRACTION", "BASE64_URL_EXTRACTION", "DATA_URI_URL_EXTRACTION", "SVG_URL_EXTRACTION", "ICAL_URL_EXTRACTION", "ATTACHMENT_OCR_SCAN")


def _named(**pairs: Column) -> Column:
    """Options key=value; a null value has none."""
    return F.filter(F.array(*(F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in pairs.items())), lambda x: x.isNotNull())


def _evidence(symbol: str) -> Column:
    """The first redirect whose target gives evidence for another symbol; null if none does."""
    return F.get(F.filter("redirects", lambda r: F.coalesce(r["found"]["evidence"] == symbol, F.lit(False))), F.lit(0))


def _any_url(test: Callable[[Column], Column]) -> Column:
    return F.exists("urls", lambda u: F.coalesce(test(u), F.lit(False)))


def _first(found: Column) -> Column:
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def _phish_found() -> Column:
    """Options of the first URL that the phishing heuristics name: its reason, host and brand; null if none."""

    def of(s: Column) -> Column:
        found = phish_finding(s["host"], s["path"], s["domain"])
        return F.when(found.isNotNull(), F.concat(F.array(found["reason"], s["host"]), _named(brand=found["brand"])))

    return F.coalesce(_first(F.transform("sites", of)), _target_options("PHISH_URL_HEURISTIC"))


def _target_options(symbol: str) -> Column:
    found = _evidence(symbol)
    return F.when(found.isNotNull(), F.array(F.lit("source=redirect_target"), F.concat(F.lit("target="), found["found"]["target"])))


def _lookalike_found() -> Column:
    """Options of the first look-alike: a URL's host, decoded or as it is, the sender's, or a reply address that is near the
    sender's; null if none."""

    def spelt(h: Column, domain: Column, source: str) -> Column:
        found = lookalike_finding(h, domain)
        return F.when(found.isNotNull(), F.concat(F.array(found["reason"], F.lit(f"source={source}")), _named(host=h, label=found["label"], brand=found["brand"])))

    def decoded(name: Column, host: Column) -> Column:
        found = decoded_homograph(host)
        source = F.when(F.array_contains("hosts", name), "source=url").otherwise("source=from")
        return F.when(found.isNotNull(), F.concat(F.array(F.lit("idn_homograph"), source), _named(host=name, label=found["label"], brand=found["brand"], decoded=host)))

    sender = D.normalize_host(F.col("from_domain"))
    edits = reply_distance(F.col("from_domain"), F.col("reply_domain"))
    near = F.when(edits.isNotNull(), F.concat(F.array(F.lit("reply_to_distance")), _named(distance=edits, **{"from": F.col("from_domain"), "reply_to": F.col("reply_domain")})))
    return F.coalesce(
        _first(F.zip_with("idn_names", "idn_hosts", decoded)), _first(F.transform("sites", lambda s: spelt(s["host"], s["domain"], "url"))), _target_options("LOOKALIKE_DOMAIN"),
        spelt(sender, D.registered_domain(sender), "from"), near,
    )


def _mismatches() -> Column:
    """Links that show another domain than they lead to, in order."""
    return F.filter(F.transform("markup.anchors", lambda a: link_mismatch(a["href"], a["text"])), lambda m: m.isNotNull())


@detector("PHISH_URL_HEURISTIC", "url", after=_EXTRACTORS, options=lambda: F.col("phish"))
def _phish() -> Column:
    return F.col("phish").isNotNull()


@detector("LOOKALIKE_DOMAIN", "url", after=_EXTRACTORS, options=lambda: F.col("lookalike"))
def _lookalike() -> Column:
    return F.col("lookalike").isNotNull()


@detector("HTML_LINK_MISMATCH", "url", phase="normal", options=lambda: F.flatten(F.transform("mismatches", lambda m: _named(display=m["display"], href=m["href"]))))
def _mismatch() -> Column:
    return F.size("mismatches") > 0


def _redirected() -> Column:
    r = F.get("redirects", F.lit(0))
    return _named(parameter=r["parameter"], outer=r["found"]["outer"], target=r["found"]["target"], evidence=r["found"]["evidence"])


@detector("OPEN_REDIRECT", "url", phase="normal", after=_EXTRACTORS, options=_redirected)
def _redirect() -> Column:
    return F.size("redirects") > 0


@detector("OBFUSCATED_SPAM", "multimap")
def _obfuscated() -> Column:
    return F.col("scan_text").rlike(OBFUSCATED)


@detector("IP_URL_SUSPICIOUS", "multimap")
def _ip() -> Column:
    return _any_url(lambda u: D.url_host(u).rlike(IP_HOST))


def protected_spelling(host: Column) -> Column:
    """A label beyond ASCII that reads as a protected brand, whatever scripts it is spelt in."""
    return F.exists(D.host_labels(host), lambda x: x.rlike(r"[^\x00-\x7F]") & D.among(D.skeleton(x), R.PROTECTED_BRANDS))


@detector("IDN_HOMOGRAPH", "multimap")
def _idn() -> Column:
    """One label of mixed scripts, or a protected brand's look-alike, in either spelling of the host."""
    decoded = F.exists("idn_hosts", lambda h: F.coalesce(protected_spelling(h) | h.rlike(MIXED_LABEL), F.lit(False)))
    return _any_url(lambda u: D.url_host(u).rlike(MIXED_LABEL) | protected_spelling(D.url_host(u))) | decoded


@detector("MISSING_DATE", "headers")
def _date() -> Column:
    return F.col("date").isNull()


@detector("GTUBE", "test")
def _gtube() -> Column:
    return F.contains(F.col("raw_text"), F.lit(R.GTUBE))


@detector("CLAM_VIRUS", "antivirus")
def _virus() -> Column:
    holds = lambda c: F.coalesce(F.contains(c, F.lit(R.EICAR)), F.lit(False))
    return holds(F.col("raw_text")) | F.coalesce(F.exists("parts", lambda p: holds(F.decode(p["content"], "ISO-8859-1"))), F.lit(False))


def _bad_multiplier() -> Column:
    """Every bad attachment counts with its own multiplier."""
    return F.aggregate("parts", F.lit(0.0), lambda a, p: a + F.coalesce(bad_extension(p["filename"]), F.lit(0.0)))


@detector("MIME_BAD_EXTENSION", "mime", options=lambda: F.filter(F.transform("parts", lambda p: p["filename"]), lambda f: bad_extension(f).isNotNull()), multiplier=_bad_multiplier)
def _extension() -> Column:
    return F.exists("parts", lambda p: bad_extension(p["filename"]).isNotNull())


def declared_otherwise(mime: Column, filename: Column) -> Column:
    """Whether an extension with a well-known type is declared as something else; generic types tell nothing."""
    known = F.expr("map(" + ", ".join(f"'{e}', array({', '.join(repr(k) for k in kinds)})" for e, kinds in R.EXTENSION_TYPES.items()) + ")")
    kinds = F.element_at(known, F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1)))
    return F.coalesce(kinds.isNotNull() & ~F.lower(mime).isin("application/octet-stream", "") & ~F.array_contains(kinds, F.lower(mime)), F.lit(False))


@detector("MIME_BAD_ATTACHMENT", "mime", options=lambda: F.transform(F.filter("parts", lambda p: declared_otherwise(p["mime"], p["filename"])), lambda p: F.concat_ws(":", p["mime"], p["filename"])))
def _attachment() -> Column:
    return F.exists("parts", lambda p: p["attached"] & declared_otherwise(p["mime"], p["filename"]))


def user_rule(name: str, condition: str, score: float, group: str = "user") -> None:
    """Register a rule whose condition is given as SQL text over the messages' columns, by configuration."""
    REGISTRY[name] = Detector(name, score, group, "normal", lambda: F.expr(condition), None, [n for n in _EXTRACTORS])
