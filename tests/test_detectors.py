"""Case tables of the detectors: what fires and what must stay silent."""

import pytest
from pyspark.sql import functions as F

from threatloom.functions import codecs as C
from threatloom.functions import domains as D
from threatloom.functions import text as T
from threatloom.operators import detect, extract


def values(spark, schema, rows, **cols):
    return spark.createDataFrame(rows, schema).select(*(c.alias(n) for n, c in cols.items())).collect()


PHISH = [
    ("paypal.com.evil-site.net", "/", "subdomain_impersonation"), ("secure-paypal.support.net", "/", "subdomain_impersonation"), ("www.paypal.com", "/", None),
    ("office365.example.org", "/", None), ("sellercentral.amazon.co.uk", "/", None), ("a.b.c.d.account.xyz", "/", "excessive_subdomains"),
    ("a.b.c.account.xyz", "/", None), ("dropbox.com", "/paypal/x", "brand_in_path"), ("paypal.com", "/paypal", None), ("x.net", "/pineapple", None),
    ("vendor.x.net", "/", None), ("x.net", "/global", None), ("x.com", "/twitter", None), ("google.com", "/search", None), ("", "/", None),
]


def test_phish_url(spark):
    rows = spark.createDataFrame([(h, p) for h, p, _ in PHISH], "h string, p string").coalesce(1)
    assert [r[0] for r in rows.select(detect.phish_reason(F.col("h"), F.col("p"))["reason"]).collect()] == [x[2] for x in PHISH]


LOOK = [
    ("paypa1.com", "homoglyph", "paypal"), ("rnicrosoft.com", "homoglyph", "microsoft"), ("login.g00gle.net", "homoglyph", "google"), ("paypal.com", None, None),
    ("gooogle.com", "levenshtein", "google"), ("apps.apple.com", None, None), ("secure-amazom.org", "levenshtein", "amazon"), ("example.org", None, None),
    ("vvellsfargo.com", "homoglyph", "wellsfargo"), ("PAYPA1.COM.", "homoglyph", "paypal"), ("suppl1er.biz", "homoglyph", "supplier"),
]


def test_lookalikes(spark):
    rows = spark.createDataFrame([(h,) for h, *_ in LOOK], "h string").coalesce(1)
    f = detect.lookalike_reason(F.col("h"))
    assert [(r[0], r[1]) for r in rows.select(f["reason"], f["brand"]).collect()] == [x[1:] for x in LOOK]


def test_reply_to_distance(spark):
    rows = [("a.corp.com", "b.corp.com"), ("corp.com", "c0rp.com"), ("corp.com", "corp.co.uk"), ("corp.com", "other.com"), (None, "x.com")]
    got = values(spark, "a string, b string", rows, d=detect.reply_distance(F.col("a"), F.col("b")))
    assert [r.d for r in got] == [None, 1, None, None, None]


def test_punycode():
    assert C.decode_punycode("bcher-kva") == "bücher"
    assert C.decode_punycode("80ak6aa92e") == "аррӏе"
    assert C.decode_punycode("a!") is None and C.decode_punycode("bcher-kv") is None and C.decode_punycode("a" * 60) is None
    assert C.decode_host("www.xn--bcher-kva.de") == "www.bücher.de" and C.decode_host("plain.de") is None and C.decode_host("xn--a!.de") is None


def test_idn_homograph(spark):
    rows = [("xn--80ak6aa92e.com",), ("xn--bcher-kva.de",), ("apple.com",), ("xn--!!.com",)]
    got = values(spark, "h string", rows, f=detect.idn_homograph(F.col("h")))
    assert [r.f and r.f["brand"] for r in got] == ["apple", None, None, None]


BEC = [
    ("please buy a gift card", None, None, True), ("gift cards and a purchase", None, None, True), ("the buyer wants a gift card", None, None, False), ("wire transfer today", None, None, True),
    ("swift2 today", None, None, False), ("between us: the payment", None, None, True), ("refund", "a.com", "b.com", False), ("the funds", "a.com", "b.com", True), ("the funds", "a.com", "a.com", False),
    ("the funds2", "a.com", "b.com", False), ("3payment", "a.com", "b.com", True), ("", None, None, False),
]


def test_bec(spark):
    rows = spark.createDataFrame([x[:3] for x in BEC], "t string, f string, r string").coalesce(1)
    assert [r[0] for r in rows.select(detect.bec(F.col("t"), F.col("f"), F.col("r"))).collect()] == [x[3] for x in BEC]


SOCIAL = "cfo here, urgent, call me at +1 (555) 123-4567"


@pytest.mark.parametrize(
    ("text", "plain", "links", "sender", "fires"),
    [(SOCIAL, True, False, "out.net", True), (SOCIAL.replace("cfo", "scfo"), True, False, "out.net", False), (SOCIAL, False, False, "out.net", False), (SOCIAL, True, True, "out.net", False),
     (SOCIAL, True, False, "corp.com", False), (SOCIAL, True, False, None, False), (SOCIAL.replace("urgent", "soon"), True, False, "out.net", False), (SOCIAL.replace("4567", ""), True, False, "out.net", False)],
)
def test_social_engineering(spark, text, plain, links, sender, fires):
    c = detect.social_engineering(F.lit(text), F.lit(plain), F.lit(links), F.lit(sender).cast("string"), F.array(F.lit("corp.com")))
    assert bool(spark.range(1).select(c.alias("x")).first().x) is fires


def test_display_names(spark):
    rows = [("PayPal Support", "evil.net"), ("PayPal", "mail.paypal.com"), ("Pine Apple", "x.org"), ("Pineapple", "x.org"), ("Bank of America", "x.org"), ("Pay", "x.org"), (None, "x.org"), ("Citi Bank", "citi.com")]
    got = values(spark, "n string, d string", rows, b=detect.display_brand(F.col("n")), f=detect.impersonates(F.col("n"), F.col("d")))
    assert [(r.b, bool(r.f)) for r in got] == [("paypal", True), ("paypal", False), ("apple", True), (None, False), ("bankofamerica", True), (None, False), (None, False), ("citibank", False)]


def test_link_mismatch(spark):
    rows = [("https://evil.net", "paypal.com"), ("https://www.paypal.com", "paypal.com"), ("https://evil.net", "Version 1.23"), ("//evil.net/a", "<b>shop.de</b>"), ("mailto:a@b.de", "c.de"), ("wss://a.org", "b.org"), (None, "x.de")]
    got = values(spark, "h string, t string", rows, f=detect.link_mismatch(F.col("h"), F.col("t")))
    assert [bool(r.f) for r in got] == [True, False, False, True, False, True, False]


REDIRECTS = [
    ("https://a.com/r?next=https%3A%2F%2Fb.org", "cross_domain_redirect"), ("https://a.com/r?next=https://x.a.com", None), ("https://a.com/go/?q=https://paypal-login.net", "LOOKALIKE_DOMAIN"),
    ("https://a.com/?url=https://m1crosoft.com", "LOOKALIKE_DOMAIN"), ("https://a.com/?to=http://paypal.evil-host.biz", "PHISH_URL_HEURISTIC"), ("https://a.com/?to=http://evil.host.biz", "reserved_threat_label:evil"),
    ("https://a.com/?foo=https://b.org", None), ("https://a.com/?goto=%2520https%253A%252F%252Fb.org", "cross_domain_redirect"), ("https://a.com/?a=1&amp;redirect=wss://b.org", "cross_domain_redirect"), ("https://a.com/?next=/local", None),
]


def test_open_redirects(spark):
    rows = spark.createDataFrame([(u,) for u, _ in REDIRECTS], "u string").coalesce(1)
    assert [r[0] for r in rows.select(detect.open_redirect(F.col("u"))["found"]["evidence"]).collect()] == [x[1] for x in REDIRECTS]


def test_header_urls(spark):
    rows = [("<https://a.de/1>, < HTTP://b.de >, <https://a.de/1> <mailto:x> https://c.de",), (None,), (", ".join(f"<https://a.de/{i}>" for i in range(150)),)]
    got = values(spark, "h string", rows, u=extract.header_urls(F.col("h")))
    assert got[0].u == ["https://a.de/1", "HTTP://b.de"] and got[1].u == [] and len(got[2].u) == 100


def test_base64_urls(spark):
    import base64

    good = base64.b64encode(b"see https://hid.den/x now").decode()
    rows = [(f"x ({good}).",), ("c2hvcnQ=",), (" ".join(["A" * 20] * 5 + [good]),), (f"data:image/png;base64,{good}",), (good.rstrip("="),), ("!!!!" + "a" * 30,)]
    got = values(spark, "b string", rows, u=extract.base64_urls(F.col("b")))
    assert [r.u for r in got] == [["https://hid.den/x"], [], [], [], ["https://hid.den/x"], []]


def test_data_uris(spark):
    import base64

    packed = base64.b64encode(b"<a href=https://hid.den/x>").decode()
    rows = [("data:,see%20https://a.de/+b",), (f"data:text/html;base64,{packed}",), ("data:image/png,https://a.de",), ("data:text/plain," + "a" * 10_241,), ("data:,100% https://a.de/x.",), ("https://a.de",)]
    got = values(spark, "u string", rows, u=extract.data_uri_urls(F.array("u"), F.array(F.lit("https://known.de"))))
    assert [r.u for r in got] == [["https://a.de/+b"], ["https://hid.den/x"], [], [], ["https://a.de/x."], []]


def test_calendars_and_svg():
    ics = "BEGIN:VCALENDAR\r\nURL:https://out.de\r\nBEGIN:VEVENT\r\nDESCRIPTION:go to https://long.de/pa\r\n th?x=1\r\nURL;VALUE=URI:wss://w.de/a\r\nATTACH;ENCODING=QUOTED-PRINTABLE:https=3A//q.de\r\nEND:VEVENT\r\nEND:VCALENDAR"
    assert extract.ical_links(ics) == ["https://long.de/path?x=1", "https://w.de/a", "https://q.de"]
    assert extract.ical_links(None) == [] and extract.ical_links("BEGIN:VEVENT\nURL:https://a.de") == []
    svg = "<svg><!-- <a href='https://no.de'/> --><x:a href=\"&#104;ttps://a.de/&amp;x\"/><image xlink:href='//b.de/c'/><use xlink:href='https://no.de'/><foreignObject data='ws://d.de'/></svg>"
    assert extract.svg_links(svg) == ["https://a.de/&x", "https://b.de/c", "http://d.de"] and extract.svg_links(None) == []


def test_ocr_selection(spark):
    part = "struct<mime string, length bigint, width int, height int, multipart boolean>"
    img = lambda n, mime="image/png", w=None: (mime, n, w, 1000, False)
    rows = [([img(20_000), ("text/plain", 100, None, None, False)], 0.0), ([img(20_000), ("text/plain", 5000, None, None, False)], 0.0), ([img(10_239)], 0.0), ([img(20_000, w=1001)], 0.0), ([img(20_000)], 4.0), ([], 0.0), ([img(20_000, "image/svg+xml")], 0.0)]
    got = values(spark, f"p array<{part}>, l double", rows, f=detect.ocr_selection(F.col("p"), F.col("l")))
    assert [r.f["reason"] for r in got] == ["process", "image_ratio_below_threshold", "no_eligible_images", "no_eligible_images", "overloaded", "no_eligible_images", "no_eligible_images"]


def test_attachment_scan(spark):
    parts = spark.createDataFrame(
        [("m1", True, "image", "png", 10, b"go https://a.de/x. https://known.de"), ("m1", True, "image", "png", 1_048_577, b"https://big.de"), ("m1", False, "image", "png", 5, b"https://inline.de"), ("m2", True, "image", "gif", 0, b"")],
        "message_id string, is_attachment boolean, main_type string, subtype string, length bigint, content binary",
    )
    known = spark.createDataFrame([("m1", ["https://known.de"])], "message_id string, urls array<string>")
    got = {r.message_id: (r.attachments, r.new_urls) for r in extract.attachment_scan(parts, known).collect()}
    assert got == {"m1": (1, ["https://a.de/x"]), "m2": (1, [])}


def test_host_functions(spark):
    rows = [("WWW.Shop.co.uk:443.",), ("..a.b",), ("localhost",), ("",)]
    h = D.normalize_host(F.col("h"))
    got = values(spark, "h string", rows, n=h, r=D.registered_domain(h), s=D.public_suffix(h))
    assert [(r.n, r.r, r.s) for r in got][1:] == [("a.b", "a.b", "b"), ("localhost", "localhost", "localhost"), ("", "", "")]
    assert values(spark, "h string", [("www.shop.co.uk",)], r=D.registered_domain(F.col("h")))[0].r == "shop.co.uk"


def test_text_functions(spark):
    got = values(spark, "t string", [("call +49 (0) 170 123 4567 or 12-34",)], p=T.phone_candidates(F.col("t")), a=T.action_name(F.lit(" Add Header ")), e=T.html_escape(F.lit("<a&b>")))
    assert (got[0].p, got[0].a, got[0].e) == (["+49 (0) 170 123 4567"], "add_header", "&lt;a&amp;b&gt;")


def test_spaced_brand_equals_token_scan():
    """The pattern says what a scan over runs of consecutive tokens says."""
    import random
    import re

    rng = random.Random(5)
    for _ in range(3000):
        tokens = ["".join(rng.choice("chase") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 5))] if rng.random() < 0.7 else [x for x in re.split("(?<=.)", "chase") if x]
        runs = any("".join(tokens[i:j]) == "chase" for i in range(len(tokens)) for j in range(i + 1, len(tokens) + 1))
        assert bool(re.search(detect.spaced_brand("chase"), " ".join(tokens))) == runs


def test_execution_order():
    order = detect.execution_order()
    assert order.index("HEADER_URL_EXTRACTION") < order.index("PHISH_URL_HEURISTIC") < order.index("OPEN_REDIRECT")
    detect.REGISTRY["_A"] = detect.Detector("_A", 0, "", "normal", lambda: F.lit(True), after=["_A"])
    with pytest.raises(ValueError, match="circular"):
        detect.execution_order(["_A"])
    del detect.REGISTRY["_A"]
