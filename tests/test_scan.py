"""The scan from raw mail to verdicts: what extractors find reaches the URL detectors."""

import base64
import sys
import time
from html.parser import HTMLParser

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from threatloom.functions import refdata as R
from threatloom.operators import detect, extract, maps
from threatloom.plans.scan import scan
from threatloom.sources.mime import MESSAGE, parse_message

HEAD = b"From: a@b.com\nDate: x\n"
PAGE = HEAD + b"Content-Type: text/html\n\n"
MAIL = {
    "unsubscribe": (HEAD + b"List-Unsubscribe: <https://paypal.com.evil-site.net/u>\n\nhello", {"HEADER_URL_EXTRACTION", "PHISH_URL_HEURISTIC"}, "no_action"),
    "idn": (PAGE + b"<A HREF='https://xn--80ak6aa92e.com/x'>x</A>", {"LOOKALIKE_DOMAIN", "IDN_HOMOGRAPH"}, "add_header"),
    "redirect": (HEAD + b"\nsee https://a.com/redirect?url=https://m1crosoft.com", {"LOOKALIKE_DOMAIN", "OPEN_REDIRECT"}, "add_header"),
    "gtube": (HEAD + b"\n" + R.GTUBE.encode(), {"GTUBE"}, "reject"),
    "encoded": (b"From: good <x@fine.com>, =?utf-8?B?UGF5UGFsIFN1cHBvcnQ=?= <a@evil.net>\nDate: x\nSubject: =?utf-8?B?YnV5IGdpZnQgY2FyZHM=?=\n\nhi", {"BEC_PATTERN", "FROM_DISPLAY_IMPERSONATION"}, "add_header"),
    "span": (PAGE + b'<a\nhref="https://evil.net"><span>Go to</span> paypal.com</a>', {"HTML_LINK_MISMATCH"}, "add_header"),
    "data": (PAGE + b'<a href="data:text/html,%3Ca%20href=http://login.paypal.evil.net/%3E">x</a>', {"DATA_URI_URL_EXTRACTION", "PHISH_URL_HEURISTIC"}, "no_action"),
    "relative": (PAGE + b"<a class=x href=//paypal.evil.net/>x</a>", {"PHISH_URL_HEURISTIC"}, "no_action"),
    "virus": (HEAD + b"\n" + R.EICAR.encode(), {"CLAM_VIRUS"}, "no_action"),
    "undated": (b"From: a@b.com\n\nhello", {"MISSING_DATE"}, "no_action"),
    "calendar": (HEAD + b"Content-Type: text/calendar\n\nBEGIN:VCALENDAR\nBEGIN:VEVENT\nURL:https://login.paypal.evil.net/\nEND:VEVENT\nEND:VCALENDAR\n", {"ICAL_URL_EXTRACTION", "PHISH_URL_HEURISTIC"}, "no_action"),
    "drawing": (HEAD + b"Content-Type: image/svg+xml\n\n<svg><a href='https://m1crosoft.com/'/></svg>", {"SVG_URL_EXTRACTION", "LOOKALIKE_DOMAIN"}, "add_header"),
    "quiet": (HEAD + b"\nhello there", set(), "no_action"),
}


def test_scan_end_to_end(spark):
    rows = [parse_message(k, raw) for k, (raw, *_) in MAIL.items()]
    got = {r.message_id: (set(r.fired), r.action) for r in scan(spark.createDataFrame(rows, MESSAGE)).collect()}
    assert got == {k: (fired | {"OCR_SKIPPED"}, action) for k, (_, fired, action) in MAIL.items()}


def picture(size: int, text: bytes) -> bytes:
    """The head of a PNG of 300 x 200, then a text that the test's reader finds."""
    head = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (300).to_bytes(4) + (200).to_bytes(4)
    return head + text + b" " * (size - len(head) - len(text))


def mail_with_picture(content: bytes, how: str, page: bytes = b"") -> bytes:
    body = base64.encodebytes(content)
    html = b"--x\nContent-Type: text/html\n\n" + page + b"\n" if page else b""
    return HEAD + b"Content-Type: multipart/mixed; boundary=x\n\n" + html + b"--x\nContent-Type: image/png\nContent-Transfer-Encoding: base64\nContent-Disposition: " + how.encode() + b"\n\n" + body + b"--x--\n"


def read_picture(image: bytes) -> str:
    if b"HANG" in image:
        time.sleep(3)
    return image[24:].decode()


def test_pictures_are_read(spark):
    """Attached pictures give URLs to the URL detectors, inline ones a text to the text rules; a reader that hangs or fails
    gives nothing, and an overloaded machine reads nothing."""
    mails = {
        "attached": mail_with_picture(picture(2_000, b"go to https://login.paypal.evil.net/x."), "attachment; filename=a.png"),
        "inline": mail_with_picture(picture(20_000, b"Buy   now: v1agra, c@sino"), "inline"),
        "hang": mail_with_picture(picture(20_000, b"HANG buy now"), "inline"),
        "broken": mail_with_picture(picture(20_000, b"\xff\xfe buy now"), "inline"),
        "empty": mail_with_picture(picture(2_000, b"x"), "inline", b"<img src=cid:1>"),
        "linked": mail_with_picture(picture(2_000, b"x"), "inline", b"<a href=#><img src=cid:1></a>"),
        "loaded": mail_with_picture(picture(20_000, b"buy now"), "inline"),
    }
    rows = spark.createDataFrame([parse_message(k, raw) for k, raw in mails.items()], MESSAGE)
    rows = rows.withColumn("load", F.when(F.col("message_id") == "loaded", 4.0).otherwise(0.5))
    names = ["ATTACHMENT_OCR_SCAN", "PHISH_URL_HEURISTIC", "OCR_CHECK", "R_EMPTY_IMAGE", "OBFUSCATED_SPAM"]
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    try:
        got = {(r.message_id, r.symbol): r.options for r in detect.detect(rows, names, ocr=extract.reader(read_picture, 1.0)).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
    assert got == {
        ("attached", "ATTACHMENT_OCR_SCAN"): ["attachments=1", "urls=1"], ("attached", "PHISH_URL_HEURISTIC"): ["subdomain_impersonation", "login.paypal.evil.net", "brand=paypal"], ("attached", "OCR_SKIPPED"): ["no_eligible_images"],
        ("inline", "OCR_PROCESSED"): ["reason=process", "images=1", "ratio=1.000"], ("inline", "OCR_SPAM_TEXT"): ["pattern=Buy now", "Buy now: v1agra, c@sino"], ("inline", "OBFUSCATED_SPAM"): [],
        ("hang", "OCR_SKIPPED"): ["no_text"], ("broken", "OCR_SKIPPED"): ["no_text"], ("loaded", "OCR_SKIPPED"): ["overloaded:load"],
        ("empty", "R_EMPTY_IMAGE"): [], ("empty", "OCR_SKIPPED"): ["no_eligible_images"], ("linked", "OCR_SKIPPED"): ["no_eligible_images"],
    }


class Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.hrefs = []

    def handle_starttag(self, tag, attrs):
        self.hrefs += [v for k, v in attrs if tag == "a" and k == "href"]


@pytest.mark.parametrize("page", [
    "<a href='x'>1</a><A HREF=\"y\">2</A><a\nhref=z>3</a>", '<a class="k" id=q href = "a&b">t <b>u</b></a>', "<a data-href='no' href='yes'>t</a>", "<abbr href='no'>t</abbr><a name='n'>u</a>", "no links",
])
def test_anchors_equal_a_parser(spark, page):
    p = Links()
    p.feed(page)
    row = spark.range(1).select(extract.page_markup(F.array(F.lit(page)))["anchors"].alias("a")).first()
    assert [x.href for x in row.a] == p.hrefs


def test_bad_extensions_and_user_rules(spark):
    raw = HEAD + b"Content-Type: multipart/mixed; boundary=x\n\n--x\nContent-Type: application/octet-stream\nContent-Disposition: attachment; filename=a.scr\n\nMZ\n--x--\n"
    detect.user_rule("SHORT_TEXT", "length(text) < 40", 1.5)
    try:
        rows = detect.detect(spark.createDataFrame([parse_message("m", raw)], MESSAGE), ["SHORT_TEXT", "MIME_BAD_EXTENSION"]).collect()
    finally:
        del detect.REGISTRY["SHORT_TEXT"]
    assert {r.symbol: r.options for r in rows} == {"SHORT_TEXT": [], "MIME_BAD_EXTENSION": ["a.scr"]}


def test_listed_hosts(spark):
    hosts = spark.createDataFrame([("m", "a.de"), ("m", "b.de"), ("n", "c.de")], "message_id string, host string")
    zones = spark.createDataFrame([("a.de", "z1"), ("a.de", "z2"), ("b.de", "z1")], "host string, zone string")
    assert [(r.message_id, r.symbol, r.options) for r in maps.listed_hosts(hosts, zones, "URL_LISTED").collect()] == [("m", "URL_LISTED", ["z1", "z2"])]
