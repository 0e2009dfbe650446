"""The HTML tokenizer against the standard library's parser, its table, and what detectors read of it."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from threatloom.functions import markup
from threatloom.operators import detect, extract
from threatloom.sources.mime import MESSAGE, parse_message


class Reference(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out = []

    def handle_starttag(self, tag, attrs):
        held = {}
        for k, v in attrs:
            held.setdefault(k, v or "")
        self.out.append(("start", tag, held))

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        self.out.append(("end", tag, None))


def tags(page):
    return [(t.kind, t.tag, t.attrs) for t in markup.tokens(page) if t.kind != "text"]


PIECES = ["<", "a", ">", " href='x'", "\"", "/", "</a>", "<a ", "<b x=1 y='>' >", "text", "<!-- c -->", "<!doctype html>", "<script>", "</script>", 'x="a > b"', "<br/>", "\n", "<p", "1"]


def test_tags_equal_the_librarys(small):
    import duckdb

    rng = random.Random(1)
    pages = [r[0] for r in duckdb.sql(f"SELECT html FROM '{small}/pages.parquet'").fetchall()]
    pages += ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    pages = [p for p in pages if "&" not in p or len(p) > 200]
    # a quote that never closes drops the tag by the standard, which the library reads otherwise
    differ = []
    for p in pages:
        r = Reference()
        r.feed(p)
        r.close()
        if r.out != tags(p) and p.count('"') % 2 == 0 and p.count("'") % 2 == 0 and "==" not in p:
            differ.append(p)
    assert not differ


def test_the_token_table(spark):
    page = '<p>see <A HREF="https://a.b/?x=1>2 3" title=t>one <b>two</b></a> three<!-- <a href=no> --><script>"</p><a href=no>"</script><a href=c>un<a href=d>closed'
    rows = markup.html_tokens(spark.createDataFrame([(1, page), (2, None), (3, "")], "id long, page string"), "id", "page").orderBy("id", "n").collect()
    assert [(r.kind, r.tag or r.text, r.link) for r in rows] == [
        ("start", "p", None), ("text", "see ", None), ("start", "a", 2), ("text", "one ", 2), ("start", "b", 2), ("text", "two", 2), ("end", "b", 2), ("end", "a", 2), ("text", " three", None),
        ("start", "script", None), ("text", '"</p><a href=no>"', None), ("end", "script", None), ("start", "a", 12), ("text", "un", 12), ("start", "a", 14), ("text", "closed", 14),
    ]
    assert rows[2].attrs == {"href": "https://a.b/?x=1>2 3", "title": "t"} and {r.id for r in rows} == {1}


def read(spark, *parts):
    row = spark.createDataFrame([(list(parts),)], "p array<string>").select(extract.page_markup(F.col("p")).alias("m"))
    return row.select(F.col("m.anchors").alias("anchors"), extract.hrefs(F.col("m.anchors")).alias("hrefs"), extract.attribute_uris(F.col("m.attrs")).alias("uris"), F.col("m.images").alias("images")).first()


def test_navigating_attributes_alone_carry_data_uris(spark):
    page = """<img src="data:text/html,https://img.net"><a href="data:text/html,<a href='https://in.net/a b'>x</a>">l</a><iframe src=data:,https://frame.net></iframe><video poster="data:,x"></video>
    <form action=' data:,https://form.net'><object data="DATA:,https://o.net"></object><base href="https://plain.net">"""
    got = read(spark, page, "<area href='data:,second'>", None, "")
    assert got.uris == ["data:text/html,<a href='https://in.net/a b'>x</a>", "data:,https://frame.net", "data:,https://form.net", "DATA:,https://o.net", "data:,second"]


def test_links_are_found_once_with_their_text(spark):
    got = read(spark, "<a href='//cdn.net/x'>a<b>b</b>c</a><a href=WSS://s.net>s</a><a href=\"https://e.net/?a=1&amp;b=2\">e</a><a href='//cdn.net/x'>again</a><a name=n>none</a><a href=mailto:x@y>m</a>", "<!-- open", "<a href=https://two.net>2")
    assert got.hrefs == ["https://cdn.net/x", "https://s.net", "https://e.net/?a=1&b=2", "https://two.net"]
    assert [a.text for a in got.anchors] == ["a b c", "s", "e", "again", "m", "2"]


def test_images_inside_links(spark):
    assert [i.linked for i in read(spark, "<a href=x><b><img src=1></b></a><img src=2>").images] == [True, False]


MAIL = "From: PayPal <a@evil.net>\nReply-To: x@evi1.net\nDate: x\nContent-Type: text/html\n\n"


EVIDENCE = [
    ("<a href='https://paypal.evil.net/x'>x</a>", "PHISH_URL_HEURISTIC", ["subdomain_impersonation", "paypal.evil.net", "brand=paypal"]),
    ("<a href='https://a.b.c.d.e.evil.org/x'>x</a>", "PHISH_URL_HEURISTIC", ["excessive_subdomains", "a.b.c.d.e.evil.org"]),
    ("<a href='https://paypa1.com/x'>x</a>", "LOOKALIKE_DOMAIN", ["homoglyph", "source=url", "host=paypa1.com", "label=paypa1", "brand=paypal"]),
    ("<a href='https://gooogle.com'>x</a>", "LOOKALIKE_DOMAIN", ["levenshtein", "source=url", "host=gooogle.com", "label=gooogle", "brand=google"]),
    ("nothing", "LOOKALIKE_DOMAIN", ["reply_to_distance", "distance=1", "from=evil.net", "reply_to=evi1.net"]),
    ("<a href='https://evil.net'>Go to paypal.com</a><a href='https://b.org'>c.org</a>", "HTML_LINK_MISMATCH", ["display=paypal.com", "href=evil.net", "display=c.org", "href=b.org"]),
    ("<a href='https://a.com/redirect?url=https://b.org/x'>x</a>", "OPEN_REDIRECT", ["parameter=url", "outer=a.com", "target=b.org", "evidence=cross_domain_redirect"]),
    ("x", "FROM_DISPLAY_IMPERSONATION", ["brand=paypal", "from_domain=evil.net"]),
]
HOMOGRAPHS = ["xn--80ak6aa92e.com", "аррӏе.com", "www.mіcrosoft.com"]
FAIR_HOSTS = ["bücher.de", "xn--bcher-kva.de", "navigator.de", "москва.ru"]
PART = "--b\nContent-Type: {1}\nContent-Disposition: attachment; filename={0}\n\nx\n"
PARTS = [("a.scr", "application/octet-stream"), ("b.bat", "text/plain"), ("c.pdf", "text/plain"), ("d.pdf", "application/pdf")]


def test_findings_report_their_evidence(spark):
    """One run over all mails: evidence, homographs of protected brands, multipliers of attachments, and assembled text."""
    mails = {str(k): MAIL + body for k, (body, _, _) in enumerate(EVIDENCE)}
    mails |= {h: f"From: a@b.c\nContent-Type: text/html; charset=utf-8\n\n<a href='https://{h}/'>x</a>" for h in HOMOGRAPHS + FAIR_HOSTS}
    mails["files"] = "From: a@b.c\nDate: x\nContent-Type: multipart/mixed; boundary=b\n\n" + "".join(PART.format(*p) for p in PARTS) + "--b--\n"
    mails["text"] = "From: The CEO <boss@out.net>\nTo: me@in.net\nSubject: hi\n\nplease call\n me at +1 555 123 45 67, as soon\nas possible"
    names = [*{s for _, s, _ in EVIDENCE}, "IDN_HOMOGRAPH", "MIME_BAD_EXTENSION", "MIME_BAD_ATTACHMENT", "TEXT_SOCIAL_ENGINEERING"]
    rows = detect.detect(spark.createDataFrame([parse_message(k, m.encode()) for k, m in mails.items()], MESSAGE), names).collect()
    got = {(r.message_id, r.symbol): (r.multiplier, r.options) for r in rows}
    assert {(k, s): got.get((str(k), s), (0, None))[1] for k, (_, s, _) in enumerate(EVIDENCE)} == {(k, s): o for k, (_, s, o) in enumerate(EVIDENCE)}
    assert {m for m, s in got if s == "IDN_HOMOGRAPH"} == set(HOMOGRAPHS)
    assert got["files", "MIME_BAD_EXTENSION"] == (6.0, ["a.scr", "b.bat"]) and got["files", "MIME_BAD_ATTACHMENT"] == (1.0, ["text/plain:c.pdf"])
    assert {m for m, s in got if s == "TEXT_SOCIAL_ENGINEERING"} == {"text"}
