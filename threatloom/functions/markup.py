"""HTML as tokens: a state machine over a page's tags, attributes, comments and raw text, in document order.

States follow the HTML standard where detectors depend on them: quoted values may hold `>` and blanks, a value without quotes
ends at a blank or `>`, the first of two equal attributes counts, comments, declarations and processing instructions are no
text, script and style hold raw text up to their own end tag (title and textarea too), a tag that the page cuts off is
dropped, and a link ends at its end tag, at the next link, or at the end of the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.runtime import ship

TOKEN = "n int, kind string, tag string, attrs map<string,string>, text string, link int"
FOUND = "anchors array<struct<href string, text string>>, attrs array<struct<tag string, attr string, value string>>, images array<struct<src string, linked boolean>>"
RAW = ("script", "style", "title", "textarea", "xmp")
#: Attributes of the markup column beside links' and images' own: those that may navigate.
_NAME, _ATTR = re.compile(r"[A-Za-z][^\s/>]*"), re.compile(r"[^\s/>][^\s/>=]*")
_SKIP, _BLANK, _BARE = re.compile(r"[\s/]*"), re.compile(r"\s*"), re.compile(r"[^\s>]*")


class Token(NamedTuple):
    """kind: 'start', 'end' or 'text'; link: number of the start tag of the link that the token is inside of."""

    n: int
    kind: str
    tag: str | None
    attrs: dict[str, str] | None
    text: str | None
    link: int | None


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from behind a tag's name on, and where the tag ends; -1 if the page ends first."""
    found: dict[str, str] = {}
    while True:
        at = _SKIP.match(page, at).end()
        if at >= len(page):
            return found, -1
        if page[at] == ">":
            return found, at + 1
        name = _ATTR.match(page, at)
        value, at = "", name.end()
        after = _BLANK.match(page, at).end()
        if page[after : after + 1] == "=":
            at = _BLANK.match(page, after + 1).end()
            quote = page[at : at + 1]
            if quote in ("'", '"') and quote:
                end = page.find(quote, at + 1)
                if end < 0:
                    return found, -1
                value, at = page[at + 1 : end], end + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        found.setdefault(name[0].lower(), value)


def tokens(page: str | None) -> Iterator[Token]:
    """Tokens of a page; adjoining text comes as one token."""
    page, at, n, link, text = page or "", 0, 0, None, []

    def flush() -> Iterator[Token]:
        nonlocal n
        held = "".join(text)
        text.clear()
        if held:
            yield Token(n, "text", None, None, held, link)
            n += 1

    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            text.append(page[at:])
            break
        text.append(page[at:lt])
        at, following = lt, page[lt + 1 : lt + 2]
        if page.startswith("<!--", at):
            if page.startswith((">", "->"), at + 4):  # a comment that ends at once
                at = page.find(">", at + 4) + 1
                continue
            end = min((e + len(s) for s in ("-->", "--!>") if (e := page.find(s, at + 4)) >= 0), default=len(page))
            at = end
        elif following in ("!", "?") or (following == "/" and not _NAME.match(page, at + 2)):
            end = page.find(">", at + 2)
            at = len(page) if end < 0 else end + 1
        elif name := _NAME.match(page, at + 1 + (following == "/")):
            tag = name[0].lower()
            attrs, end = _attributes(page, name.end())
            if end < 0:
                break
            yield from flush()
            if following == "/":
                yield Token(n, "end", tag, None, None, link)
                link = None if tag == "a" else link
            else:
                link = n if tag == "a" else link
                yield Token(n, "start", tag, attrs, None, link)
            n, at = n + 1, end
            if tag in RAW and following != "/":
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                text.append(page[at : close.start() if close else len(page)])
                yield from flush()
                at = close.start() if close else len(page)
        else:
            text.append("<")
            at += 1
    yield from flush()


def html_tokens(pages: DataFrame, key: str, page: str) -> DataFrame:
    """(key, n, kind, tag, attrs, text, link): the token table of a column of pages; a null page has no tokens."""
    ship(pages.sparkSession)
    of_key = pages.schema[key].dataType.simpleString()
    kinds = [("n", pa.int32()), ("kind", pa.string()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("link", pa.int32())]

    def rows(batches):
        for batch in batches:
            places, columns = [], [[] for _ in kinds]
            for i, html in enumerate(batch.column(1).to_pylist()):
                for t in tokens(html):
                    places.append(i)
                    for c, v in zip(columns, (t.n, t.kind, t.tag, None if t.attrs is None else list(t.attrs.items()), t.text, t.link), strict=True):
                        c.append(v)
            arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), *arrays], names=[key, *(n for n, _ in kinds)])

    return pages.select(key, page).mapInArrow(rows, f"{key} {of_key}, {TOKEN}")


def summary(parts: list[str], navigating: dict[str, list[str]]) -> dict:
    """What detectors read of a message's HTML parts: links with their text, navigating attributes, and images."""
    out: dict[str, list] = {"anchors": [], "attrs": [], "images": []}
    for part in parts:
        links: dict[int, dict] = {}
        for t in tokens(part):
            if t.kind == "start":
                if t.tag == "a" and "href" in t.attrs:
                    links[t.n] = {"href": t.attrs["href"], "text": ""}
                    out["anchors"].append(links[t.n])
                elif t.tag == "img":
                    out["images"].append({"src": t.attrs.get("src"), "linked": t.link is not None})
                out["attrs"] += [{"tag": t.tag, "attr": a, "value": t.attrs[a]} for a in navigating.get(t.tag, []) if a in t.attrs]
            if t.link in links:
                # a tag inside a link parts words, as it does on the screen
                links[t.link]["text"] += t.text if t.kind == "text" else "" if t.tag == "a" else " "
    return out


def markup(parts: Column, navigating: dict[str, list[str]]) -> Column:
    """struct(anchors, attrs, images) of ARRAY<STRING> of HTML parts: each part is read once for all detectors."""


    texts = lambda *names: pa.list_(pa.struct([(n, pa.string()) for n in names]))
    kind = pa.struct([("anchors", texts("href", "text")), ("attrs", texts("tag", "attr", "value")), ("images", pa.list_(pa.struct([("src", pa.string()), ("linked", pa.bool_())])))])

    @F.arrow_udf(FOUND)
    def read(pages: pa.Array) -> pa.Array:
        return pa.array([summary([p for p in ps or [] if p], navigating) for ps in pages.to_pylist()], kind)

    return read(parts)
