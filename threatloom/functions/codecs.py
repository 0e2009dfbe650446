"""Decoders: percent, base64, quoted-printable, entities and punycode. Python only where no built-in exists."""

from __future__ import annotations

import html
import quopri
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def percent_decode(c: Column, plus: bool) -> Column:
    """Bytes of %XX as UTF-8; a stray % stays. plus: '+' is a blank."""
    c = F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(c if plus else F.regexp_replace(c, r"\+", "%2B"))


def fully_decode(c: Column) -> Column:
    """Up to two rounds of percent decoding, then trimmed."""
    once = F.coalesce(percent_decode(c, True), c)
    twice = F.coalesce(percent_decode(once, True), once)
    return F.trim(F.when(once == c, c).otherwise(twice))


def base64_text(c: Column) -> Column:
    """Decoded text, null where the input isn't base64."""
    padded = F.rpad(c, F.ceil(F.length(c) / 4).cast("int") * 4, "=")
    return F.try_to_binary(padded, F.lit("base64")).cast("string")


def decode_quoted_printable(raw: str | bytes | None) -> str | None:
    if raw is None:
        return None
    return quopri.decodestring(raw.encode() if isinstance(raw, str) else raw).decode("utf-8", "replace")


def decode_entities(text: str | None) -> str | None:
    """The five XML names and numeric references; anything else stays."""
    if text is None:
        return None
    return re.sub(r"&(#[0-9]+|#[xX][0-9A-Fa-f]+|amp|lt|gt|quot|apos);", lambda m: html.unescape(m[0]), text)


def decode_punycode(label: str) -> str | None:
    """RFC 3492 for one label without its prefix; None for an invalid digit, a cut-off number, an overflow or over 59 bytes."""
    if len(label.encode()) > 59 or not label.isascii():
        return None
    head, sep, tail = label.rpartition("-")
    out, digits = (list(head), tail) if sep else ([], label)
    code, place, bias, at, first = 128, 0, 72, 0, True
    while at < len(digits):
        start, weight, k = place, 1, 36
        while True:
            if at == len(digits):
                return None
            c = digits[at]
            at += 1
            d = ord(c) - 97 if "a" <= c <= "z" else ord(c) - 65 if "A" <= c <= "Z" else ord(c) - 22 if "0" <= c <= "9" else None
            if d is None:
                return None
            place += d * weight
            if place > 0x7FFFFFFF:
                return None
            limit = min(26, max(1, k - bias))
            if d < limit:
                break
            weight *= 36 - limit
            k += 36
        size = len(out) + 1
        delta = (place - start) // (700 if first else 2)
        delta += delta // size
        bias, first = 0, False
        while delta > 455:
            delta //= 35
            bias += 36
        bias += 36 * delta // (delta + 38)
        code += place // size
        place %= size
        if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
            return None
        out.insert(place, chr(code))
        place += 1
    return "".join(out)


def decode_host(host: str | None) -> str | None:
    """A host with its xn-- labels decoded; None where there is none or one doesn't decode."""
    labels = (host or "").lower().split(".")
    if not any(x.startswith("xn--") for x in labels):
        return None
    out = [decode_punycode(x[4:]) if x.startswith("xn--") else x for x in labels]
    return None if None in out else ".".join(out)


@F.pandas_udf(StringType())
def decode_host_udf(hosts: pd.Series) -> pd.Series:
    return hosts.map(decode_host)


@F.pandas_udf(StringType())
def quoted_printable_udf(raw: pd.Series) -> pd.Series:
    return raw.map(decode_quoted_printable)


@F.pandas_udf(StringType())
def entities_udf(text: pd.Series) -> pd.Series:
    return text.map(decode_entities)


@F.pandas_udf(ArrayType(StringType()))
def decode_hosts_udf(hosts: pd.Series) -> pd.Series:
    """decode_host of every host of an array, so that only messages with xn-- hosts cost anything."""
    return hosts.map(lambda hs: [] if hs is None else [decode_host(h) for h in hs])
