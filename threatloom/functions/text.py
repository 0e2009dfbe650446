"""Text predicates as Column expressions: term lists with boundaries, assembly and cleaning."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use) -> Column:
    """use(value) with value evaluated once a row: a lambda's variable is bound, while an expression that a lambda holds is
    evaluated again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else: detectors see bytes, not Unicode case."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def any_term(terms: list[str]) -> str:
    return "(" + "|".join(re.escape(t).replace("\\ ", " ").replace("\\-", "-").replace("'", "'") for t in terms) + ")"


def plural_pattern(terms: list[str]) -> str:
    """A term, or its plural, not inside a longer word; digits may stand before it. No look-around: SQL engines agree."""
    return f"(^|[^A-Za-z]){any_term(terms)}s?($|[^A-Za-z0-9])"


def strict_pattern(terms: list[str]) -> str:
    return f"(^|[^A-Za-z0-9]){any_term(terms)}($|[^A-Za-z0-9])"


def has_terms(text: Column, terms: list[str]) -> Column:
    return text.rlike(plural_pattern(terms))


def has_strict_terms(text: Column, terms: list[str]) -> Column:
    return text.rlike(strict_pattern(terms))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\t-\r ]+", " "))


PHONE = r"[+(]?[0-9][0-9\t-\r ().-]+[0-9]"


def phone_candidates(text: Column) -> Column:
    """Digit runs with separators that hold 10 to 15 digits."""
    found = F.regexp_extract_all(text, F.lit(PHONE), F.lit(0))
    return F.filter(found, lambda c: F.length(F.regexp_replace(c, "[^0-9]", "")).between(10, 15))


def message_text(subject: Column, bodies: Column) -> Column:
    """Subject and text parts, one per line, in ASCII lower case."""
    return ascii_lower(F.concat_ws("\n", subject, bodies))


def basic_entities(c: Column) -> Column:
    """The eight entity spellings that links are written with."""
    for pattern, to in ((r"(?i)&nbsp;", " "), (r"(?i)&lt;", "<"), (r"(?i)&gt;", ">"), (r"(?i)&quot;", '"'), (r"&#39;|&#[xX]27;|(?i)&apos;", "'"), (r"(?i)&amp;", "&")):
        c = F.regexp_replace(c, pattern, to)
    return c


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]*>", " ")


def html_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def clean_ocr_text(c: Column, limit: int = 8192) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"\x00", " "), r"\r\n?", "\n")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(c, r"[\t ]+", " "), r" ?\n[\n ]*", "\n")), 1, limit)


def action_name(c: Column) -> Column:
    """'add header', 'Add-Header' and the like as add_header."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def percent_text(share: Column) -> Column:
    """A share in percent with two decimals, as reports print it."""
    return F.format_string("%.2f%%", share.cast("double") * 100)


def millis_text(ms: Column) -> Column:
    return F.format_string("%.1fms", ms.cast("double"))
