"""Hosts, registered domains, brands and look-alikes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatloom.functions import refdata as R
from threatloom.functions.text import ascii_lower


def _text(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def values(items) -> Column:
    """A constant array of strings: one expression, however many there are."""
    return F.expr(f"array({', '.join(_text(v) for v in items)})")


def among(c: Column, items) -> Column:
    return F.array_contains(values(items), c)


def url_host(url: Column) -> Column:
    """Between the scheme (and user) and the port or path; empty where there is none. parse_url would reject many."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)


def url_scheme(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def normalize_host(host: Column) -> Column:
    """Lower case, no blanks around, no port, no dots at either end."""
    h = F.regexp_replace(F.trim(ascii_lower(host)), r":[0-9]+$", "")
    return F.regexp_replace(F.regexp_replace(h, r"^\.+", ""), r"\.+$", "")


def host_labels(host: Column) -> Column:
    return F.filter(F.split(host, r"\."), lambda x: x != "")


def _tail(labels: Column, n: int) -> Column:
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), F.lit(n)), ".")


def registered_domain(host: Column) -> Column:
    """The name a registrar sells: two labels, or three under a two-label public suffix."""
    labels = host_labels(host)
    return F.when((F.size(labels) >= 3) & among(_tail(labels, 2), R.SUFFIXES), _tail(labels, 3)).otherwise(_tail(labels, 2))


def public_suffix(host: Column) -> Column:
    labels = host_labels(host)
    return F.when(among(_tail(labels, 2), R.SUFFIXES), _tail(labels, 2)).otherwise(_tail(labels, 1))


def under_domain(domain: Column, parent: Column) -> Column:
    return (domain == parent) | domain.endswith(F.concat(F.lit("."), parent))


def components(label: Column) -> Column:
    """A label and, where it is hyphenated, its parts."""
    return F.when(label.rlike("[-_]"), F.concat(F.array(label), F.filter(F.split(label, "[-_]"), lambda x: x != ""))).otherwise(F.array(label))


def brand_home(brand: Column) -> Column:
    """A brand's own domains; null for general terms."""
    pairs = ", ".join(f"{_text(b)}, array({', '.join(_text(d) for d in ds)})" for b, ds in R.BRAND_DOMAINS.items())
    return F.element_at(F.expr(f"map({pairs})"), brand)


def brand_label(host: Column) -> Column:
    """The first label, or part of one, that is a brand with domains of its own."""
    parts = F.flatten(F.transform(host_labels(host), components))
    return F.get(F.filter(parts, lambda x: among(x, R.BRAND_DOMAINS)), F.lit(0))


def path_brand(path: Column, domain: Column) -> Column:
    """In brand order, the first brand that is a whole word of the path and doesn't own the domain."""
    named = F.array_intersect(values(R.BRAND_DOMAINS), F.split(F.lower(path), "[^a-z0-9]+"))
    return F.get(F.filter(named, lambda b: ~F.array_contains(brand_home(b), domain)), F.lit(0))


def brand_pattern(brand: str) -> str:
    return "^" + "".join(R.LOOKS_LIKE.get(c, c) for c in brand) + "$"


def name_labels(host: Column, domain: Column) -> Column:
    """Subdomain labels and the registered name, without the public suffix."""
    labels = host_labels(host)
    return F.slice(labels, 1, F.greatest(F.size(labels) - F.size(host_labels(domain)) + 1, F.lit(1)))


def first_match(parts: Column, test) -> Column:
    """struct(label, brand) of the first part, then the first brand in order, that the test accepts. The brands are one
    constant array, so the expression doesn't grow with them."""
    of = lambda part: F.struct(part.alias("label"), F.get(F.filter(values(R.BRANDS), lambda b: test(part, b)), F.lit(0)).alias("brand"))
    return F.get(F.filter(F.transform(parts, of), lambda s: s["brand"].isNotNull()), F.lit(0))


#: Any brand's look-alike spellings: one pattern sorts out nearly every label before brands are told apart.
ANY_BRAND = "^(?:" + "|".join(brand_pattern(b)[1:-1] for b in R.BRANDS) + ")$"


def spelling_of(brand: Column) -> Column:
    """brand_pattern of a column of brands."""
    pairs = ", ".join(f"{_text(b)}, {_text(brand_pattern(b))}" for b in R.BRANDS)
    return F.element_at(F.expr(f"map({pairs})"), brand)


def confusable(host: Column, domain: Column) -> Column:
    """A label that spells a brand with look-alike characters, but isn't the brand."""
    parts = F.filter(F.flatten(F.transform(name_labels(host, domain), components)), lambda p: p.rlike(ANY_BRAND))
    return first_match(parts, lambda p, b: F.rlike(p, spelling_of(b)) & (p != b))


def near_brand(domain: Column) -> Column:
    """A part of the registered name within one or two edits of a brand, unless it is a brand itself."""
    parts = F.filter(components(F.get(host_labels(domain), F.lit(0))), lambda p: ~among(p, R.BRANDS))
    return first_match(parts, lambda p, b: F.levenshtein(p, b, 2).between(1, 2))


def skeleton(label: Column) -> Column:
    return F.translate(F.lower(label), R.CONFUSABLE_FROM, R.CONFUSABLE_TO)
