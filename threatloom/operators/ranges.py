"""Addresses in networks: a longest-prefix join on equal keys for IPv4 and IPv6.

An address is written out in bits, and for every prefix length that a network has (162 at most) its first bits are a key.
Zones, allow lists and reputation lists of any size are tables of networks; distinct addresses are looked up.

Edge cases: malformed addresses and networks are null and match nothing; bits behind a network's length are ignored; an
address without a length is a network of its own; IPv4 written as IPv6 (::ffff:a.b.c.d) is IPv4; zone indexes (%eth0) are
dropped; several zones of one network are all reported, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.functions.text import once
from threatloom.operators.maps import small_or_dealt

_MAPPED = "0" * 80 + "1" * 16


def _bits4(address: Column) -> Column:
    octets = F.split(address, r"\.")
    ok = address.rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$") & F.forall(octets, lambda o: F.lpad(o, 3, "0") <= "255")
    return F.when(ok, F.array_join(F.transform(octets, lambda o: F.lpad(F.conv(o, 10, 2), 8, "0")), ""))


def _groups(side: Column) -> Column:
    return F.when(F.coalesce(side, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(side, ":", -1))


def _bits6(address: Column) -> Column:
    def undotted(four: Column) -> Column:
        """The address with a dotted end written as two groups."""
        group = lambda at: F.lower(F.conv(F.substr(four, F.lit(at), F.lit(16)), 2, 16))
        return F.when(four.isNull(), address).otherwise(F.concat(F.regexp_replace(address, r"[0-9]+(?:\.[0-9]+){3}$", ""), group(1), F.lit(":"), group(17)))

    def spread(s: Column) -> Column:
        """The bits of the groups left and right of ::, or of all groups on the left where there is no ::."""
        missing = F.lit(8) - F.size(s["left"]) - F.size(s["right"])
        fits = F.when(s["parts"] == 2, missing >= 1).otherwise((s["parts"] == 1) & (missing == 0))
        every = F.concat(s["left"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), s["right"])
        written = lambda e: F.when(F.forall(e, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(e, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), ""))
        return F.when(fits, once(every, written))

    sided = lambda sides: once(F.struct(F.size(sides).alias("parts"), _groups(F.get(sides, F.lit(0))).alias("left"), _groups(F.get(sides, F.lit(1))).alias("right")), spread)
    four = _bits4(F.regexp_extract(address, r"([0-9]+(?:\.[0-9]+){3})$", 1))
    return once(four, lambda f: once(undotted(f), lambda whole: once(F.split(whole, "::", -1), sided)))


def address_bits(address: Column) -> Column:
    """The 32 or 128 bits of an address as text; null if it is none."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(F.trim(address), r"^\[|\]$", ""), "%.*$", ""))
    unmapped = lambda six: F.when(six.startswith(_MAPPED), F.substr(six, F.lit(97))).otherwise(six)
    return once(plain, lambda a: F.when(a.contains(":"), once(_bits6(a), unmapped)).otherwise(_bits4(a)))


def network_key(network: Column) -> Column:
    """struct(family, length, prefix) of `address/length`; null if it is none."""

    def of(text: Column, address: Column, bits: Column) -> Column:
        size = F.regexp_extract(text, r"/([0-9]{1,3})$", 1)
        # a mapped IPv4 network is written with an IPv6 length
        shift = F.when(address.contains(":") & (F.length(bits) == 32), 96).otherwise(0)
        length = F.when(~text.contains("/"), F.length(bits)).when(size != "", size.cast("int") - shift)
        key = lambda n: F.when(bits.isNotNull() & n.between(0, F.length(bits)), F.struct(F.length(bits).alias("family"), n.alias("length"), F.substr(bits, F.lit(1), n).alias("prefix")))
        return once(length, key)

    return once(F.trim(network), lambda text: once(F.regexp_extract(text, r"^([^/]+)", 1), lambda address: once(address_bits(address), lambda bits: of(text, address, bits))))


def longest_networks(addresses: DataFrame, address: str, networks: DataFrame) -> DataFrame:
    """(address, length, zones): for each distinct address in any network (network, zone), the longest prefix and its zones."""
    keyed = networks.select("zone", network_key(F.col("network")).alias("_k")).where("_k is not null")
    table = keyed.groupBy("_k.family", "_k.length", "_k.prefix").agg(F.array_sort(F.collect_set("zone")).alias("zones"))
    sizes = keyed.select("_k.family", "_k.length").distinct().groupBy("family").agg(F.collect_set("length").alias("_lengths"))  # two rows of 129 at most
    here = addresses.select(F.col(address).alias("address")).distinct().withColumn("_bits", address_bits(F.col("address"))).where("_bits is not null")
    here = here.withColumn("family", F.length("_bits")).join(F.broadcast(sizes), "family")
    probes = here.select("address", "family", F.explode("_lengths").alias("length"), "_bits").withColumn("prefix", F.substr("_bits", F.lit(1), F.col("length"))).drop("_bits")
    found = probes.join(small_or_dealt(table), ["family", "length", "prefix"])
    return found.groupBy("address").agg(F.max("length").alias("length"), F.max_by("zones", "length").alias("zones"))


def listed_addresses(senders: DataFrame, networks: DataFrame, symbol: str) -> DataFrame:
    """(message_id, symbol, multiplier, options) of messages (message_id, address) that come from a listed network; a zone
    `allow` speaks for an address and takes its hit away."""
    known = longest_networks(senders, "address", networks).where(~F.array_contains("zones", "allow"))
    hit = senders.select("message_id", "address").distinct().join(known, "address").select("message_id", F.explode("zones").alias("zone"))
    return hit.groupBy("message_id").agg(F.lit(symbol).alias("symbol"), F.lit(1.0).alias("multiplier"), F.array_sort(F.collect_set("zone")).alias("options"))
