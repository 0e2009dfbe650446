"""Terms, brands, suffixes and networks as tables, against brute force."""

import ipaddress
import random

from pyspark.sql import functions as F

from threatloom.functions import domains as D
from threatloom.functions import refdata as R
from threatloom.functions import text as T
from threatloom.operators import bayes, detect, patterns, ranges, similar, suffixes

# --- terms

TERMS = [("a", "gift card", "plural"), ("a", "Gift Card", "plural"), ("b", "aa", "any"), ("b", "aa", "strict"), ("c", "v1agra", "word"), ("c", "", "any"), ("c", None, "any"), ("d", "é", None), ("e", "card", "strict")]
TEXTS = [
    "Gift cards and gift card's, 1gift card, xgift card gift cardss gift cardsx", "aaaa aa a aa", "v1agra _v1agra v1agra_ V1AGRA!", "É é éé caféé, é", None, "", "card gift card", "gift card",
    *("".join(random.Random(k).choice(["aa", "gift", " card", "s", " ", "_", "v1agra", "é", "1"]) for _ in range(40)) for k in range(60)),
]


def hits_by_hand():
    fold = lambda s: s.translate({k: k + 32 for k in range(65, 91)})
    out = set()
    for i, t in enumerate(map(fold, (x or "" for x in TEXTS))):
        for name, term, boundary in TERMS:
            term = fold(term or "")
            for at in range(len(t)) if term else ():
                if t.startswith(term, at) and patterns.fits(boundary or "strict", t, at, at + len(term)):
                    out.add((i, name, term, at))
    return out


def test_term_hits_equal_every_position(spark, monkeypatch):
    rows, terms = spark.createDataFrame(list(enumerate(TEXTS)), "id int, body string"), spark.createDataFrame(TERMS, patterns.TERMS)
    hits = [tuple(r) for r in patterns.term_hits(rows, "id", "body", terms).collect()]
    assert set(hits) == hits_by_hand() and len(set(hits)) > 100
    monkeypatch.setattr(patterns, "PART_BYTES", 30)  # several automata
    assert {tuple(r) for r in patterns.term_hits(rows, "id", "body", terms).collect()} == hits_by_hand()
    assert patterns.term_hits(rows, "id", "body", terms.limit(0)).collect() == []


def test_boundaries_equal_the_detectors_patterns(spark):
    """The automaton over the fixed table finds what the detectors' regular expressions find."""
    texts = [*TEXTS, "please BUY gift cards", "urgents today", "a vp, the ceos", "call me; phones", "v!agra c1alis c@sh c@shx pen1s_", "8today today8"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    found = patterns.term_hits(rows, "id", "body", patterns.fixed_terms(spark)).groupBy("id").agg(F.collect_set("list_name").alias("lists"))
    lists = {r.id: set(r.lists) for r in found.collect()}
    low = T.ascii_lower(F.col("body"))
    asked = {"gift": T.has_terms(low, R.GIFT), "urgency": T.has_terms(low, R.URGENCY), "authority": T.has_strict_terms(low, R.AUTHORITY), "social_action": T.has_strict_terms(low, R.SOCIAL_ACTION), "obfuscated": F.col("body").rlike(detect.OBFUSCATED)}
    for r in rows.select("id", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in asked.items())).collect():
        assert {n for n in asked if r[n]} == lists.get(r.id, set()) & set(asked), texts[r.id]


def test_thousands_of_terms_and_their_symbols(spark):
    terms = spark.range(5000).select(F.lit("mine").alias("list_name"), F.concat(F.lit("term"), F.col("id").cast("string")).alias("term"), F.lit("strict").alias("boundary"))
    rows = spark.createDataFrame([("m", "a term17 and term4999, no term5000; term17")], "message_id string, body string")
    got = patterns.list_symbols(patterns.term_hits(rows, "message_id", "body", terms), spark.createDataFrame([("mine", "MY_TERMS")], "list_name string, symbol string")).collect()
    assert [tuple(r) for r in got] == [("m", "MY_TERMS", 1.0, ["term17", "term4999"])]


# --- brands


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_names_equal_all_pairs(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    names, brands = [word(rng.randrange(0, 9)) for _ in range(300)] + [None, "", "q"], [word(rng.randrange(1, 7)) for _ in range(80)] + [None, ""]
    got = similar.near(spark.createDataFrame([(n,) for n in names], "n string"), "n", spark.createDataFrame([(b,) for b in brands], "brand string")).collect()
    known = {b for b in brands if b}
    want = {(n, b, distance(n, b)) for n in set(names) if n and n not in known for b in known if 1 <= distance(n, b) <= 2}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 500
    assert similar.near(spark.createDataFrame([("a",)], "n string"), "n", spark.createDataFrame([], "brand string")).collect() == []


def test_spellings_equal_the_patterns(spark):
    rng = random.Random(5)
    swaps = {"m": "rn", "w": "vv", "o": "0", "l": "1", "i": "1", "e": "3", "s": "$", "a": "@", "b": "8", "t": "7"}
    names = ["".join(swaps.get(c, c) if rng.random() < 0.4 else c for c in rng.choice(R.BRANDS)) for _ in range(300)] + ["paypai", "app1e", "appie", "rnicrosoft", "zoorn"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    import re

    want = {(n, b) for n in names for b in R.BRANDS if n != b and re.match(D.brand_pattern(b), n)}
    assert {tuple(r) for r in similar.spelt_like(df, "n", similar.fixed_brands(spark)).collect()} == want and len(want) > 50


def test_the_plan_does_not_grow_with_the_brands(spark):
    size = lambda n: len(similar.near(spark.createDataFrame([("abc",)], "n string"), "n", spark.range(n).select(F.concat(F.lit("brand"), F.col("id").cast("string")).alias("brand")))._jdf.queryExecution().analyzed().toString())
    assert size(10_000) <= size(10) + 100


# --- suffixes

RULES = ["com", "uk", "co.uk", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "COM"]
HOSTS = {
    "www.example.com": ("com", "example.com"), "com": ("com", None), "a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", None), "x.ck": ("x.ck", None), "a.x.ck": ("x.ck", "a.x.ck"), "www.ck": ("ck", "www.ck"),
    "a.www.ck": ("ck", "www.ck"), "ck": ("ck", None), "city.kawasaki.jp": ("kawasaki.jp", "city.kawasaki.jp"), "a.b.kawasaki.jp": ("b.kawasaki.jp", "a.b.kawasaki.jp"), "kawasaki.jp": ("jp", "kawasaki.jp"),
    "a.unknown": ("unknown", "a.unknown"), "A.B.Co.UK.": ("co.uk", "b.co.uk"),
}


def test_suffix_rules(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("// a comment\n\n" + "\n".join(r + " // tail" for r in RULES) + "\n")
    rules = suffixes.read_rules(spark, str(tmp_path / "rules.txt"))
    assert {r.rule for r in rules.collect()} == {r.lower() for r in RULES}
    hosts = spark.createDataFrame([(h,) for h in [*HOSTS, "a.b.co.uk", None, "", "."]], "h string")
    got = suffixes.registered(hosts, "h", rules).collect()
    assert {r.host: (r.suffix, r.domain) for r in got} == HOSTS and len(got) == len(HOSTS)


def test_the_default_suffixes_agree_with_the_detectors(spark):
    hosts = spark.createDataFrame([(h,) for h in ["a.b.co.uk", "b.com", "x.y.z.com.au", "q.w.org", "shop.co.jp"]], "host string")
    got = {r.host: (r.suffix, r.domain) for r in suffixes.registered(hosts, "host", suffixes.fixed_rules(spark)).collect()}
    assert got == {r.host: (r.s, r.d) for r in hosts.select("host", D.public_suffix(F.col("host")).alias("s"), D.registered_domain(F.col("host")).alias("d")).collect()}


# --- networks


def plain(address):
    try:
        a = ipaddress.ip_address(address.strip().strip("[]").partition("%")[0])
    except ValueError:
        return None
    return a.ipv4_mapped or a if a.version == 6 else a


ADDRESSES = ["10.1.2.3", "10.1.2.255", "::1", "2001:db8::1", "2001:DB8:0:0:1::", "::ffff:10.1.2.3", "fe80::1%eth0", "[2001:db8::5]", "256.1.1.1", "1.2.3", "01.2.3.4", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", ":::", "::", "12345::", "::1.2.3.4", "g::", "", "1:2:3:4:5:6:7::", "x", "0.0.0.0"]


def test_addresses_as_bits(spark):
    got = {r.a: r.b for r in spark.createDataFrame([(a,) for a in ADDRESSES], "a string").select("a", ranges.address_bits(F.col("a")).alias("b")).collect()}
    assert got == {a: (None if (p := plain(a)) is None else f"{int(p):0{p.max_prefixlen}b}") for a in ADDRESSES}


def test_longest_networks_equal_the_library(spark):
    rng = random.Random(8)
    four = lambda: f"10.{rng.randrange(3)}.{rng.randrange(4)}.{rng.randrange(256)}"
    six = lambda: f"2001:db8:{rng.randrange(3):x}::{rng.randrange(300):x}"
    nets = [(f"{four()}/{rng.choice([0, 8, 16, 22, 23, 24, 31, 32])}", f"z{rng.randrange(5)}") for _ in range(60)] + [(f"{six()}/{rng.choice([0, 32, 47, 48, 120, 128])}", f"z{rng.randrange(5)}") for _ in range(60)]
    nets += [(four(), "bare"), ("::ffff:10.1.0.0/112", "mapped"), ("10.0.0.0/33", "bad"), ("x/8", "bad"), (None, "bad"), ("10.0.0.0/", "bad")]
    addresses = [four() for _ in range(200)] + [six() for _ in range(200)] + ["bad", None, "::ffff:10.1.2.3"]
    table = []
    for n, z in nets:
        if z != "bad":
            table.append((ipaddress.ip_network("10.1.0.0/16") if z == "mapped" else ipaddress.ip_network(n, strict=False), z))
    want = {}
    for a in addresses:
        p = plain(a) if a else None
        inside = [(n.prefixlen, z) for n, z in table if p is not None and n.version == p.version and p in n]
        if inside:
            most = max(k for k, _ in inside)
            want[a] = (most, sorted({z for k, z in inside if k == most}))
    got = ranges.longest_networks(spark.createDataFrame([(a,) for a in addresses], "a string"), "a", spark.createDataFrame(nets, "network string, zone string"))
    assert {r.address: (r.length, r.zones) for r in got.collect()} == want


def test_an_allowed_network_inside_a_listed_one(spark):
    nets = spark.createDataFrame([("10.0.0.0/8", "rbl"), ("10.1.0.0/16", "allow")], "network string, zone string")
    mails = spark.createDataFrame([("a", "10.2.0.1"), ("b", "10.1.0.1"), ("c", "11.0.0.1"), ("a", "10.3.0.1")], "message_id string, address string")
    assert [tuple(r) for r in ranges.listed_addresses(mails, nets, "RBL").collect()] == [("a", "RBL", 1.0, ["rbl"])]


def test_bigrams_of_a_long_text_take_linear_time(spark):
    import time

    text = " ".join(f"w{k % 977}" for k in range(20_000))
    df = spark.createDataFrame([(text, True)], "text string, is_spam boolean")
    began = time.time()
    assert bayes.learn(df, bayes.sparse_bigrams(bayes.words(F.col("text")))).count() == 977 * 4
    assert time.time() - began < 5
