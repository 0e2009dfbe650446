import numpy as np
from pyspark.sql import functions as F

from threatloom.llm import media, urlfilter, warc
from threatloom.llm.asof import asof_join
from threatloom.llm.graph import components

CAPTURES = "capture_id long, url string, fetch_time long, record_type string, etag string, last_modified string, digest string, headers map<string,string>, canonical string, _prior string"


def test_revisits(spark):
    h = {"date": "d0", "content-type": "text/html", "server": "s0"}
    rows = [
        (1, "http://A.de:80/x?utm_source=f#t", 10, "response", '"e"', None, "z", h, "c", "p"), (2, "http://a.de/x", 20, "revisit", 'W/"e"', None, "z", {"date": "d1", "content-type": "none"}, "c", "p"),
        (3, "http://a.de/x", 30, "revisit", '"f"', None, None, None, "c", "p"), (4, "http://a.de/x", 10, "revisit", None, None, None, None, "c", "p"), (5, "http://a.de/x", 30, "response", None, "l", None, None, "c", "p"),
        (6, "http://a.de/x", 30, "response", None, "m", None, None, "c", "p"), (7, "http://a.de/x", 40, "revisit", None, "m", None, None, "c", "p"), (8, None, 40, "revisit", None, None, None, None, "c", "p"),
        (9, "http://a.de/x", None, "revisit", None, None, None, None, "c", "p"), (10, "https://b.de", 1, None, None, None, None, None, None, None), (2, "http://a.de/x", 20, "revisit", 'W/"e"', None, "z", {"date": "d1", "content-type": "none"}, "c", "p"),
    ]
    got = sorted((r.capture_id, r.resolution, r.refers_to, r.canonical_url) for r in warc.resolve_revisits(spark.createDataFrame(rows, CAPTURES).drop("_prior")).collect())
    x = "http://a.de/x"
    assert got == [(1, "response", None, x), (2, "resolved", 1, x), (2, "resolved", 1, x), (3, "validator_mismatch", None, x), (4, "no_prior", None, x), (5, "response", None, x), (6, "response", None, x), (7, "resolved", 6, x), (8, "no_prior", None, None), (9, "no_prior", None, x), (10, "response", None, "https://b.de/")]
    merged = warc.resolve_revisits(spark.createDataFrame(rows, CAPTURES).drop("_prior")).where("capture_id = 2").first().merged_headers
    assert merged == {"date": "d1", "content-type": "text/html", "server": "s0"}
    assert warc.resolve_revisits(spark.createDataFrame([], CAPTURES)).count() == 0
    clash = spark.createDataFrame(rows, CAPTURES).withColumns({"refers_to": F.lit("x"), "canonical_url": F.lit(1), "resolution": F.lit(2), "merged_headers": F.lit(3), "_bucket": F.lit(4), "_last": F.lit(5)})
    out = warc.resolve_revisits(clash.drop("_prior"))
    assert {(r.capture_id, r.resolution, r.refers_to, r._bucket, r._last) for r in out.collect()} == {(a, b, c, 4, 5) for a, b, c, _ in got}


def test_hot_key_asof(spark):
    rows = spark.range(0, 3000).select(F.lit("k").alias("k"), (F.col("id") * 7 % 1000).alias("t"), F.col("id").alias("o"))
    ev = rows.where("o % 3 = 0").select("k", "t", "o", F.struct(F.col("o").alias("v")).alias("p"))
    got = {(r.o, r.p and r.p["v"]) for r in asof_join(rows.where("o % 3 = 1"), ev, ["k"], "t", "o", "p", strict=True).collect()}
    data = [(i, i * 7 % 1000) for i in range(3000)]
    want = set()
    for o, t in data:
        if o % 3 == 1:
            best = max(((u, e) for e, u in data if e % 3 == 0 and u < t), default=None)
            want.add((o, best and best[1]))
    assert got == want


def test_dated_lists(spark):
    entries = spark.createDataFrame(
        [(1, "block", "evil.de", "add", 10), (2, "block", "evil.de", "add", 12), (3, "block", "evil.de", "remove", 20), (4, "block", "evil.de", "add", 30), (5, "allow", "ok.evil.de", "add", 0), (6, "block", "a.de/x", "add", 0),
         (7, "block", "a.de/x", "remove", 0), (8, None, "z.de", "add", 0), (9, "block", "gone.de", "remove", 5), (10, "allow", "tie.de", "add", 0), (11, "block", "tie.de", "add", 0)],
        "entry_id long, list_name string, pattern string, action string, changed long",
    )
    assert sorted((r.pattern, r.valid_from, r.valid_to) for r in urlfilter.validity(entries).where("pattern = 'evil.de'").collect()) == [("evil.de", 10, 20), ("evil.de", 30, None)]
    caps = [(1, "https://www.evil.de/a", 9), (2, "https://www.evil.de/a", 10), (3, "https://evil.de", 20), (4, "https://evil.de", 99), (5, "https://ok.evil.de", 15), (6, "http://a.de/x/y", 1), (7, None, 1), (8, "http://z.de", None), (9, "http://tie.de/q", 3), (9, "http://tie.de/q", 3), (10, "http://gone.de", 9)]
    df = spark.createDataFrame([(*c, "extra") for c in caps], "capture_id long, url string, fetch_time long, list_name string")
    got = {r.capture_id: r.verdict for r in urlfilter.judge(df, entries).collect()}
    assert got == {1: "none", 2: "block", 3: "none", 4: "block", 5: "allow", 6: "none", 7: "none", 8: "none", 9: "allow", 10: "none"}
    assert urlfilter.judge(df.limit(0), entries).count() == 0 and {r.verdict for r in urlfilter.judge(df, entries.limit(0)).collect()} == {"none"}


def test_deep_paths(spark):
    entries = spark.createDataFrame([(1, "block", "a.de/p", "add", 0), (2, "allow", "a.de/p/q/r/s", "add", 0), (3, "block", "a.de/p/q/r/s/t/u", "add", 0)], "entry_id long, list_name string, pattern string, action string, changed long")
    urls = ["http://a.de/p/q/r", "http://a.de/p/q/r/s", "http://a.de/p/q/r/s/t?x=/u", "http://a.de//p/q/r/s/t/u/v#w", "http://a.de"]
    df = spark.createDataFrame([(k, u, 1) for k, u in enumerate(urls)], "capture_id long, url string, fetch_time long")
    got = {r.capture_id: (r.verdict, r.n_active, r.entry_id) for r in urlfilter.judge(df, entries).collect()}
    assert got == {0: ("block", 1, 1), 1: ("allow", 2, 2), 2: ("allow", 2, 2), 3: ("block", 3, 3), 4: ("none", 0, None)}


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (3, 1), (5, 5), (7, 9), (9, 8), (20, 21), *((100, i) for i in range(101, 160))]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20, 100: 100, **{i: 100 for i in range(101, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_image_copies(spark):
    rows, want = [], []
    for k in range(12):
        for how in range(6):
            rows.append((k * 6 + how, media.encode_pgm(media.edit(media.draw(f"p{k}"), how, k * 5 + how)), "extra"))
            want.append(k * 6)
    rows += [(500, None, None), (501, None, None), (502, b"junk", None), (503, b"junk", None), (504, media.encode_pgm(np.full((96, 96), 7)), None), (505, media.encode_pgm(np.full((4, 4), 7)), None), (3, rows[3][1], "again"), (None, rows[0][1], "no id")]
    got = media.copies(spark.createDataFrame(rows, "media_id long, image binary, dg string")).collect()
    assert len(got) == len(rows)
    by = {r.media_id: r for r in got}
    # a null id is the smallest of its class
    assert [by[i].class_id for i in range(6)] == [None] * 6 and [by[i].class_id for i in range(6, 72)] == want[6:]
    assert [by[i].class_id for i in range(500, 506)] == [500, 501, 502, 502, 504, 505] and by[502].n_same == 2 and by[504].n_links == 0
    assert media.copies(spark.createDataFrame([], "media_id long, image binary")).count() == 0


def _features(spark, feats):
    return spark.createDataFrame([(k, bytearray(f[0].tobytes()), bytearray(f[1].tobytes()), bytearray(f[2].tobytes())) for k, f in enumerate(feats)], media.FEATURES)


def test_pairs_found_against_brute_force(spark):
    """Nine of ten true pairs, of all and of the noisiest, are candidates of the tables, and no false pair passes the geometry."""
    imgs = [(k, media.edit(media.draw(f"q{k}"), how, 7 * k + how)) for k in range(10) for how in range(6)]
    imgs += [(k, np.clip(media.draw(f"q{k}").astype(int) + np.random.default_rng(k).integers(-20, 21, (96, 96)), 0, 255).astype(np.uint8)) for k in range(10)]
    feats = [media.describe(x[None])[0] for _, x in imgs]
    pairs, _ = media.candidates(_features(spark, feats))
    found = {(r.a, r.b) for r in pairs.collect()}
    true = set()
    for j in range(len(feats)):
        for i in range(j):
            ok = media.inliers(feats[i], feats[j]) >= media.MIN_INLIERS
            assert imgs[i][0] == imgs[j][0] or not ok
            true |= {(i, j)} if ok else set()
    noisy = {p for p in true if p[1] >= 60}
    assert len(true) > 180 and len(found & true) >= 0.9 * len(true) and len(found & noisy) >= 0.9 * len(noisy)


def test_entries_survive_packing():
    feats = [media.describe(media.edit(media.draw(f"e{k}"), 5, k)[None])[0] for k in range(3)] + [media.describe(np.zeros((1, 4, 4)))[0]]
    e = media.entries([7, -(2**63), 9, 10], feats)
    back = media.unpacked(media.packed(e))
    assert len(e) and not e["extra"].any() and all((back[c] == e[c]).all() for c in ("id", *media.TRAVELS))
    assert not len(media.entries([1], feats[3:])) and not list(media.hits_of(e[:0]))


def test_long_lists_of_equal_descriptors(spark, monkeypatch):
    """A corner that very many unrelated pictures share: its list's first image copies none of them, and no link is lost."""
    monkeypatch.setattr(media, "BLOCK", 10)
    one = media.describe(media.draw("shared")[None])[0]
    feats = []
    for k in range(40):
        # pictures 4m..4m+3 are copies by corners of their own that meet in no table; the shared corner comes first
        own = media.describe(media.draw(f"own{k // 4}")[None])[0]
        desc = own[2].copy()
        bits = np.random.default_rng(k).integers(0, 6, len(desc))
        for p in range(media.PARTS):
            desc[np.arange(len(desc)), 6 * p + bits] ^= 1 << (k % 4)
        feats.append(tuple(np.concatenate([one[c][:1], x]) for c, x in ((0, own[0]), (1, own[1]), (2, desc))))
    df = _features(spark, feats)
    pairs, members = media.candidates(df)
    assert members.count() == 40 and members.select("list").distinct().count() == 1
    led = {(r.a, r.b) for r in pairs.collect()}
    assert {(0, k) for k in range(1, 40)} <= led
    alone = spark.createDataFrame([], "id long, root long")
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in media.links_of_long_lists(members, alone, df).collect()}
    want = {(i, j) for j in range(40) for i in range(j) if media.inliers(feats[i], feats[j]) >= media.MIN_INLIERS}
    assert got == want and all(i // 4 == j // 4 for i, j in want) and len(want) > 40
    # a batch sends SHORT + 1 of the equal descriptors on, the others as members
    e = media.entries(list(range(40)), feats)
    assert e["extra"].sum() == (40 - media.SHORT - 1) * media.PARTS


def test_large_group_has_all_its_links(spark, monkeypatch):
    """Link counts of a group whose entries are long, next to a second picture, equal brute force over all pairs."""
    monkeypatch.setattr(media, "BLOCK", 20)
    imgs = [media.edit(media.draw(name), how, seed) for name in ("hot", "other") for how, seed in [(0, 0), (2, 0), (3, 0), (4, 0), *((1, k) for k in range(3)), *((5, k) for k in range(45))]]
    feats = [media.describe(x[None])[0] for x in imgs]
    links = [0] * len(imgs)
    for i in range(len(imgs)):
        for j in range(i):
            if media.inliers(feats[i], feats[j]) >= media.MIN_INLIERS:
                links[i] += 1
                links[j] += 1
    rows = spark.createDataFrame([(k, media.encode_pgm(x)) for k, x in enumerate(imgs)], "media_id long, image binary")
    got = {r.media_id: (r.class_id, r.n_links) for r in media.copies(rows).collect()}
    assert got == {k: (k // 52 * 52, n) for k, n in enumerate(links)} and min(links) > media.SHORT


def test_pairs_at_a_time_equal_one_by_one():
    feats = [media.describe(media.edit(media.draw(f"b{k}"), how, k)[None], c)[0] for k in range(3) for how, c in ((0, 24), (1, 24), (5, 24), (4, 60), (3, 5))]
    i, j = np.nonzero(np.ones((len(feats),) * 2))
    want = np.array([media.inliers(feats[x], feats[y]) for x, y in zip(i, j, strict=True)])
    got = media.inliers_of(feats, i, j)
    assert (got == np.where(want >= media.MIN_INLIERS, want, got)).all() and ((got >= media.MIN_INLIERS) == (want >= media.MIN_INLIERS)).all()


def test_captures_without_an_id_or_under_one_id_are_rows_of_their_own(spark):
    entries = spark.createDataFrame([(1, "block", "bad.org", "add", 0), (2, "block", "deep.org/a/b/c/d/e", "add", 0), (3, "allow", "deep.org/a/b", "add", 0)], "entry_id long, list_name string, pattern string, action string, changed long")
    long = "https://deep.org/a/b/c/d/e/" + "x" * 100_000
    caps = [(None, "https://bad.org/", 5), (None, "https://good.org/", 5), (1, "https://bad.org/", 5), (1, "https://good.org/", 5), (1, "https://good.org/", 5), (1, "https://bad.org/", None), (2, long, 1), (2, None, 1)]
    got = sorted((str(r.capture_id), str(r.url)[:16], str(r.fetch_time), r.verdict) for r in urlfilter.judge(spark.createDataFrame(caps, "capture_id long, url string, fetch_time long"), entries).collect())
    assert got == sorted([
        ("None", "https://bad.org/", "5", "block"), ("None", "https://good.org", "5", "none"), ("1", "https://bad.org/", "5", "block"), ("1", "https://good.org", "5", "none"),
        ("1", "https://good.org", "5", "none"), ("1", "https://bad.org/", "None", "none"), ("2", "https://deep.org", "1", "block"), ("2", "None", "1", "none"),
    ])


def test_copies_that_share_parts_of_long_lists_only_are_found(spark, monkeypatch):
    rng = np.random.default_rng(5)
    one, feats = tuple(f[:8] for f in media.describe(media.draw("common")[None])[0]), []
    for k in range(16):
        desc = rng.integers(0, 256, one[2].shape, np.uint8)
        desc[:, :6] = one[2][:, :6]  # all share the corners' first parts, so these lists hold over SHORT entries
        if k in (3, 7, 12):  # copies: one bit of each other part differs
            desc = one[2].copy()
            for p in range(1, media.PARTS):
                desc[:, 6 * p] ^= 1 << (k % 8)
        feats.append((one[0], one[1], desc))
    df = _features(spark, feats)
    want = {(i, j) for j in range(16) for i in range(j) if media.inliers(feats[i], feats[j]) >= media.MIN_INLIERS}
    assert want == {(3, 7), (3, 12), (7, 12)} and not media.candidates(df)[0].count()
    alone = df.select("id", F.col("id").alias("root"))
    for block, copies in ((2_000, 100), (8, 10)):
        monkeypatch.setattr(media, "IMAGES_PER_BLOCK", block)
        monkeypatch.setattr(media, "COPIES_AT_ONCE", copies)
        got = {(min(r.a, r.b), max(r.a, r.b)) for r in media.links_across_parts(alone, df).collect()}
        assert got <= want and len({x for pair in got for x in pair}) == 3
    joined = alone.withColumn("root", F.when(F.col("id").isin(3, 7, 12), 3).otherwise(F.col("id")))
    assert not media.links_across_parts(joined, df).count() and not media.links_across_parts(alone.limit(0), df.limit(0)).count()
