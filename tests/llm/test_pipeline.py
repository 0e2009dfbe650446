from tests.llm.conftest import LONG, ODD
from threatloom.llm import jaccard, packing, quality
from threatloom.runtime import table


def brute(spark, sf):
    """The stages in plain Python over collected rows; the mixture alone is taken from its operator."""
    import corpus_pipeline as P
    from tests.llm.test_text_operators import brute_base, brute_components

    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit(docs, labels)
    rows = []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        good, total, *_ = quality.content_words(r.text or "", model)
        if not brute_base(r.text)[5] and good >= quality.CONTENT_SHARE * total:
            rows.append(r)
    first, kept = set(), []
    every = [[x for x in r.text.split("\n") if x.strip()] for r in rows]
    for r, ls in zip(rows, every, strict=True):
        gone = set()
        for i in range(len(ls)):
            n, k = 0, i
            while k < len(ls) and n < 150:
                n += len(ls[k])
                k += 1
            if n >= 150:
                if tuple(ls[i:k]) in first:
                    gone.update(range(i, k))
                first.add(tuple(ls[i:k]))
        at, out = -1, []
        for x in r.text.split("\n"):
            at += bool(x.strip())
            if not x.strip() or at not in gone:
                out.append(x)
        if "".join(out).split():
            kept.append((r.doc_id, "\n".join(out), r.lang, r.source))
    comp = {d: c for d, n, c in brute_components([(d, t) for d, t, *_ in kept], *P.NEAR) if n}
    kept = [x for x in kept if comp.get(x[0], x[0]) == x[0]]
    mixed = P.mixture(spark, spark.createDataFrame([(*x, len(x[1])) for x in kept], docs.schema.simpleString()[7:-1].replace(":", " ")), sf).collect()
    return {r.doc_id: r.text for r in mixed}


def test_pipeline_equals_brute_force(spark, small):
    import corpus_pipeline as P

    want = brute(spark, small)
    got = P.run(spark, small).collect()
    assert {r.doc_id for r in got} == set(want)
    enc = packing.Encoder(packing.tokenizer_path())
    for r in got:
        part = (enc.ids(want[r.doc_id]) + b"\0\0\0\0")[4 * r.start : 4 * (r.start + r.length)]
        assert packing.zlib.crc32(part) == r.ids_crc32


def test_stages_on_odd_and_empty_rows(spark, odd, none, small):
    import corpus_pipeline as P

    assert [len(P.STAGES), P.ORACLE_SQL] == [5, None]
    for name, stage in P.STAGES:
        for docs in (odd, none):
            out = stage(spark, docs, small)
            assert name == "packing" or out.columns == docs.columns
            assert out.count() <= 10 * len(ODD) and (docs is odd or out.count() == 0)
    left = P.near_duplicates(spark, odd, small).collect()
    assert sum(r.doc_id == 6 for r in left) == 1 and not any(r.doc_id == 5 for r in left)
    assert any(r.text == LONG for r in left) and jaccard.NO_ID < 0


def test_near_duplicates_drop_only_copies(spark, odd):
    """Rows that share an id, or have none, go only with a copy of their own text."""
    import corpus_pipeline as P

    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [(1, a), (2, a + " end"), (2, b), (3, c), (3, c), (3, c.upper()), (None, "x y z u v w"), (None, "k l m n o p q"), (None, b + " end"), (4, "k l m n o p q"), (None, ""), (5, "lone text of six words here")]
    df = spark.createDataFrame([(*r, "en", [1], 7) for r in rows], "doc_id long, text string, lang string, prefix array<long>, cls int")
    left = P.near_duplicates(spark, df, "")
    got = sorted(((r.doc_id, (r.text or "").lower()) for r in left.collect()), key=str)
    assert left.columns == df.columns
    assert got == sorted([(1, a), (3, c), (None, "x y z u v w"), (None, "k l m n o p q"), (None, b + " end"), (None, ""), (5, "lone text of six words here")], key=str)
    texts = [r.text for r in P.near_duplicates(spark, odd, "").where("doc_id is null").collect()]
    assert sorted(map(str, texts)) == ["None", "a b c d e f g"]
