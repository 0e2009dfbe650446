"""Brute-force versions and edge cases of hard negatives, the divergence audit and token counts."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatloom.llm import divergence, negatives, tokens

# --- hard negatives

ROWS = "vec_id long, embedding array<double>, label int, _key string, score long, id string"


def mined(rows, positives=5, k=10, low=30, high=90):
    use = [(i, v, lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    q = [[math.floor(x * 256) if abs(x) < 2**53 else int(x) * 256 for x in v] for _, v, _ in use]
    held = lambda n: max(-(2**63) + 1, min(2**63 - 1, n))
    out = []
    for a, (aid, _, lab) in enumerate(use):
        if aid is None or aid % 100:
            continue
        s = [(-held(sum(x * y for x, y in zip(q[a], q[b], strict=False))), (use[b][0] is None, use[b][0] or 0), b) for b in range(len(use)) if b != a]
        mine = sorted(x for x in s if use[x[2]][2] == lab)[:positives]
        other = sorted(x for x in s if use[x[2]][2] != lab)
        for ps, _, p in mine:
            hard = [x for x in other if low * -ps <= 100 * -x[0] <= high * -ps][:k]
            out += [(aid, use[p][0], r + 1, use[n][0], -ps, -ns) for r, (ns, _, n) in enumerate(hard)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect()), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1, "y") for i, v, lab in rows], ROWS)


def test_hard_negatives_of_random_rows(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.5, 0.25, -0.25, 0.1]) for _ in range(6)], rng.choice([0, 0, 1, 2])) for i in range(900)]
    monkeypatch.setattr(negatives, "CHUNK_BYTES", 8 * 6 * 3)  # three anchors a chunk
    got = negatives.mine(vectors(spark, rows).repartition(7), F.col("vec_id") % 100 == 0)
    assert found(got) == mined(rows) and got.count() > 100
    assert found(negatives.mine(vectors(spark, rows), F.col("vec_id") % 100 == 0, 2, 3, 10, 100)) == mined(rows, 2, 3, 10, 100)


def test_a_block_holds_a_bounded_number_of_rows(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(negatives, "BLOCK_ROWS", 10)
    t = pa.table({"vec_id": [3, None, 1] * 9, "label": [1] * 27, "embedding": pa.array([[1.0], [2.0], []] * 9, pa.list_(pa.float64())), "_key": range(27)})
    blocks = list(negatives._blocks(t.to_batches(max_chunksize=4), 1))
    assert sum(len(b.ids) for b in blocks) == 27 and max(len(b.ids) for b in blocks) <= 10
    assert all((np.diff(b.ids) >= 0).all() for b in blocks)


ODD_VECTORS = [
    (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (100, [0.5], 1), (100, None, 1), (200, [math.nan, 1.0], 1), (300, [math.inf], 1), (400, [None, 1.0], 1), (500, [1.0, 1.0], None),
    (1, [0.9, 0.1], 1), (2, [0.9, 0.1], 1), (None, [0.9, 0.1], 1), (3, [0.6, 0.3], 2), (4, [0.6, 0.3], 2), (None, [0.6, 0.3], 2), (5, [], 3), (600, [], 3), (6, [0.7] * 5, 2), (700, [1.0], 9),
    (800, [1e30, 2.0], 4), (7, [1e30, 1.0], 4), (8, [5e29], 5), (9, [1e300], 5), (-100, [0.5, 0.5], 2), (10, [0.0, 0.0], 1), (11, [-0.5, 0.1], 6), (11, [-0.5, 0.1], 6),
]


def test_hard_negatives_of_odd_rows(spark):
    assert found(negatives.mine(vectors(spark, ODD_VECTORS), F.col("vec_id") % 100 == 0)) == mined(ODD_VECTORS)
    assert negatives.mine(vectors(spark, []), F.col("vec_id") % 100 == 0).collect() == []
    assert negatives.mine(vectors(spark, [(1, [1.0], 1)]), F.col("vec_id") % 100 == 0).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_labels_move_on_where_the_id_is_divisible_by_seven(spark):
    rows = spark.createDataFrame([(7, 9), (14, None), (None, 3), (8, 9), (0, 2**31 - 1)], "vec_id long, label int")
    assert [r.label for r in negatives.relabelled(rows).collect()] == [0, None, 3, 9, 2**31 % 10]


# --- divergence


def audited(docs, min_docs, top):
    groups, holders, counts = set(), Counter(), Counter()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
        holders.update({(lang, w) for w in words})
        counts.update((lang, source, w) for w in words)
    out = []
    for lang in {g for g, _ in groups}:
        kept = [w for (g, w), n in holders.items() if g == lang and n >= min_docs]
        sources = sorted(s for g, s in groups if g == lang)
        p = {}
        for s in [*sources, None]:
            c = {w: sum(counts[lang, x, w] for x in (sources if s is None else [s])) for w in kept}
            n = sum(c.values())
            p[s] = {w: 1 + 1_000_000_000 * (c[w] + 5) // (n + 5 * len(kept)) for w in kept}
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][w] - p[t][w]) for w in kept), t.encode()) for t in sources if t != s))
            out += [(lang, s, "pair", t.decode(), -v, r + 1) for r, (v, t) in enumerate(pairs)]
            terms = sorted((-(p[s][w] - p[None][w]), w.encode()) for w in kept if counts[lang, s, w] and p[s][w] > p[None][w])[:top]
            out += [(lang, s, "term", w.decode(), -v, r + 1) for r, (v, w) in enumerate(terms)]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


def test_divergence_of_random_documents(spark, monkeypatch):
    rng = random.Random(5)
    words = ["Ab", "ab", "c", "déjà", "漢字", "É", "zz", "q"]
    docs = [(" ".join(rng.choice(words[: 2 + k % 7]) for _ in range(rng.randrange(20))) + "\x00a1b_c", rng.choice(["en", "fr", None, ""]), f"s{k % 9}") for k in range(300)]
    docs += [(None, "xx", "lonely"), ("", "yy", None), ("", "yy", "b"), ("one", "zz", "a"), ("two", "zz", "b")]
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", 2)  # five blocks of sources
    monkeypatch.setattr(divergence, "BUCKET_ENTRIES", 4)
    df = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "text string, lang string, source string, term string, n long, s1 int").repartition(5)
    for min_docs, top in ((3, 4), (30, 50), (10**6, 50)):
        assert rows_of(divergence.divergence(df, min_docs, top)) == audited(docs, min_docs, top)


def test_divergence_of_odd_documents(spark, odd, none):
    docs = [(r.text, r.lang, r.source) for r in odd.collect()]
    assert rows_of(divergence.divergence(odd, 1, 50)) == audited(docs, 1, 50)
    assert divergence.divergence(none).collect() == []


def test_words_leave_a_task_in_bounded_parts(spark, monkeypatch):
    df = spark.createDataFrame([(f"w{chr(97 + k % 26)}x{chr(97 + k // 26)} w", "en", "s") for k in range(200)], "text string, lang string, source string").coalesce(1)
    whole = {(bytes(r.term), r.n, r.docs) for r in divergence.term_counts(df).collect()}
    assert (b"w", 200, 200) in whole


def test_combinations_are_tallied_without_the_empty_one():
    codes = np.array([[0, 0, 1], [1, 1, 0], [1, 1, 2], [2, 0, 0]])
    got = {(i, j): sorted(zip(a.tolist(), b.tolist(), n.tolist(), strict=True)) for i, j, a, b, n in divergence.tally(codes, 3, [0, 1, 2], [0, 1, 2])}
    want = {}
    for i, j in itertools.combinations(range(3), 2):
        c = defaultdict(int)
        for row in codes:
            if row[i] or row[j]:
                c[int(row[i]), int(row[j])] += 1
        want[i, j] = sorted((a, b, n) for (a, b), n in c.items())
    assert got == want


# --- token counts

ALPHABET = [
    "a", "b", "é", "ß", "漢", "字", "\U0001f600", "'s", "'ll", " ", "  ", "   ", "\n", "\t", " ", "　", "\x85", "\x1c", "​", "1", "23", "!", "--", "<|",
    "<|endoftext|>", "|>", "endoftext", "\0", "é", "don't", " ' ", "word",
]


def library(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.tokenizer_path())
    return [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (300, 40)])
def test_spliced_counts_equal_the_librarys(spark, chunk, overlap):
    rng = random.Random(chunk)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1500))) for _ in range(60)]
    # runs without any break need wider overlaps
    texts += ["a" * 3000, " " * 3000, "!" * 2000 + "a" * 2000, "<|endoftext|>" * 300, "x <|endoftext|>" * 300, " \n" * 1500, None, "", "word " * 600, "ab" * 700 + " " * 900 + "cd " * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(df, chunk=chunk, overlap=overlap).collect()}
    assert got == {i: (len((t or "").encode()), n, n > 1024) for i, (t, n) in enumerate(zip(texts, library(texts), strict=True))}


def test_token_counts_of_odd_rows(spark, odd, none):
    rows = odd.collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n) for r, n in zip(rows, library([r.text for r in rows]), strict=True))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in tokens.token_counts(odd).collect()) == want
    assert tokens.token_counts(none).collect() == []


def test_token_counts_of_the_table(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    rows = df.collect()
    got = {r.doc_id: r.n_tokens for r in tokens.op13_token_counts(spark, small).collect()}
    assert got == {r.doc_id: n for r, n in zip(rows, library([r.text for r in rows]), strict=True)}


def test_parts_are_forgotten_in_generations(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PARTS", 3)
    c = tokens.Counter(tokens.tokenizer_path())
    texts = ["a b c d e", "b c x y z", " ", "  lead", "trail ", "a  b", "b c d e f g h"]
    assert [c.count(t) for t in texts] == library(texts)


def test_tokenizers_without_proof_are_refused(spark):
    with pytest.raises(ValueError, match="prove nothing"):
        tokens.proven(tokens.tokenizer_path("word_bpe_49k.json"))
    assert tokens.proven(tokens.tokenizer_path()) == len("<|endoftext|>")
