"""Brute-force versions and edge cases of the operators on documents."""

import hashlib
import random
import zlib
from array import array
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import same_rows
from tests.llm.conftest import LONG, ODD, PASSAGE
from threatloom.llm import jaccard, lines, lmscore, mixing, packing, quality, suffix


def texts_of(small):
    return duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()


# --- packing


def place(counts, cap):
    runs, opened = packing.plan_runs(dict(counts), cap)
    seqs, placed = {}, {}
    for n, rank, many, seq, offset, per in runs:
        for i in range(many):
            placed.setdefault(n, []).append(rank + i)
            seqs.setdefault(seq + i // per, []).append((offset + i % per * n, n))
    assert all(sorted(placed[n]) == list(range(c)) for n, c in counts.items())
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= cap
    assert sorted(seqs) == list(range(opened))
    return opened


def best_fit(counts, cap):
    import bisect

    gaps, n = [], 0
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            i = bisect.bisect_left(gaps, size)
            gap = cap if i == len(gaps) else gaps.pop(i)
            n += gap == cap
            if gap > size:
                bisect.insort(gaps, gap - size)
    return n


@pytest.mark.parametrize("seed", range(20))
def test_packs_as_well_as_sequential_best_fit(seed):
    rng = random.Random(seed)
    cap = rng.choice([16, 64, 2048])
    counts = Counter(min(cap, max(1, int(rng.choice([rng.expovariate(3 / cap), rng.randint(1, cap), rng.lognormvariate(5, 1.2)])))) for _ in range(rng.choice([1, 50, 1500])))
    assert place(counts, cap) <= best_fit(counts, cap)


def test_pieces_are_the_tokenizers(spark, small):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.op3_best_fit_packing(spark, small).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, {})[r.piece] = r
    for d, text in texts_of(small):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        parts = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
        got = [by[d][k] for k in range(len(parts))]
        assert [(r.start, r.length, r.ids_crc32) for r in got] == [(k * 2048, len(p), zlib.crc32(array("I", p).tobytes())) for k, p in enumerate(parts)]
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 2048 and [o for o, _ in sorted(p)] == np.cumsum([0, *(n for _, n in sorted(p))])[:-1].tolist() for p in seqs.values())


def test_encoder_on_odd_words():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(packing.tokenizer_path()), packing.Encoder(packing.tokenizer_path())
    for t in ["", " ", "a b\x1cc", "é ́x", "ΣΑΣ σας ΑΣ", "<|endoftext|> x<|startoftext|>y", "it's they'LL 12３　x y\x85z", "\U0001f600!!\n\r\tİI", "Word. word, WORD.,", "É.", LONG]:
        ids = array("I")
        ids.frombytes(enc.ids(t))
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids


def test_packing_edges(odd, none):
    rows = packing.pack(packing.token_pieces(odd)).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) and {r.length for r in rows if r.doc_id in (1, 2)} == {1}
    assert sum(r.piece == 0 for r in rows) == len(ODD)
    assert packing.pack(packing.token_pieces(none)).count() == 0


# --- suffix array


def test_suffix_array_by_grouping():
    rng = random.Random(1)
    for _ in range(600):
        q = [rng.randrange(rng.choice([1, 2, 3, 26])) for _ in range(rng.randint(0, 40))]
        q = q * 2 if rng.random() < 0.3 else q
        assert suffix.suffix_array(q) == sorted(range(len(q)), key=lambda i: q[i:])


def brute_repeats(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        out.append((len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("group", [3000, 1])
def test_repeats_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
    base = " ".join(word() for _ in range(200))
    texts = [None, "", "a" * 199, "a" * 450, "ab" * 300, base, base, base[100:700] + "é" + base[300:650], "x" + base[5:204], base[5:205] + "y", " ".join(word() for _ in range(300))]
    texts += [base[: rng.randint(150, 900)] + word() + base[rng.randint(0, 500) :][: rng.randint(0, 400)] for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_repeats_edges(odd, none):
    got = sorted((r.n_bytes, r.n_removed) for r in suffix.remove_repeats(odd).collect())
    assert got == sorted(x[:2] for x in brute_repeats([r[1] for r in ODD]))
    assert suffix.remove_repeats(none).count() == 0


# --- Jaccard join


def brute_components(rows, n, num, den):
    def grams(t):
        w = [x for x in (t or "").translate({k: k + 32 for k in range(65, 91)}).encode().split()]
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(s), low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("short", [1, 3, 32])
def test_jaccard_equals_brute_force(spark, monkeypatch, short):
    monkeypatch.setattr(jaccard, "SHORT", short)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    line = " ".join(word() for _ in range(9))
    rows = []
    for _ in range(4):
        base = [word() for _ in range(rng.choice([12, 60, 150]))]
        for _ in range(18):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 2)] = [word()] * rng.randint(0, 1)
            rows.append((len(rows), " ".join(w) + (" " + line) * rng.randint(0, 1)))
    rows += [(900, None), (901, ""), (902, "One two"), (903, "one TWO"), (904, line)]
    got = sorted(tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect())
    assert got == sorted(brute_components(rows, 4, 85, 100))


def test_lists_of_medium_length_are_compared_without_pivots(spark, monkeypatch):
    """A shared line makes lists of over SHORT entries; its few links are found in tasks, and dense or huge lists are left whole."""
    rng = random.Random(12)
    line, word = "a line that very many texts share", lambda: str(rng.randrange(10**9))
    texts = [" ".join(word() for _ in range(rng.choice([3, 9, 40, 120]))) + " " + line for _ in range(60)]
    texts += [t + " " + word() for t in texts[:5]]
    rows = list(enumerate(texts))
    want = sorted(brute_components(rows, 4, 85, 100))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "SHORT", 4)
    with monkeypatch.context() as m:
        m.setattr(jaccard, "answers", None)  # what a pivot's comparison needs
        assert sorted(tuple(r) for r in jaccard.near_duplicates(df, 4, 85, 100).collect()) == want
    assert 1 < len({c for _, _, c in want}) < 65
    for limit, value in (("LIKELY", 0), ("MEDIUM", 10)):
        with monkeypatch.context() as m:
            m.setattr(jaccard, limit, value)
            assert sorted(tuple(r) for r in jaccard.near_duplicates(df, 4, 85, 100).collect()) == want


@pytest.mark.parametrize("bound", [0, 500_000])
def test_tokens_are_dealt_in_parts(spark, monkeypatch, tmp_path, bound):
    """No shuffle holds all prefixes, and results stay the same with and without broadcasts and with many exact copies."""
    rng = random.Random(5)
    word = lambda: str(rng.randrange(10**9))
    texts = [" ".join(word() for _ in range(400)) for _ in range(200)]
    texts += [t + " " + word() for t in texts[:40]] + texts[:100] * 2 + [None, ""]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents")
    for name, value in (("SHORT", 2), ("TOKENS_AT_ONCE", 0), ("BROADCAST_TOKENS", bound)):
        monkeypatch.setattr(jaccard, name, value, raising=False)
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    before = {stages().apply(i).stageId() for i in range(stages().size())}
    got = sorted(tuple(r) for r in jaccard.near_duplicates(spark.read.parquet(f"{tmp_path}/documents"), 4, 85, 100).collect())
    assert got == sorted(brute_components(rows, 4, 85, 100))
    done = stages()
    written = max(done.apply(i).shuffleWriteBytes() for i in range(done.size()) if done.apply(i).stageId() not in before)
    tokens = sum(jaccard.prefix_length(397, 85, 100) for t in set(texts) if t)
    assert not bound or written < 10 * tokens  # without broadcasts the pairs' sets are dealt, which is more here


@pytest.mark.parametrize("likely, widths", [(4, (40, 90)), (10**6, (40, 90)), (10**6, (50, 700))])
def test_pairs_in_lists_are_those_that_parities_leave(spark, monkeypatch, likely, widths):
    import numpy as np

    monkeypatch.setattr(jaccard, "LIKELY", likely)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 800, np.uint64)
    sets = {c: np.unique(np.r_[base[: rng.integers(*widths)], rng.integers(0, 2**63, rng.integers(0, 9), np.uint64)]) for c in range(40)}
    sets |= {c: np.unique(rng.integers(0, 2**63, 60, np.uint64)) for c in range(40, 90)}
    lists = {7: range(40), 8: range(30, 90), -9: range(38, 41)}
    marks = spark.createDataFrame([(c, len(s), jaccard.parity(s).tolist()) for c, s in sets.items()], "cls long, size long, bits array<long>")
    got = jaccard.pairs_in_lists(spark.createDataFrame([(k, c) for k, cs in lists.items() for c in cs], "key long, cls long"), marks, 80, 100).collect()
    near = lambda a, b: len({*sets[a].tolist()} & {*sets[b].tolist()}) * 100 >= 80 * len({*sets[a].tolist(), *sets[b].tolist()})
    whole = {r.key for r in got if r.x is None}
    assert (7 in whole) == (likely == 4) and len({(r.key, r.x, r.y) for r in got}) == len(got)
    for key, cs in lists.items():
        pairs = {(r.x, r.y) for r in got if r.key == key and r.x is not None}
        links = {(a, b) for a in cs for b in cs if a < b and near(a, b)}
        assert not pairs if key in whole else links <= pairs <= {(a, b) for a in cs for b in cs if a < b}


@pytest.mark.parametrize("block", [250_000, 600])
def test_members_of_many_long_lists_are_compared_once(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", block)
    rng = random.Random(4)
    bases = [[rng.randrange(2**62) for _ in range(n)] for n in (40, 50, 50, 200)]
    sets = {c: sorted({*b[rng.randrange(3) :], rng.randrange(2**62)}) for b in bases for c in rng.sample(range(10**9), 24)}
    comp = {c: min(list(sets)[72:]) if k >= 72 else c for k, c in enumerate(sets)}  # the last group is connected already
    held = [(key, c, len(sets[c]), comp[c]) for key in range(12) for c in rng.sample(list(sets), 70)]
    held += [(99, c, len(s), comp[c]) for c, s in sets.items()]
    out = jaccard.links_in_lists(spark.createDataFrame(held, "key long, cls long, size long, comp long"), spark.createDataFrame(list(sets.items()), "cls long, toks array<long>"), 80, 100)
    got = {(r.x, r.y) for r in out.collect()}
    links = {(a, b) for a in sets for b in sets if a < b and comp[a] != comp[b] and len({*sets[a]} & {*sets[b]}) * 100 >= 80 * len({*sets[a], *sets[b]})}

    def roots(pairs):
        up = dict(comp)
        while True:
            least = {**up}
            for a, b in pairs:
                least[a] = least[b] = min(least[a], least[b])
            if least == up:
                return up
            up = least

    assert got <= links and roots(got) == roots(links) and len({*roots(got).values()}) == 4
    assert len(got) == 3 * 23 or block < 1_000  # one block: no more links than connect


def test_jaccard_edges(odd, none):
    got = [tuple(r) for r in jaccard.near_duplicates(odd, 4, 85, 100).collect()]
    assert len(got) == len(ODD) and got.count((6, *next(x[1:] for x in got if x[0] == 6))) == 2
    assert {x[2] for x in got if x[0] in (4, 5)} == {4} and (1, 0, 1) in got and (None, 0, None) in got
    assert jaccard.near_duplicates(none, 4, 85, 100).count() == 0


# --- line dedup


def brute_lines(rows, least):
    all_lines = [[x for x in (t or "").split("\n") if x.strip(lines.BLANK)] for _, t in rows]
    first, gone = {}, [set() for _ in rows]
    for d, ls in enumerate(all_lines):
        for i in range(len(ls)):
            n, k = 0, i
            while k < len(ls) and n < least:
                n += len(ls[k])
                k += 1
            if n >= least and first.setdefault(tuple(ls[i:k]), (d, i)) != (d, i):
                gone[d].update(range(i, k))
    return [(len(ls), len(g)) for ls, g in zip(all_lines, gone, strict=True)]


def test_lines_equal_brute_force(spark):
    rng = random.Random(2)
    pool = ["".join(rng.choice("abc ") for _ in range(rng.choice([1, 3, 9, 40]))) for _ in range(14)]
    rows = [(d, "\n".join(rng.choice([*pool, "", " "]) for _ in range(rng.randint(0, 30)))) for d in range(25)]
    got = {r.doc_id: (r._n_lines, r._n_removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 25).collect()}
    assert [got[d] for d, _ in rows] == brute_lines(rows, 25)


def test_lines_edges(odd, none):
    out = lines.dedup_lines(odd)
    assert out.columns[: len(odd.columns)] == odd.columns
    rows = out.collect()
    assert len(rows) == len(ODD) and [r.text for r in rows if r.doc_id == 1] == [None]
    assert [r.text for r in rows if r.doc_id == 6] == [PASSAGE + "\nmine"] * 2 and [r.text for r in rows if r.doc_id == 7] == ["x"]
    assert lines.dedup_lines(none).count() == 0
    assert {(r._d, r.c, tuple(r.prefix)) for r in lines.dedup_lines(odd).collect()} == {(7, 8, (1,))}
    clash = odd.withColumns({"_n_lines": F.lit("x"), "_threatloom": F.lit(3)})
    got = lines.dedup_lines(clash)
    assert got.columns == [*(c for c in clash.columns if c != "_n_lines"), *lines.ADDED] and got.where("_threatloom = 3").count() == len(ODD)


# --- quality


def brute_base(t):
    w = (t or "").encode().split()
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    ls, dup, before = [x for x in (t or "").split("\n") if x.encode().split()], 0, set()
    for x in ls:
        dup += x in before
        before.add(x)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_base_statistics(small):
    for t in [x for _, x in texts_of(small)] + [r[1] for r in ODD] + ["a b c d e f g h " * 3, "x\x85y\x1cz " * 30]:
        assert quality.base_row(t) == brute_base(t)


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(3)
    for _ in range(200):
        n = rng.integers(1, 8)
        s, t = rng.normal(0, 2, n), rng.normal(0, 2, (2, 2))
        value = lambda y: sum(s[i] for i in range(n) if y[i]) + sum(t[int(y[i - 1]), int(y[i])] for i in range(1, n))  # noqa: E731, B023
        best = max(itertools.product([False, True], repeat=int(n)), key=value)
        assert value(quality.viterbi(s, t)) == pytest.approx(value(best))


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train = labels.where("doc_id % 3 <> 0")
    rows = quality.label_quality(docs, quality.fit(docs, train)).join(labels.where("doc_id % 3 = 0"), "doc_id").where("not base_failed").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) >= 0.97 * len(rows) > 50
    assert sum(r.kept for r in rows if r.quality == 1) >= 0.98 * sum(r.quality == 1 for r in rows)


def test_boilerplate_lines_inside_documents():
    """Documents' labels alone teach the chain to find lines of boilerplate in good documents, and prose in bad ones."""
    rng = np.random.default_rng(5)
    prose = lambda: " ".join("".join(rng.choice(list("aeioulnrst"), rng.integers(2, 9))) for _ in range(rng.integers(6, 15))).capitalize() + "."
    junk = lambda: " ".join(w + "###" for w in prose().split()[:8])
    rows, truth = [], []
    for k in range(400):
        good = k % 4 != 0
        ls = [(prose(), True) if (rng.random() < (0.8 if good else 0.2)) else ((("Licensed under the X License.", "a | b | c | d")[k % 2], False) if good else (junk(), False)) for _ in range(8)]
        words = [len(x.split()) * c for x, c in ls]
        if (sum(words) >= 0.5 * sum(len(x.split()) for x, _ in ls)) == good:
            rows.append(("\n".join(x for x, _ in ls), int(good)))
            truth.append([c for _, c in ls])
    model = quality.train(rows[:200])
    told = [(list(quality.line_labels(t, model)[0]), want, y) for (t, y), want in zip(rows[200:], truth[200:], strict=True)]
    assert np.mean([a == b for got, want, _ in told for a, b in zip(got, want, strict=True)]) > 0.95
    assert sum(0 < sum(got) < len(got) for got, *_ in told) > len(told) / 2
    assert np.mean([not a for got, want, y in told if y for a, b in zip(got, want, strict=True) if not b]) > 0.9


def test_relabelling_agrees_with_the_document():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 9, (300, 7))
    words[:, 0] += 1
    good, scores = rng.random(300) < 0.5, rng.normal(0, 2, (300, 7))
    before = (scores > 0) & (words > 0)
    after = quality._agree(before.copy(), scores, good, words, 0.5)
    assert ((((after * words).sum(1) >= 0.5 * words.sum(1)) == good)).all()
    fine = ((before * words).sum(1) >= 0.5 * words.sum(1)) == good
    assert (after[fine] == before[fine]).all()
    tr = np.array([[0.7, -0.2], [0.1, 0.4]])
    for k, path in enumerate(quality._best_paths(scores, tr, np.ones((300, 7)))):
        assert (path == quality.viterbi(scores[k], tr)).all()


def test_quality_edges(spark, odd, none):
    rows = quality.label_quality(odd, quality.PRIOR).collect()
    assert len(rows) == len(ODD) and not any(r.kept for r in rows if r.n_words < 20)
    labels = spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(odd, labels) == quality.PRIOR
    assert quality.label_quality(none, quality.PRIOR).count() == 0 and quality.keep_good(none, quality.PRIOR).columns == none.columns


# --- LM scores and mixing


def test_lm_tells_target_from_rest(spark):
    rng = random.Random(6)
    make = lambda words: " ".join(rng.choice(words) for _ in range(60))
    good, bad = [f"g{i}" for i in range(30)] + ["the"] * 20, [f"b{i}" for i in range(30)] + ["the"] * 20
    rows = [(i, make(good if i % 2 else bad)) for i in range(80)]
    ids = spark.createDataFrame([(i,) for i in range(1, 40, 2)], "doc_id long")
    got = {r.doc_id: r.score for r in lmscore.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), ids).collect()}
    assert max(got[i] for i in range(41, 80, 2)) < min(got[i] for i in range(0, 80, 2))


@pytest.mark.parametrize(
    "limits",
    [
        {"HOT_SHARE": 0.5, "HOT_PAIRS": 0.5},  # every context is cold but the start; no pair is counted ahead
        {"HOT_MAX": 10**9, "SHARD_TOKENS": 2, "HOT_PAIRS": 0.5, "MIN_SHARDS": 1, "MAX_TASKS": 7},  # every context is hot, every pair dealt
        {"SHARD_TOKENS": 3000, "HOT_PAIRS": 2000, "MIN_SHARDS": 1, "FAN": 4, "REDEAL_TOKENS": 500},  # some of each, dealt in two steps
    ],
)
def test_lm_scores_do_not_depend_on_limits(spark, small, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(lmscore, k, v)
    same_rows(lmscore.op7_lm_scoring(spark, small), lmscore.OP7_SQL, small)


def test_records_survive_packing():
    rng = np.random.default_rng(3)
    c, w = rng.integers(0, 9, 90_000).astype(np.uint64), rng.integers(0, 2**64, 90_000, dtype=np.uint64)
    doc, uids, flags = rng.integers(0, 40, 90_000), np.arange(40) << 40, rng.integers(0, 2, 40).astype(bool)
    some = [lmscore.unpack(lmscore.pack(c[k:n], w[k:n], doc[k:n], uids, flags)) for k, n in ((0, 50), (50, 80_000), (80_000, 90_000))]
    back_uids, back_flags, ctx, runs, words, word, at = lmscore.joined(some)
    got = sorted(zip(np.repeat(ctx, runs).tolist(), words[word].tolist(), back_uids[at].tolist(), back_flags[at].tolist(), strict=True))
    assert got == sorted(zip(c.tolist(), w.tolist(), uids[doc].tolist(), flags[doc].tolist(), strict=True))


def test_lm_edges(spark, odd, none):
    ids = spark.createDataFrame([(6,), (None,), (77,)], "doc_id long")
    rows = lmscore.score_documents(odd, ids).collect()
    assert len(rows) == len(ODD) and all(r.score == 0 for r in rows if r.n_tokens == 0) and sum(r.doc_id is None for r in rows) == 2
    assert lmscore.score_documents(odd, ids.limit(0)).count() == len(ODD) and lmscore.score_documents(none, ids).count() == 0


def test_mixing_holds_its_marginals(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    both = [mixing.mix(docs, max_cells=m).toPandas().sort_values("doc_id").reset_index(drop=True) for m in (mixing.MAX_CELLS, 0)]
    assert np.allclose(both[0]["p"], both[1]["p"]) and (both[0]["kept"] == both[1]["kept"]).all()
    x = both[0]
    assert abs((x["p"] * x["n_tokens"]).sum() / x["n_tokens"].sum() - mixing.BUDGET) < 0.02
    # cells that no cap holds back meet the target shares of languages
    free = mixing.mix(docs, budget=0.02).toPandas()
    free["w"] = free["p"] * free["n_tokens"]
    share = free.groupby("lang")["w"].sum() / free["w"].sum()
    goal = free.groupby("lang")["n_tokens"].sum() ** 0.7
    assert np.allclose(share, goal / goal.sum(), atol=0.02)


def test_targets_and_clashing_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    clash = docs.withColumns({"p": F.lit("x"), "kept": F.lit(7), "_source": F.lit(1)})
    assert mixing.mix(clash).columns == [*docs.columns, "_source", "topic", "n_tokens", "p", "kept"]
    langs = [r[0] for r in docs.select("lang").distinct().orderBy("lang").collect()]
    targets = {"lang": spark.createDataFrame([(v, float(k + 1)) for k, v in enumerate(langs)], "lang string, share double")}
    for cells in (mixing.MAX_CELLS, 0):
        got = {r.lang: r.expected for r in mixing.shares(mixing.mix(docs, targets, budget=0.01, max_cells=cells), "lang").collect()}
        assert all(abs(got[v] - (k + 1) / sum(range(1, len(langs) + 1))) < 1e-6 for k, v in enumerate(langs))


def test_mixing_edges(odd, none):
    out = mixing.mix(odd)
    assert out.columns == [*odd.columns, "topic", "n_tokens", "p", "kept"] and out.count() == len(ODD)
    rows = out.collect()
    assert len({r.kept for r in rows if r.doc_id == 6}) == 1 and all(r.kept for r in rows if r.doc_id is None)
    assert mixing.mix(none).count() == 0
