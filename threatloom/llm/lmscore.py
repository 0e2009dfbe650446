"""LM scoring: cross-entropy difference of matched bigram models of a target and a background corpus.

Background is every document, target the flagged ones. Both models are additive-smoothed word bigrams over one shared
vocabulary (all words of the corpus), and the background counts are scaled to the target's token total, so that both
lie equally far from the uniform model. A document's own words don't count for its own score (leave one out), in pair
counts and in the totals of contexts alike.

Counts cover the whole corpus and grow with it. Words are counted with map-side pre-aggregation. A loss is a sum of
logarithms of pair counts less a sum of logarithms of context totals, so the two need not meet in one place:

* A context whose tokens would fill half a shard is hot. The totals of hot contexts are broadcast (``HOT_MAX`` of them at
  most, whatever the corpus) and priced where the document is read, which knows its own occurrences.
* Pairs of two hot words are counted ahead, pre-aggregated; those with 1 in ``HOT_PAIRS`` of all tokens, so a bounded
  number, are broadcast and never dealt.
* Other pairs of a hot context are dealt to shards by their word, or by the pair where the word is hot too; pairs of other
  contexts by the context, so that a shard sees whole contexts. Where a task's tokens would fall into over ``FAN`` shards, they are dealt to ranges of shards first, so
  that records stay long. A shard counts its keys, prices every (pair, document) and returns sums per document.

None of these limits changes a score. A record holds its distinct contexts and words as 64-bit hashes once, and two bytes a
token for the word and two for the document.

Edge cases: null and empty texts have no tokens and score 0; repeated rows are scored row by row and count as often as
they occur; no target at all leaves a uniform target model; an empty table gives an empty result; other columns are
ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.runtime import give_back, ship, stage, unstage

ALPHA = 0.05
HOT_SHARE = 1000
HOT_MAX = 1_000_000
HOT_PAIRS = 1_000_000
SHARD_TOKENS = 6_000_000
BATCH_TOKENS = 800_000
REDEAL_TOKENS = 4_000_000
BATCH_DOCS = 60_000
MIN_SHARDS = 24
FAN = 1024
MAX_TASKS = 100_000
PARTS = 8
CACHE_WORDS = 200_000
BROADCAST_IDS = 500_000
_LOW = np.uint64(0xFFFFFFFF)
_SHIFT = np.uint64(32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) or 1
        return h


def word_hashes(text: str | None, known: WordHash) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter((known[w] for w in words), np.uint64, len(words))


def contexts(h: np.ndarray) -> np.ndarray:
    """The word before each word; 0 stands for the start of the text."""
    return np.concatenate([np.zeros(min(1, h.size), np.uint64), h[:-1]])


def _grouped(batches, known: WordHash, limit: int = BATCH_TOKENS):
    """Lists of (doc_id, is_target, word hashes) of about `limit` tokens, BATCH_DOCS documents at most."""
    held, n = [], 0
    for batch in batches:
        for d, text, flag in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            h = word_hashes(text, known)
            held.append((d, bool(flag), h))
            n += h.size
            if n >= limit or len(held) >= BATCH_DOCS:
                yield held
                held, n = [], 0
    if held:
        yield held


def _counted(keys: np.ndarray, flags: np.ndarray):
    import pyarrow as pa

    distinct, back = np.unique(keys, return_inverse=True)
    target = np.bincount(back, weights=flags, minlength=distinct.size).astype(np.int64)
    both = np.bincount(back, minlength=distinct.size).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(target), pa.array(both)], names=["key", "t", "b"])


def _flat(held):
    h = np.concatenate([x[2] for x in held]) if held else np.empty(0, np.uint64)
    c = np.concatenate([contexts(x[2]) for x in held]) if held else h
    sizes = [x[2].size for x in held]
    return h, c, np.repeat(np.arange(len(held), dtype=np.uint16), sizes), np.repeat(np.array([x[1] for x in held], bool), sizes)


def word_counts(flagged: DataFrame) -> DataFrame:
    """(key, t, b, lt, lb): occurrences of every word in the target and in the whole corpus, and those that end a text,
    which are no contexts; key 0 is the start of a text."""
    import pyarrow as pa

    def count(batches):
        for held in _grouped(batches, WordHash()):
            h, c, doc, flags = _flat(held)
            last = np.ones(h.size, bool)
            last[:-1] = doc[1:] != doc[:-1]
            keys, flags = np.concatenate([h, c[c == 0]]), np.concatenate([flags, flags[c == 0]])
            distinct, back = np.unique(keys, return_inverse=True)
            tally = lambda at, w: pa.array(np.bincount(at, weights=w, minlength=distinct.size).astype(np.int64))  # noqa: E731, B023
            n = h.size
            cols = [tally(back, flags), tally(back, None), tally(back[:n], last & flags[:n]), tally(back[:n], last)]
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), *cols], names=["key", "t", "b", "lt", "lb"])

    return flagged.mapInArrow(count, "key long, t long, b long, lt long, lb long").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("t", "b", "lt", "lb")))


def _find(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each x in sorted_keys, or -1."""
    if not sorted_keys.size:
        return np.full(x.size, -1)
    at = np.minimum(np.searchsorted(sorted_keys, x), sorted_keys.size - 1)
    return np.where(sorted_keys[at] == x, at, -1)


def _pairs(tf, t, b, flag, m):
    """Logarithms of pair counts in both models, times occurrences, the document's own taken out."""
    return tf * np.log(t - np.where(flag, tf, 0) + m["alpha"]), tf * np.log(m["scale"] * (b - tf) + m["alpha"])


def _totals(own, t, b, flag, m):
    """Logarithms of context totals in both models, times occurrences, the document's own taken out."""
    v = m["alpha"] * m["vocab"]
    return own * np.log(t - np.where(flag, own, 0) + v), own * np.log(m["scale"] * (b - own) + v)


def _starts(*keys):
    new = np.zeros(keys[0].size, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _per_run(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values over runs that begin at `at`, repeated for each of the n elements."""
    sums = np.add.reduceat(values, at) if at.size else values[:0]
    return np.repeat(sums, np.diff(np.append(at, n)))


def price_shard(key: np.ndarray, doc: np.ndarray, flag: np.ndarray, whole: bool, m: dict):
    """Sums per document over a shard's tokens. whole: contexts (upper halves) are whole and priced here too."""

    def runs(order, *keys):
        """Occurrences per run of equal keys and document, with its totals over the run of equal keys alone."""
        d, f = doc[order], flag[order]
        at, first = _starts(*keys), _starts(*keys, d)
        b, t = _per_run(at, np.ones(d.size), d.size)[first], _per_run(at, f.astype(float), d.size)[first]
        return np.diff(np.append(first, d.size)).astype(float), t, b, f[first], d[first]

    order = np.lexsort((doc, key))
    *pairs, who = runs(order, key[order])
    docs, back = np.unique(who, return_inverse=True)
    total = lambda at, w: np.bincount(at, weights=w, minlength=docs.size)
    pt, pb = (total(back, w) for w in _pairs(*pairs, m))
    if whole:
        order = np.lexsort((doc, key >> _SHIFT))
        *ctx, who = runs(order, (key >> _SHIFT)[order])
        at = np.searchsorted(docs, who)
        ct, cb = (total(at, w) for w in _totals(*ctx, m))
        pt, pb = pt - ct, pb - cb
    return docs, pt, pb


#: A packed record: distinct contexts with the number of tokens of each, distinct words, and a token's word and document.
PACKED = ("uids", "flags", "contexts", "runs", "words", "word", "doc")


def pack(c, w, doc, uids, flags) -> list[bytes]:
    order = np.argsort(c, kind="stable")
    c = c[order]
    at = _starts(c)
    words, word = np.unique(w[order], return_inverse=True)
    d, local = np.unique(doc[order], return_inverse=True)
    word = word.astype(np.uint16 if words.size <= 1 << 16 else np.uint32)
    return [x.tobytes() for x in (uids[d], flags[d], c[at], np.diff(np.append(at, c.size)).astype(np.uint32), words, word, local.astype(np.uint16))]


def unpack(record: list[bytes]) -> list[np.ndarray]:
    kinds = [np.int64, bool, np.uint64, np.uint32, np.uint64, np.uint16 if len(record[5]) == len(record[6]) else np.uint32, np.uint16]
    return [np.frombuffer(x, k) for x, k in zip(record, kinds, strict=True)]


def joined(records: list[list[np.ndarray]]):
    """Tables of several records as one: uids, flags, contexts, runs, words, and a token's word and document."""
    uids, flags, ctx, runs, words = (np.concatenate([r[k] for r in records]) for k in range(5))
    starts = lambda k: np.cumsum([0, *(r[k].size for r in records[:-1])])
    word = np.concatenate([r[5].astype(np.int64) + n for r, n in zip(records, starts(4), strict=True)])
    doc = np.concatenate([r[6].astype(np.int32) + np.int32(n) for r, n in zip(records, starts(0), strict=True)])
    return uids, flags, ctx, runs, words, word, doc


def shard_of(kind: int, c: np.ndarray, w: np.ndarray, shards: int) -> np.ndarray:
    """By context (1); for pairs of a hot context by the word (2), or by the pair where the word is hot too (3)."""
    spread = c & _LOW if kind == 1 else w & _LOW if kind == 2 else ((w ^ (c * _MIX)) * _MIX) >> _SHIFT
    return (spread % np.uint64(shards)).astype(np.int64)


def score_documents(docs: DataFrame, target_ids: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """One row per document row: doc_id, n_tokens, mean loss in both models and their difference (low: like the target)."""
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    ids = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct().withColumn("_f", F.lit(True))
    ids = stage(ids, "target-ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids  # ids only; texts are dealt beyond that
    flagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left").select("doc_id", "text", F.coalesce("_f", F.lit(False)).alias("_f"))
    flagged = stage(flagged, "flagged")
    words = stage(word_counts(flagged), "words")
    total = words.where("key != 0").agg(F.sum("t").alias("t"), F.sum("b").alias("b"), F.count("*").alias("v")).first()
    n_t, n_b, vocab = total["t"] or 0, total["b"] or 0, total["v"] or 0
    shards = max(MIN_SHARDS, -(-n_b // SHARD_TOKENS))
    limit = max(min(n_b / HOT_SHARE, SHARD_TOKENS / 2), n_b / HOT_MAX)
    few = words.where((F.col("key") == 0) | (F.col("b") >= limit)).select("key", (F.col("t") - F.col("lt")).alias("t"), (F.col("b") - F.col("lb")).alias("b")).toArrow()  # HOT_MAX + 1 rows at most
    unstage(words)

    def sorted_table(table):
        keys = np.array(table.column("key").to_numpy()).view(np.uint64)
        by = np.argsort(keys)
        return {"key": keys[by]} | {c: table.column(c).to_numpy()[by].astype(float) for c in ("t", "b")}

    hot, n_hot = spark.sparkContext.broadcast(sorted_table(few)), few.num_rows
    m = {"alpha": alpha, "vocab": max(1, vocab), "scale": n_t / n_b if n_t else 1.0}

    def hot_pairs(batches):
        for held in _grouped(batches, WordHash()):
            h, c, _, flags = _flat(held)
            i, j = _find(hot.value["key"], c), _find(hot.value["key"], h)
            at = (i >= 0) & (j >= 0)
            yield _counted((i[at] * n_hot + j[at]).astype(np.uint64), flags[at])

    pairs = flagged.mapInArrow(hot_pairs, "key long, t long, b long").groupBy("key").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
    paired = spark.sparkContext.broadcast(sorted_table(pairs.where(F.col("b") >= n_b / HOT_PAIRS).toArrow()))  # HOT_PAIRS rows at most
    names = ["shard", "kind", "uid", "doc_id", "n", "pt", "pb", *PACKED]
    kinds = [pa.int32(), pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), *[pa.binary()] * len(PACKED)]
    schema = "shard int, kind byte, uid long, doc_id long, n long, pt double, pb double, " + ", ".join(f"{c} binary" for c in PACKED)
    step = 1 if shards <= FAN else -(-shards // int(np.sqrt(shards)))  # shards a range, where they are dealt in two steps

    def records(kind, c, w, doc, uids, flags, step):
        shard = shard_of(kind, c, w, shards) // step
        order = np.argsort(shard, kind="stable")
        at = _starts(shard[order])
        for lo, hi in zip(at, np.append(at[1:], shard.size), strict=True):
            some = order[lo:hi]
            row = [int(shard[some[0]]), kind, 0, 0, 0, 0.0, 0.0, *pack(c[some], w[some], doc[some], uids, flags)]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

    def deal(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for held in _grouped(batches, WordHash()):
            h, c, doc, flags = _flat(held)
            n = len(held)
            uids = np.arange(uid, uid + n, dtype=np.int64)
            uid += n
            doc_flags = np.array([x[1] for x in held], bool)
            i, j = _find(hot.value["key"], c), _find(hot.value["key"], h)
            sums = np.zeros((2, n))

            def add(keys, values, table, take, sign, doc_flags=doc_flags, sums=sums):
                """Adds prices of this batch's (document, value) runs, the values being places in a broadcast table."""
                size = table["key"].size
                key, back = np.unique(keys.astype(np.int64) * size + values, return_inverse=True)
                who, at = key // size, key % size
                for k, x in enumerate(take(np.bincount(back).astype(float), table["t"][at], table["b"][at], doc_flags[who], m)):
                    sums[k] += sign * np.bincount(who, weights=x, minlength=n)  # noqa: B023

            warm = i >= 0
            if warm.any():
                add(doc[warm], i[warm], hot.value, _totals, -1)
            ahead = np.full(h.size, -1)
            both = warm & (j >= 0)
            ahead[both] = _find(paired.value["key"], (i[both] * n_hot + j[both]).astype(np.uint64))
            if (ahead >= 0).any():
                add(doc[ahead >= 0], ahead[ahead >= 0], paired.value, _pairs, 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(uids % shards // step, pa.int32()), pa.array([0] * n, pa.int8()), pa.array(uids), pa.array([x[0] for x in held], pa.int64()), pa.array([x[2].size for x in held], pa.int64()), pa.array(sums[0]), pa.array(sums[1])]
                + [pa.nulls(n, pa.binary())] * len(PACKED),
                names=names,
            )
            for kind, at in ((1, np.flatnonzero(~warm)), (2, np.flatnonzero(warm & (j < 0))), (3, np.flatnonzero(both & (ahead < 0)))):
                if at.size:
                    yield from records(kind, c[at] if kind == 1 else i[at].astype(np.uint64), h[at], doc[at], uids, doc_flags, step)

    def read(batch, r):
        return unpack([batch.column(k)[r].as_py() for k in range(7, 7 + len(PACKED))])

    def redeal(batches):
        """From ranges of shards to shards, by larger batches."""
        held: dict[int, list] = {1: [], 2: [], 3: []}
        size = {k: [0, 0] for k in held}

        def flush(kind):
            uids, flags, ctx, runs, words, word, doc = joined(held[kind])
            held[kind], size[kind] = [], [0, 0]
            yield from records(kind, np.repeat(ctx, runs), words[word], doc, uids, flags, 1)

        for batch in batches:
            kind = batch.column(1).to_numpy(zero_copy_only=False)
            if (kind == 0).any():
                own = batch.filter(pa.array(kind == 0))
                yield pa.RecordBatch.from_arrays([pa.array(own.column(2).to_numpy() % shards, pa.int32()), *own.columns[1:]], names=names)
            for r in np.flatnonzero(kind).tolist():
                k, record = int(kind[r]), read(batch, r)
                if held[k] and (size[k][0] + record[0].size > BATCH_DOCS or size[k][1] > REDEAL_TOKENS):
                    yield from flush(k)
                held[k].append(record)
                size[k][0] += record[0].size
                size[k][1] += record[6].size
        for k in held:
            if held[k]:
                yield from flush(k)
        give_back()

    def price(batches):
        parts: dict[int, list] = {}
        shard = None

        def flush():
            who, sums = [], []
            for kind, held in parts.items():
                uids, flags, ctx, runs, words, word, doc = joined(held)
                if kind == 1:
                    ctx = np.unique(ctx, return_inverse=True)[1].astype(np.uint64)
                ctx, word = np.repeat(ctx, runs), np.unique(words, return_inverse=True)[1].astype(np.uint64)[word]
                key = (ctx << _SHIFT) | word
                # a part at a time bounds memory; contexts (or pairs of hot contexts) stay whole
                part = ((ctx if kind == 1 else word) % np.uint64(PARTS)).astype(np.int8)
                for p in range(PARTS):
                    at = np.flatnonzero(part == p)
                    if at.size:
                        d, *both = price_shard(key[at], doc[at], flags[doc[at]], kind == 1, m)
                        who.append(uids[d])
                        sums.append(both)
            parts.clear()
            if who:
                uid, back = np.unique(np.concatenate(who), return_inverse=True)
                pt, pb = (np.bincount(back, weights=np.concatenate([x[k] for x in sums]), minlength=uid.size) for k in (0, 1))
                yield result(uid, None, np.zeros(uid.size, np.int64), pt, pb)

        def result(uid, doc_id, n, pt, pb):
            return pa.RecordBatch.from_arrays(
                [pa.array(uid, pa.int64()), pa.nulls(len(uid), pa.int64()) if doc_id is None else doc_id, pa.array(n, pa.int64()), pa.array(pt, pa.float64()), pa.array(pb, pa.float64())],
                names=["uid", "doc_id", "n", "pt", "pb"],
            )

        for batch in batches:
            kind = batch.column(1).to_numpy(zero_copy_only=False)
            if (kind == 0).any():
                own = batch.filter(pa.array(kind == 0))
                yield result(own.column(2), own.column(3), own.column(4), own.column(5), own.column(6))
            for r in np.flatnonzero(kind).tolist():
                s = batch.column(0)[r].as_py()
                if parts and s != shard:
                    yield from flush()
                shard = s
                parts.setdefault(int(kind[r]), []).append(read(batch, r))
        yield from flush()
        give_back()

    dealt = flagged.mapInArrow(deal, schema)
    if step > 1:
        dealt = dealt.repartitionById(-(-shards // step), "shard").mapInArrow(redeal, schema)
    by_shard = dealt.repartitionById(min(shards, MAX_TASKS), "shard").sortWithinPartitions("shard")
    priced = by_shard.mapInArrow(price, "uid long, doc_id long, n long, pt double, pb double")
    sums = priced.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("n").alias("n_tokens"), F.sum("pt").alias("_t"), F.sum("pb").alias("_b"))
    mean = lambda c: F.when(F.col("n_tokens") > 0, -F.col(c) / F.col("n_tokens")).otherwise(0.0)
    return sums.select("doc_id", "n_tokens", mean("_t").alias("loss_target"), mean("_b").alias("loss_background")).withColumn("score", F.col("loss_target") - F.col("loss_background"))


def clean_ids(labels: DataFrame) -> DataFrame:
    """The target: documents labelled good and not toxic."""
    return labels.where("quality = 1 and toxic = 0").select("doc_id")


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score_documents(docs, clean_ids(labels))
    return out.select("doc_id", "n_tokens", *(F.round(c, 5).alias(c) for c in ("loss_target", "loss_background", "score")))


OP7_SQL = rf"""
WITH f AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) AS t,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tok AS (SELECT doc_id, t, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] ELSE '' END AS h FROM (SELECT *, unnest(generate_series(1, len(ws))) AS i FROM f WHERE len(ws) > 0)),
m AS (SELECT count(*) AS nb, count(*) FILTER (WHERE t) AS nt, count(DISTINCT w) AS v, CASE WHEN count(*) FILTER (WHERE t) > 0 THEN count(*) FILTER (WHERE t) / count(*) ELSE 1.0 END AS s FROM tok),
p AS (SELECT h, w, count(*) AS b, count(*) FILTER (WHERE t) AS t FROM tok GROUP BY 1, 2),
c AS (SELECT h, count(*) AS hb, count(*) FILTER (WHERE t) AS ht FROM tok GROUP BY 1),
own AS (SELECT doc_id, h, count(*) AS k FROM tok GROUP BY 1, 2),
d AS (SELECT doc_id, t, h, w, count(*) AS tf FROM tok GROUP BY 1, 2, 3, 4),
x AS (SELECT d.doc_id, d.tf,
             ln(p.t - CASE WHEN d.t THEN d.tf ELSE 0 END + {ALPHA}) - ln(c.ht - CASE WHEN d.t THEN own.k ELSE 0 END + {ALPHA} * m.v) AS pt,
             ln(m.s * (p.b - d.tf) + {ALPHA}) - ln(m.s * (c.hb - own.k) + {ALPHA} * m.v) AS pb
      FROM d JOIN p ON p.h = d.h AND p.w = d.w JOIN c ON c.h = d.h JOIN own ON own.doc_id = d.doc_id AND own.h = d.h CROSS JOIN m),
s AS (SELECT doc_id, sum(tf)::BIGINT AS n_tokens, -sum(tf * pt) / sum(tf) AS lt, -sum(tf * pb) / sum(tf) AS lb FROM x GROUP BY 1)
SELECT documents.doc_id, coalesce(n_tokens, 0) AS n_tokens, round(coalesce(lt, 0), 5) AS loss_target, round(coalesce(lb, 0), 5) AS loss_background, round(coalesce(lt - lb, 0), 5) AS score
FROM documents LEFT JOIN s ON s.doc_id = documents.doc_id
"""
