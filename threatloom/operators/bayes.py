"""Token-statistics classifier: counts by class, sparse bigrams, and a combined probability per document."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.functions import refdata as R
from threatloom.functions.text import once
from threatloom.runtime import give_back, ship, stage, stage_parts, unstage

TOKEN = "[a-z0-9]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def sparse_bigrams(tokens: Column, reach: int = 4) -> Column:
    """Ordered pairs of a word and each of the next `reach`, with their distance: 'a~2~c'."""

    def pairs(words: Column, d: int) -> Column:
        return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - d, F.lit(0))), F.slice(words, d + 1, F.size(words)), lambda x, y: F.concat(x, F.lit(f"~{d}~"), y))

    return once(tokens, lambda w: F.concat(*(pairs(w, d) for d in range(1, reach + 1))))


def learn(labelled: DataFrame, feature: Column) -> DataFrame:
    """(token, spam, ham): documents of each class that hold a feature. labelled: text, is_spam."""
    rows = labelled.select("is_spam", F.explode(F.array_distinct(feature)).alias("token"))
    return rows.groupBy("token").agg(F.count_if("is_spam").alias("spam"), F.count_if(~F.col("is_spam")).alias("ham"))


def classify(docs: DataFrame, stats: DataFrame, n_spam: int, n_ham: int, key: str, feature: Column) -> DataFrame:
    """(key, n_tokens, probability): Laplace-smoothed log odds averaged over known distinct tokens, as a probability.

    Documents without a known token get 0.5; below MIN_LEARNS of either class the classifier stays silent (null).
    """
    rows = docs.select(key, F.explode_outer(F.array_distinct(feature)).alias("token"))
    odds = F.log((F.col("spam") + 1) / F.lit(n_spam + 2.0)) - F.log((F.col("ham") + 1) / F.lit(n_ham + 2.0))
    scored = rows.join(stats, "token", "left").groupBy(key).agg(F.count("spam").alias("n_tokens"), F.avg(odds).alias("_odds"))
    p = 1 / (1 + F.exp(-F.coalesce("_odds", F.lit(0.0))))
    enough = F.lit(min(n_spam, n_ham) >= R.MIN_LEARNS)
    return scored.select(key, "n_tokens", F.when(enough, p).alias("probability"))


def bayes_symbol(p: Column) -> Column:
    """struct(symbol, multiplier): certainty beyond even odds, spam or ham; null in between."""
    return F.when(p > 0.5, F.struct(F.lit("BAYES_SPAM").alias("symbol"), ((p - 0.5) * 2).alias("multiplier"))).when(p < 0.5, F.struct(F.lit("BAYES_HAM").alias("symbol"), ((F.lit(0.5) - p) * 2).alias("multiplier")))


def learn_class(tokens: Column, score: Column, deterministic: Column) -> Column:
    """'spam', 'ham' or null: which class a scored message may teach; both limits belong to their class."""
    return F.when((tokens < R.LEARN_TOKENS) | deterministic, None).when(score >= R.LEARN_SPAM, "spam").when(score <= R.LEARN_HAM, "ham")


def may_learn(cls: Column, n_spam: Column, n_ham: Column, balance: float = R.LEARN_BALANCE) -> Column:
    """The class a message may teach, or null where that class is ahead of the other by more than 1/balance already."""
    ahead = lambda a, b: a / (b + 1) > 1 / balance
    return F.when(cls == "spam", F.when(~ahead(n_spam, n_ham), cls)).when(cls == "ham", F.when(~ahead(n_ham, n_spam), cls))


def autolearn(scored: DataFrame, n_spam: int, n_ham: int, feature: Column, tokens: Column, condition: Column | None = None) -> DataFrame:
    """(token, spam, ham) that a batch of verdicts (text, score, fired) teaches, with one row of a null token that counts the
    messages of each class. `condition` is the caller's own guard; a message it isn't true of teaches nothing.

    Nothing is learnt from short messages, from scores between both limits, from deterministic symbols, or for a class that
    is ahead; balance is judged by the counts before the batch.
    """
    sure = F.arrays_overlap("fired", F.array(*(F.lit(s) for s in R.DETERMINISTIC)))
    cls = may_learn(learn_class(F.size(tokens), F.col("score"), F.coalesce(sure, F.lit(False))), F.lit(n_spam), F.lit(n_ham))
    kept = scored.withColumn("_class", cls).where(F.col("_class").isNotNull())
    if condition is not None:
        kept = kept.where(condition)
    known = F.array_append(F.array_distinct(feature), F.lit(None).cast("string"))
    rows = kept.select((F.col("_class") == "spam").alias("is_spam"), F.explode(known).alias("token"))
    return rows.groupBy("token").agg(F.count_if("is_spam").alias("spam"), F.count_if(~F.col("is_spam")).alias("ham"))


#: Weights of a pair of words by their distance, prior strength, and the band around even odds that says nothing.
PAIR_WEIGHTS, PRIOR, SILENT, SHARPNESS = [3125.0, 256.0, 27.0, 1.0], 0.5, 0.05, 8


def weighted_pairs(tokens: Column) -> Column:
    """ARRAY<STRUCT<token, weight>>: sparse bigrams with the weight of their distance, each once."""

    def pairs(words: Column, d: int) -> Column:
        both = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - d, F.lit(0))), F.slice(words, d + 1, F.size(words)), lambda x, y: F.concat(x, F.lit(f"~{d}~"), y))
        return F.transform(F.array_distinct(both), lambda t: F.struct(t.alias("token"), F.lit(PAIR_WEIGHTS[d - 1]).alias("weight")))

    return once(tokens, lambda w: F.concat(*(pairs(w, d) for d in range(1, len(PAIR_WEIGHTS) + 1))))


def chi_square_tail(m: Column, n: Column) -> Column:
    """Probability that a chi-square of 2n degrees of freedom exceeds 2m: exp(-m) * sum of m^i / i! for i < n.

    Terms are summed by their logarithms, so that neither thousands of features nor certain ones overflow or vanish.
    """
    import pandas as pd

    def tails(ms, ns):
        import math

        import numpy as np

        facts, out = np.zeros(0), np.ones(len(ms))  # facts: log i!
        for k, (m, n) in enumerate(zip(ms.tolist(), ns.tolist())):
            if n > facts.size:
                facts = np.concatenate([facts, [math.lgamma(i + 1.0) for i in range(facts.size, max(n, 2 * facts.size))]])
            if n > 0:
                out[k] = min(1.0, np.exp(np.arange(n) * math.log(max(m, 1e-300)) - m - facts[:n]).sum())
        return pd.Series(out)

    tails.__annotations__ = {"ms": pd.Series, "ns": pd.Series, "return": pd.Series}  # Spark reads types, not their names
    return F.pandas_udf(tails, "double")(m, n.cast("long"))


def fisher(docs: DataFrame, stats: DataFrame, n_spam: int, n_ham: int, key: str, features: Column) -> DataFrame:
    """(key, n_tokens, probability): window-weighted features combined by the inverse chi-square.

    A feature's spam share of its class frequencies is drawn to even odds by its weight and how often it was learnt; shares
    within SILENT of even odds don't count. With the indicators S and H of spam and ham the probability is (1 + S - H) / 2.
    A document without a telling feature gets 0.5; below MIN_LEARNS of either class the classifier stays silent (null).
    """
    rows = docs.select(key, F.explode_outer(features).alias("_f")).select(key, "_f.token", "_f.weight")
    sums = evidence(rows.join(stats, "token", "left"), F.col("weight"), n_spam, n_ham, key)
    return combined(sums, n_spam, n_ham, key)


def evidence(known: DataFrame, weight: Column, n_spam: int, n_ham: int, key: str) -> DataFrame:
    """(key, n_tokens, _spam, _ham) from features with their statistics: how many tell, and their negative log likelihoods."""
    spam, ham = F.col("spam") / F.lit(max(1.0, float(n_spam))), F.col("ham") / F.lit(max(1.0, float(n_ham)))
    seen = (F.col("spam") + F.col("ham")).cast("double")
    trust = weight * seen / (1 + weight * seen)
    p = (trust * PRIOR + seen * (spam / F.nullif(spam + ham, F.lit(0.0)))) / (trust + seen)
    told = known.withColumn("_p", p).withColumn("_p", F.when(F.abs(F.col("_p") - 0.5) >= SILENT, F.least(F.greatest("_p", F.lit(1e-6)), F.lit(1 - 1e-6))))
    return told.groupBy(key).agg(F.count("_p").alias("n_tokens"), F.coalesce(-F.sum(F.log("_p")), F.lit(0.0)).alias("_spam"), F.coalesce(-F.sum(F.log(1 - F.col("_p"))), F.lit(0.0)).alias("_ham"))


def combined(sums: DataFrame, n_spam: int, n_ham: int, key: str) -> DataFrame:
    """(key, n_tokens, probability) from the evidence of a document."""
    indicators = sums.withColumns({"_s": 1 - chi_square_tail(F.col("_ham"), F.col("n_tokens")), "_h": 1 - chi_square_tail(F.col("_spam"), F.col("n_tokens"))})
    probability = F.when(F.col("n_tokens") == 0, 0.5).otherwise((1 + F.col("_s") - F.col("_h")) / 2)
    return indicators.select(key, "n_tokens", F.when(F.lit(min(n_spam, n_ham) >= R.MIN_LEARNS), probability).alias("probability"))


#: Beyond so many words the pairs of a distance are dealt in SLICES parts, one after the other, beyond MANY_WORDS in twice as many; a
#: group joins some ENTRIES of them.
WORDS_AT_ONCE, MANY_WORDS, SLICES, ENTRIES, LEAST_GROUPS = 5_000_000, 1_000_000_000, 4, 4_000_000, 8


class WordHash(dict):
    """Word to 64-bit hash; a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def hashed_words(rows: DataFrame, name: str) -> DataFrame:
    """(name, _i, _n, _w) of rows (name, text), staged: a number of the row, how many words it has and their 64-bit hashes, packed."""
    import pyarrow as pa

    ship(rows.sparkSession)

    def cut(batches):
        import re

        find, known = re.compile(TOKEN.encode()).findall, WordHash()
        for batch in batches:
            counts, packed = [], []
            for text in batch.column(1).to_pylist():
                found = find((text or "").lower().encode("utf-8", "surrogatepass"))
                counts.append(len(found))
                packed.append(np.fromiter(map(known.__getitem__, found), np.uint64, len(found)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], names=[name, "_n", "_w"])
        give_back()

    kind = rows.schema[name].dataType.simpleString()
    cuts = rows.select(name, "text").mapInArrow(cut, f"`{name}` {kind}, _n long, _w binary")
    return stage(cuts.withColumn("_i", F.monotonically_increasing_id()), "words")


def pair_entries(rows: DataFrame, mark: str, d: int, part: int, parts: int, groups: int) -> DataFrame:
    """(grp, block, toks, marks): distinct pairs at distance d of each row (_i, mark, _w), of one part of the first words' hashes,
    by ranges of the pairs' hashes. A block is a run of rows with numbers from `block` on; an entry's mark is its row's place in it, or with mark "is_spam"
    the row's class (the block is null then)."""
    import pyarrow as pa

    def work(batches):
        edges = np.array([(g << 64) // groups for g in range(1, groups)], np.uint64)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = sorted({0, *(np.flatnonzero(np.diff(ids) != 1) + 1).tolist(), *range(0, ids.size, 2**16), ids.size})  # places take 16 bits
            packed = batch.column(2).to_pylist()
            for lo, hi in zip(cuts, cuts[1:]):
                w = np.frombuffer(b"".join(packed[lo:hi]), np.uint64)
                doc = np.repeat(np.arange(hi - lo, dtype=np.uint16), [len(p) // 8 for p in packed[lo:hi]])
                same = doc[:-d] == doc[d:]
                same = np.flatnonzero(same & (w[: same.size] % np.uint64(parts) == part) if parts > 1 else same)
                with np.errstate(over="ignore"):
                    h = (w[same] ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xFF51AFD7ED558CCD)
                    h = ((h ^ (h >> np.uint64(32))) + w[same + d]) * np.uint64(0xC4CEB9FE1A85EC53)
                    h ^= h >> np.uint64(29)
                order = np.argsort(h, kind="stable")  # rows stay in order
                h, doc = h[order], doc[same[order]]
                once = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: h.size]
                h, doc = h[once], doc[once]
                if mark == "is_spam":
                    doc = np.array(batch.column(1).to_pylist()[lo:hi], np.uint8)[doc] if h.size else doc.astype(np.uint8)
                at = np.r_[0, np.searchsorted(h, edges), h.size]
                held = np.flatnonzero(np.diff(at)).tolist()
                block = None if mark == "is_spam" else int(ids[lo]) if hi > lo else 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held, pa.int32()), pa.array([block] * len(held), pa.int64()), *(pa.array([x[at[g] : at[g + 1]].tobytes() for g in held], pa.binary()) for x in (h, doc))],
                    names=["grp", "block", "toks", "marks"],
                )
        give_back()

    return rows.select("_i", mark, "_w").mapInArrow(work, "grp int, block long, toks binary, marks binary")


def pair_evidence(asked: DataFrame, taught: DataFrame, d: int, part: int, parts: int, groups: int, n_spam: int, n_ham: int) -> DataFrame:
    """(_i, n_tokens, _spam, _ham) of rows with telling pairs of one distance and part: `evidence`, joined within groups of hashes.

    A group's pairs are as many on average whatever the corpus; a pair that all rows hold makes one larger by an entry a row.
    """
    import pyarrow as pa

    weight = PAIR_WEIGHTS[d - 1]
    sums = "block long, docs binary, counts binary, spam binary, ham binary"

    def join(table):
        out = [[] for _ in range(5)]
        learnt = table.filter(pa.compute.is_null(table.column("block")))
        toks = np.frombuffer(b"".join(learnt.column("toks").to_pylist()), np.uint64)
        order = np.argsort(toks, kind="stable")
        toks = toks[order]
        start = np.flatnonzero(np.r_[True, toks[1:] != toks[:-1]][: toks.size])
        if start.size:
            spam = np.add.reduceat(np.frombuffer(b"".join(learnt.column("marks").to_pylist()), np.uint8)[order].astype(np.int64), start)
            toks, seen = toks[start], np.diff(np.r_[start, toks.size]).astype(float)
            s, h = spam / max(1.0, float(n_spam)), (seen - spam) / max(1.0, float(n_ham))
            trust = weight * seen / (1 + weight * seen)
            p = (trust * PRIOR + seen * (s / (s + h))) / (trust + seen)
            tells = np.abs(p - 0.5) >= SILENT
            p = np.clip(p, 1e-6, 1 - 1e-6)[tells]
            toks, for_spam, for_ham = toks[tells], -np.log(p), -np.log(1 - p)
        rows = table.filter(pa.compute.is_valid(table.column("block")))
        for block, mine, docs in zip(rows.column("block").to_pylist(), rows.column("toks").to_pylist(), rows.column("marks").to_pylist()):
            if not toks.size:
                break
            mine, docs = np.frombuffer(mine, np.uint64), np.frombuffer(docs, np.uint16)
            at = np.minimum(np.searchsorted(toks, mine), toks.size - 1)
            hit = np.flatnonzero(toks[at] == mine)
            if not hit.size:
                continue
            at, docs = at[hit], docs[hit]
            n = np.bincount(docs)
            told = np.flatnonzero(n)
            for c, v in zip(out, (block, told.astype(np.uint16), n[told].astype(np.uint32), *(np.bincount(docs, x[at])[told] for x in (for_spam, for_ham)))):
                c.append(v if c is out[0] else v.tobytes())
        give_back()
        return pa.table([pa.array(out[0], pa.int64()), *(pa.array(c, pa.binary()) for c in out[1:])], names=["block", "docs", "counts", "spam", "ham"])

    def add(table):
        docs, counts, spam, ham = (np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in (("docs", np.uint16), ("counts", np.uint32), ("spam", float), ("ham", float)))
        n = np.bincount(docs, counts).astype(np.int64)
        told = np.flatnonzero(n)
        first = table.column("block")[0].as_py()
        return pa.table([pa.array(told + first, pa.int64()), pa.array(n[told]), *(pa.array(np.bincount(docs, x)[told], pa.float64()) for x in (spam, ham))], names=["_i", "n_tokens", "_spam", "_ham"])

    entries = pair_entries(asked, "_i", d, part, parts, groups).unionByName(pair_entries(taught, "is_spam", d, part, parts, groups))
    found = entries.groupBy("grp").applyInArrow(join, sums)
    return found.groupBy("block").applyInArrow(add, "_i long, n_tokens long, _spam double, _ham double")


def fisher_of_pairs(docs: DataFrame, labelled: DataFrame, n_spam: int, n_ham: int, key: str) -> DataFrame:
    """What `fisher` gives for docs (key, text) with the weighted pairs of their words, learnt from labelled (text, is_spam).

    Texts are cut into words once, kept as 64-bit hashes. Pairs of one distance, and of one part of their first words, are dealt at
    a time, packed by blocks of rows and ranges of hashes; a part leaves one row a document, and its shuffle files go before the
    next is dealt. So disk holds a part of the pairs, never all.
    """
    asked, taught = hashed_words(docs, key), hashed_words(labelled.where("is_spam is not null"), "is_spam")
    n = sum(t.agg(F.sum("_n")).first()[0] or 0 for t in (asked, taught))
    parts = 1 if n <= WORDS_AT_ONCE else SLICES if n <= MANY_WORDS else 2 * SLICES
    groups = max(LEAST_GROUPS, -(-n // (parts * ENTRIES)))
    turns = [(d, part) for d in range(1, len(PAIR_WEIGHTS) + 1) for part in range(parts)]
    found = stage_parts((pair_evidence(asked, taught, d, part, parts, groups, n_spam, n_ham) for d, part in turns), "evidence")
    none = asked.select("_i", F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).alias("_spam"), F.lit(0.0).alias("_ham"))
    sums = none.unionByName(found).groupBy("_i").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "_spam", "_ham")))
    # rows that share a key are one document, as in `fisher`
    sums = stage(asked.select(key, "_i").join(sums, "_i").groupBy(key).agg(*(F.sum(c).alias(c) for c in ("n_tokens", "_spam", "_ham"))), "evidence")
    unstage(asked, taught, found)
    return combined(sums, n_spam, n_ham, key)


def sharpened(p: Column, power: int = SHARPNESS) -> Column:
    """struct(symbol, multiplier) of a probability: certainty beyond even odds to the power, so that only near certainty weighs."""
    return F.when(p > 0.5, F.struct(F.lit("BAYES_SPAM").alias("symbol"), F.pow((p - 0.5) * 2, F.lit(power)).alias("multiplier"))).when(p < 0.5, F.struct(F.lit("BAYES_HAM").alias("symbol"), F.pow((0.5 - p) * 2, F.lit(power)).alias("multiplier")))


def symbols(messages: DataFrame, stats: DataFrame, n_spam: int, n_ham: int) -> DataFrame:
    """(message_id, symbol, multiplier, options) of messages (message_id, text), for `scan`; long enough ones only."""
    words_of = words(F.col("text"))
    found = fisher(messages.where(F.size(words_of) >= R.LEARN_TOKENS), stats, n_spam, n_ham, "message_id", weighted_pairs(words_of))
    told = found.withColumn("_s", sharpened(F.col("probability"))).where("_s is not null")
    return told.select("message_id", "_s.symbol", "_s.multiplier", F.array(F.format_string("%.2f%%", F.col("probability") * 100)).alias("options"))
