"""Source divergence audit: how differently the sources of a language use words, from joint histograms of counts.

Terms are runs of letters and of anything beyond ASCII, in lower case; a language keeps the terms of at least MIN_DOCS of
its documents. A pair of sources is compared over all kept terms, most of which have the same few counts in both: so the
pair's distinct (count, count) combinations are tallied, and the difference of the two smoothed shares is evaluated once
per combination and multiplied. Terms that neither source holds are one implied combination, (0, 0), whose multiplicity
is what the tally leaves of the vocabulary.

Words are counted in the tasks that read the texts and leave them as sums by language, source and term. The tally deals a
language's terms over hashed buckets, so a language with most of the rows is split, and its sources over blocks of
SOURCE_BLOCK, so a task holds bounded matrices however many sources there are. Only combinations leave the tasks, summed.

Edge cases: null text, language and source are empty ones; a language without kept terms has its groups' pairs, with value
0, and no terms; a group without terms has the smoothing's share of every term; repeated rows are documents of their own;
a language with one source has no pairs; equal values rank by item in UTF-8 order; an empty table gives an empty result;
extra columns are ignored. Shares are whole numbers of decimal(38) arithmetic, exact to counts of 10^17.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.runtime import give_back, ship, stage, table

MIN_DOCS, SMOOTHING, SCALE, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: Entries that a task of the word count holds; sources of a block; (term, source) entries of a bucket on average.
HELD_TERMS, SOURCE_BLOCK, BUCKET_ENTRIES = 300_000, 64, 20_000
#: A-Z to lower case; what isn't a letter or beyond ASCII to a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents by language, source and term (UTF-8 bytes), summed within
    each task only. docs: lang, source, text."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def count(batches):
        occurrences: dict[tuple, Counter] = {}
        within: dict[tuple, Counter] = {}
        held = 0

        def rows():
            for (lang, source), terms in occurrences.items():
                keys, holders = list(terms), within[lang, source]
                for i in range(0, len(keys), 50_000):
                    some = keys[i : i + 50_000]
                    names = [pa.array([v] * len(some), pa.string()) for v in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*names, pa.array(some, pa.binary()), pa.array([terms[k] for k in some], pa.int64()), pa.array([holders[k] for k in some], pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = text.translate(FOLD).split()
                mine = occurrences.setdefault((lang, source), Counter())
                held -= len(mine)
                mine.update(words)
                held += len(mine)
                within.setdefault((lang, source), Counter()).update(set(words))
            if held > HELD_TERMS:
                yield from rows()
                occurrences, within, held = {}, {}, 0
        yield from rows()
        give_back()

    return docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(count, "lang string, source string, term binary, n long, docs long")


def tally(codes: np.ndarray, kinds: int, left: list[int], right: list[int]):
    """(left source, right source, code, code, multiplicity) of the combinations of two columns of codes; code 0 stands
    for a count of 0, and terms of which neither column has any are left out."""
    for i in left:
        for j in right:
            if i >= j:
                continue
            a, b = codes[:, i], codes[:, j]
            some = (a > 0) | (b > 0)
            found, times = np.unique(a[some].astype(np.int64) * kinds + b[some], return_counts=True)
            yield i, j, found // kinds, found % kinds, times


def joint_counts(counts: DataFrame, sources: DataFrame) -> DataFrame:
    """(lang, s1, s2, c1, c2, times): terms by their counts in two sources of a language, s1 < s2, without (0, 0).

    counts: lang, term, s, n > 0; sources: lang, n_sources, entries.
    """
    block = lambda c: F.floor(c / SOURCE_BLOCK).cast("int")
    rows = counts.join(sources, "lang").select(
        "lang", "term", "s", "n", "n_sources", block(F.col("s")).alias("_own"), F.pmod(F.xxhash64("term"), F.ceil(F.col("entries") / BUCKET_ENTRIES)).alias("_bucket"),
        F.explode(F.sequence(F.lit(0), block(F.col("n_sources") - 1))).alias("_other"),
    )
    rows = rows.select("lang", "term", "s", "n", "n_sources", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_bucket")

    def of(key, group):
        import pandas as pd

        # a column for every source of both blocks, also for those without any entry here
        side = lambda b: list(range(b * SOURCE_BLOCK, min((b + 1) * SOURCE_BLOCK, int(group["n_sources"].iloc[0]))))
        names = np.array(sorted({*side(key[1]), *side(key[2])}))
        at = {s: k for k, s in enumerate(names.tolist())}
        terms = pd.factorize(group["term"])[0]
        values, codes = np.unique(np.append(group["n"].to_numpy(), 0), return_inverse=True)
        filled = np.zeros((terms.max() + 1, len(names)), np.int32)
        filled[terms, np.searchsorted(names, group["s"].to_numpy())] = codes[:-1]
        found = tally(filled, len(values), [at[s] for s in side(key[1])], [at[s] for s in side(key[2])])
        parts = [pd.DataFrame({"s1": names[i], "s2": names[j], "c1": values[a], "c2": values[b], "times": times}) for i, j, a, b, times in found]
        out = pd.concat(parts) if parts else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("s1", "s2", "c1", "c2", "times")})
        out.insert(0, "lang", key[0])
        return out

    found = rows.groupBy("lang", "_i", "_j", "_bucket").applyInPandas(of, "lang string, s1 int, s2 int, c1 long, c2 long, times long")
    return found.groupBy("lang", "s1", "s2", "c1", "c2").agg(F.sum("times").alias("times"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * terms)); null where nothing is kept."""
    whole = lambda c: c.cast("decimal(18,0)")
    above = F.lit(SCALE).cast("decimal(10,0)") * whole(count + SMOOTHING)
    below = F.nullif(whole(total + SMOOTHING * terms), F.lit(0).cast("decimal(18,0)"))
    return F.call_function("div", above, below) + 1


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (text, lang, source): part `pair` ranks the other sources of a
    language by the summed difference of shares, part `term` the terms that a source uses most beyond its language."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    # a term's rows meet once: its sums by source, then its documents over the language
    held = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    held = held.withColumn("docs", F.sum("docs").over(Window.partitionBy("lang", "term"))).where(F.col("docs") >= min_docs)
    kept = stage(held.select("lang", "source", "term", "n"), "kept-terms")
    size = kept.groupBy("lang").agg(F.count("*").alias("entries"), F.count_distinct("term").alias("terms"), F.sum("n").alias("lang_total"))
    used = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.groupBy("lang", "source").agg(F.lit(1).alias("_one")).drop("_one").join(used, ["lang", "source"], "left").join(size, "lang", "left")
    groups = groups.select(
        "lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "entries", "terms", "lang_total")),
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("s"), F.count("*").over(Window.partitionBy("lang")).alias("n_sources"),
    )
    groups = stage(groups, "groups")  # one row per language and source
    numbered = kept.join(groups.select("lang", "source", "s"), ["lang", "source"]).drop("source")
    joint = joint_counts(numbered, groups.select("lang", "n_sources", "entries").distinct())
    # f once per combination, times its multiplicity
    one = groups.select("lang", F.col("s").alias("s1"), F.col("source").alias("source1"), F.col("total").alias("total1"), "terms")
    two = groups.select("lang", F.col("s").alias("s2"), F.col("source").alias("source2"), F.col("total").alias("total2"))
    gap = lambda a, b: F.abs(share(a, F.col("total1"), F.col("terms")) - share(b, F.col("total2"), F.col("terms")))
    summed = joint.join(one, ["lang", "s1"]).join(two, ["lang", "s2"]).groupBy("lang", "s1", "s2").agg(F.sum(gap(F.col("c1"), F.col("c2")) * F.col("times")).alias("value"), F.sum("times").alias("times"))
    pairs = one.join(two, "lang").where("s1 < s2").join(summed, ["lang", "s1", "s2"], "left")
    neither = F.col("terms") - F.coalesce("times", F.lit(0))
    value = F.coalesce("value", F.lit(0)) + F.when(neither > 0, neither * gap(F.lit(0), F.lit(0))).otherwise(0)
    ends = F.array(*(F.struct(F.col(a).alias("source"), F.col(b).alias("item")) for a, b in (("source1", "source2"), ("source2", "source1"))))
    pair = pairs.select("lang", value.cast("long").alias("value"), F.explode(ends).alias("_e")).select("lang", "_e.source", "_e.item", "value")
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by).alias("rank"))
    # terms: a source's share above its language's
    whole = kept.join(kept.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")), ["lang", "term"]).join(groups, ["lang", "source"])
    above = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    term = whole.select("lang", "source", F.col("term").alias("item"), above.cast("long").alias("value")).where("value > 0")
    term = term.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return pair.unionByName(term.select("lang", "source", F.lit("term").alias("part"), F.col("item").cast("string").alias("item"), "value", "rank"))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
), w AS (SELECT k, lang, source, unnest(words) AS term FROM d
), v AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 30
), g AS (SELECT DISTINCT lang, source FROM d
), vn AS (SELECT lang, count(*)::HUGEINT AS v FROM v GROUP BY lang
), c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM w JOIN v USING (lang, term) GROUP BY ALL
), n AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, v.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 5)) // (n.n + 5 * vn.v) AS p
  FROM g JOIN v ON v.lang = g.lang JOIN vn ON vn.lang = g.lang JOIN n ON n.lang = g.lang AND n.source = g.source
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
), q AS (
  SELECT lang, term, 1 + (1000000000 * (sum(c) + 5)) // (sum(sum(c)) OVER (PARTITION BY lang) + 5 * any_value(vn.v)) AS q
  FROM c JOIN vn USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(p.p - o.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN p ON p.lang = a.lang AND p.source = a.source
    LEFT JOIN p o ON o.lang = b.lang AND o.source = b.source AND o.term = p.term
  GROUP BY ALL
), terms AS (
  SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms
QUALIFY rank <= 50
"""
