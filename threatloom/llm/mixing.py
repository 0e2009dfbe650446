"""Mixing to target weights: iterative proportional fitting of token weights, then sampling with calibrated probabilities.

Documents are counted into (source, lang, topic) cells, pre-aggregated. Raking scales the cells' token weights in turn to
the target share of every source, language and topic until all three marginals hold. A token budget then fixes one factor
for all cells, so that a cell's probability is min(1, factor * weight / tokens), and a document stays if the hash of its
doc_id, a uniform number, lies under its cell's probability. Cells, not documents, are iterated on: up to ``MAX_CELLS`` on
the driver (the count is checked), beyond that as tables with the same arithmetic.

Edge cases: null source, lang or topic are a value of their own, the empty string; null and empty texts have no tokens
and take their cell's probability (1 where a cell has none); a null doc_id hashes to 0 and stays; rows that repeat a
doc_id are kept or dropped together; an empty table gives an empty result; target values that no document has are ignored
and the other shares rescaled; extra columns pass through, but for n_tokens, p and kept, which the new ones replace, and
topic, which is taken where docs have it. Where probabilities are cut at 1 the budget is filled from the other cells, and
the shares that are then reached fall short of the targets; ``shares`` tells them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.runtime import stage, unstage

DIMS = ("source", "lang", "topic")
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
ROUNDS = 200
TOLERANCE = 1e-10
FILLS = 12
BUDGET = 0.5
MAX_CELLS = 200_000
TOPIC_SQL = """CASE WHEN text IS NULL THEN '' WHEN text LIKE '%icense%' THEN 'licence' WHEN text LIKE '%@%' THEN 'contact'
 WHEN text LIKE '% | %' THEN 'table' WHEN text LIKE '%!!%' THEN 'shouting' ELSE 'prose' END"""


def unit_hash(doc_id: Column) -> Column:
    """52 bits of the id's MD5 as a number in [0, 1)."""
    return F.coalesce(F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 13), 16, 10).cast("double") / float(16**13), F.lit(0.0))


def cells_of(docs: DataFrame) -> DataFrame:
    return docs.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens"))


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target shares proportional to a power of the tokens: below 1 it lifts the small."""
    return cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("share"))


def _rake_local(cells: list, targets: dict[str, dict], budget: float, rounds: int) -> list[float]:
    t = np.array([float(r["tokens"]) for r in cells])
    w, total = t.copy(), t.sum()
    codes = {}
    for d in DIMS:
        values = sorted({r[d] for r in cells})
        share = np.array([float(targets[d].get(v, 0.0)) for v in values])
        at = {v: i for i, v in enumerate(values)}
        codes[d] = (np.array([at[r[d]] for r in cells], int), share / share.sum() if share.sum() else share)
    for _ in range(rounds):
        off = 0.0
        for d in DIMS:
            code, share = codes[d]
            s = np.bincount(code, weights=w, minlength=share.size)
            off = max(off, np.abs(s - share * total)[s > 0].max(initial=0.0))
            w = w * (share[code] * total / np.where(s[code] > 0, s[code], 1.0))
        if off <= TOLERANCE * total:
            break
    r = np.where(t > 0, w / np.where(t > 0, t, 1), 0)
    goal, f = budget * total, budget * total / w.sum() if w.sum() else 0.0
    for _ in range(FILLS):
        full = r * f >= 1
        if not w[~full].sum():
            break
        f = (goal - t[full].sum()) / w[~full].sum()
    return np.where(t > 0, np.minimum(1.0, r * f), 1.0).tolist()


def _rake_table(cells: DataFrame, targets: dict[str, DataFrame], budget: float, rounds: int) -> DataFrame:
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    held = stage(cells.withColumn("w", F.col("tokens").cast("double")), "cells")
    shares = {}
    for d in DIMS:
        here = targets[d].join(cells.select(d).distinct(), d)
        s = here.agg(F.sum("share")).first()[0] or 1.0
        shares[d] = here.select(d, (F.col("share") / s).alias("share"))
    for _ in range(rounds):
        old, off = held, []
        for d in DIMS:
            sums = held.groupBy(d).agg(F.sum("w").alias("s"))
            off.append(sums.join(shares[d], d).select(F.abs(F.col("s") - F.col("share") * total).alias("off")))
            held = held.join(sums, d).join(shares[d], d, "left").withColumn("w", F.col("w") * (F.coalesce("share", F.lit(0.0)) * total / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0))).select(*DIMS, "tokens", "w")
        far = off[0].unionByName(off[1]).unionByName(off[2]).agg(F.max("off")).first()[0] or 0.0
        held = stage(held, "cells")
        unstage(old)
        if far <= TOLERANCE * total:
            break
    r = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0)
    w = held.agg(F.sum("w")).first()[0] or 0.0
    f = budget * total / w if w else 0.0
    for _ in range(FILLS):
        full = r * f >= 1
        row = held.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("t"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("w")).first()
        if not row["w"]:
            break
        f = (budget * total - row["t"]) / row["w"]
    return held.select(*DIMS, F.when(F.col("tokens") > 0, F.least(F.lit(1.0), r * f)).otherwise(1.0).alias("p"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, rounds: int = ROUNDS, max_cells: int = MAX_CELLS) -> DataFrame:
    """docs with topic, n_tokens, p and kept added. targets: per dimension a table of (value, share); default: tempered."""
    spark = docs.sparkSession
    docs = docs.drop("n_tokens", "p", "kept")
    mine = docs.withColumns({"topic": F.expr(TOPIC_SQL) if "topic" not in docs.columns else F.col("topic"), "n_tokens": F.coalesce(F.expr(r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')"), F.lit(0)).cast("long")})
    cell = {d: f"_threatloom_{d}" for d in DIMS}
    mine = mine.withColumns({v: F.coalesce(F.col(d).cast("string"), F.lit("")) for d, v in cell.items()})
    cells = stage(cells_of(mine.select(*(F.col(v).alias(d) for d, v in cell.items()), "n_tokens")), "cells")
    targets = {d: (targets or {}).get(d, tempered(cells, d, POWERS[d])) for d in DIMS}
    n = cells.count()
    if n <= max_cells:
        rows = cells.orderBy(*DIMS).collect()
        local = {d: {r[0]: r[1] for r in targets[d].join(cells.select(d).distinct(), d).select(d, "share").collect()} for d in DIMS}
        p = _rake_local(rows, local, budget, rounds) if rows else []
        table = spark.createDataFrame([(*(r[d] for d in DIMS), v) for r, v in zip(rows, p, strict=True)], ", ".join(f"{v} string" for v in cell.values()) + ", p double")
        table = F.broadcast(table)
    else:
        table = _rake_table(cells, targets, budget, rounds).select(*(F.col(d).alias(v) for d, v in cell.items()), "p")
    out = mine.join(table, list(cell.values()), "left").withColumn("kept", unit_hash(F.col("doc_id")) < F.col("p"))
    return out.select(*docs.columns, *(["topic"] if "topic" not in docs.columns else []), "n_tokens", "p", "kept")


def shares(mixed: DataFrame, dim: str) -> DataFrame:
    """(dim, share, expected): the share of the tokens of mix's result that a value has before and after sampling."""
    by = mixed.groupBy(dim).agg(F.sum("n_tokens").alias("all"), F.sum(F.col("n_tokens") * F.col("p")).alias("kept"))
    total = by.agg(F.sum("all").alias("all"), F.sum("kept").alias("kept")).first()
    part = lambda c: F.col(c) / F.lit(float(total[c] or 1))
    return by.select(dim, part("all").alias("share"), part("kept").alias("expected"))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("p", 6).alias("p"), "kept")


def mixing_ctes(documents: str, budget: float = BUDGET, rounds: int = 20) -> str:
    """The operator's arithmetic as DuckDB CTEs over a relation of documents; the last is `mixed`."""
    out = [
        f"md AS MATERIALIZED (SELECT *, coalesce(source, '') AS s0, coalesce(lang, '') AS l0, {TOPIC_SQL} AS topic, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens FROM {documents})",
        "mc AS MATERIALIZED (SELECT s0 AS source, l0 AS lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM md GROUP BY ALL)",
        "mt AS MATERIALIZED (SELECT sum(tokens) AS total FROM mc)",
    ]
    for d in DIMS:
        out.append(f"m_{d} AS MATERIALIZED (SELECT {d}, pow(t, {POWERS[d]}) / sum(pow(t, {POWERS[d]})) OVER () AS share FROM (SELECT {d}, sum(tokens) AS t FROM mc GROUP BY 1))")
    last = "(SELECT *, tokens AS w FROM mc)"
    for i in range(rounds):
        for d in DIMS:
            name = f"m{i}_{d}"
            out.append(f"{name} AS MATERIALIZED (SELECT x.source, x.lang, x.topic, x.tokens, x.w * (g.share * mt.total / s.s) AS w FROM {last} x JOIN (SELECT {d}, CASE WHEN sum(w) > 0 THEN sum(w) ELSE 1.0 END AS s FROM {last} GROUP BY 1) s USING ({d}) JOIN m_{d} g USING ({d}) CROSS JOIN mt)")
            last = name
    out.append(f"f0 AS MATERIALIZED (SELECT {budget} * (SELECT total FROM mt) / sum(w) AS f FROM {last})")
    for i in range(FILLS):
        out.append(f"f{i + 1} AS MATERIALIZED (SELECT coalesce(({budget} * (SELECT total FROM mt) - coalesce(sum(tokens) FILTER (WHERE w / tokens * f0.f >= 1), 0)) / nullif(sum(w) FILTER (WHERE NOT w / tokens * f0.f >= 1), 0), any_value(f0.f)) AS f FROM {last} CROSS JOIN f{i} f0 WHERE tokens > 0)")
    out.append(f"mp AS MATERIALIZED (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(1.0, w / tokens * f) ELSE 1.0 END AS p FROM {last} CROSS JOIN f{FILLS})")
    out.append("mixed AS (SELECT md.*, mp.p, coalesce(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0, 0.0) < mp.p AS kept FROM md JOIN mp ON mp.source = md.s0 AND mp.lang = md.l0 AND mp.topic = md.topic)")
    return ",\n".join(out)


OP9_SQL = f"WITH {mixing_ctes('documents')}\nSELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS p, kept FROM mixed"
