"""Hard-negative mining: every anchor's integer scores against all rows, fully sorted in blocks of rows.

The anchors are a stated query set, taken in chunks of bounded bytes. A task holds one block of rows at a time: it computes
the block's integer scores, sorts them for every anchor by (score descending, id), finds each positive's upper limit by
binary search and reads the first k entries of another label from there down to the lower limit. The first k of the whole
table are among the first k of its blocks, so a rank over the blocks' entries gives the exact result; what is shuffled is
at most k entries per anchor, positive and block. The positives, needed first, are found by the same sort over the rows of
the anchor's own label. Nothing but a chunk of anchors and its positives is ever held by the driver.

Edge cases: rows with a null label, a null vector, or a null or non-finite component take no part. Null ids stay, never
are anchors, and come last among equal scores. Rows that repeat an id are rows of their own (an anchor excludes itself,
not its namesakes). Ties go by the smaller id; rows equal in score, id and label can't be told apart in the result. Vectors
of unequal length are compared as if the shorter one ended in zeros; an empty vector scores 0. Scores are exact at any
magnitude (beyond 2^53 by Python's integers) and held within the limits of a long. A label without other rows has no
positives and so no result rows; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.runtime import give_back, ship, stage, table, unstage

#: Bytes of anchors that a chunk holds, and of rows that a block holds.
CHUNK_BYTES, BLOCK_BYTES = 32 << 20, 32 << 20
#: Rows of a block and anchors scored at once at most: a matrix of 16 MB.
BLOCK_ROWS, ANCHORS_AT_ONCE = 8192, 256
LONGEST = np.int64(2**63 - 1)
FOUND = "_a int, _key long, id long, score long"
MINED = "_a int, _p int, _key long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def quantised(x: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x): whole doubles, or Python integers where a double overflows."""
    with np.errstate(over="ignore"):
        out = np.floor(x * float(scale))
    if np.isfinite(out).all():
        return out
    return np.array([math.floor(v * scale) if abs(v) < 2.0**53 else int(v) * scale for v in x.ravel()], dtype=object).reshape(x.shape)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with the rows of b, as longs."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if a.dtype != object and b.dtype != object and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: m if m.dtype == object else np.array([int(v) for v in m.ravel()], dtype=object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, -int(LONGEST), int(LONGEST)).astype(np.int64)


def matrix(vectors) -> np.ndarray:
    """An Arrow list column as a matrix; short vectors end in zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    wide = int(sizes.max(initial=0))
    if len(flat) == len(sizes) * wide:
        return quantised(flat.reshape(len(sizes), wide))
    out = np.zeros((len(sizes), wide))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return quantised(out)


def widened(m: np.ndarray, wide: int) -> np.ndarray:
    return m if m.shape[1] >= wide else np.hstack([m, np.zeros((len(m), wide - m.shape[1]), m.dtype)])


class Block:
    """Rows in (id, key) order, so that a stable sort by falling score is the sort by (score, id)."""

    def __init__(self, rows) -> None:
        import pyarrow.compute as pc

        ids = pc.fill_null(rows["vec_id"], int(LONGEST)).to_numpy(zero_copy_only=False)
        keys, labels = rows["_key"].to_numpy(zero_copy_only=False), rows["label"].to_numpy(zero_copy_only=False)
        order = np.lexsort((keys, ids))
        self.ids, self.keys, self.labels = ids[order], keys[order], labels[order]
        self.vectors = matrix(rows["embedding"].combine_chunks() if hasattr(rows["embedding"], "combine_chunks") else rows["embedding"])[order]

    def ranked(self, anchors: Block, of: np.ndarray, mine: np.ndarray):
        """Per anchor of `of`: its number and, over the rows `mine`, the order by (score, id) and the scores in that order."""
        wide = max(self.vectors.shape[1], anchors.vectors.shape[1])
        rows = widened(self.vectors[mine], wide)
        for i in range(0, len(of), ANCHORS_AT_ONCE):
            some = of[i : i + ANCHORS_AT_ONCE]
            found = scores(widened(anchors.vectors[some], wide), rows)
            order = np.argsort(-found, axis=1, kind="stable")
            for a, o, s in zip(some, order, found, strict=True):
                yield a, mine[o], s[o]

    def positives(self, anchors: Block, most: int):
        for label in np.intersect1d(self.labels, anchors.labels):
            for a, rows, s in self.ranked(anchors, np.flatnonzero(anchors.labels == label), np.flatnonzero(self.labels == label)):
                for r, v in [(r, v) for r, v in zip(rows[: most + 1], s, strict=False) if self.keys[r] != anchors.keys[a]][:most]:
                    yield a, self.keys[r], self.ids[r], v

    def negatives(self, anchors: Block, positives: list, most: int, low: int, high: int):
        held = np.array([len(p) > 0 for p in positives], bool)
        for label in np.unique(anchors.labels[held]):
            for a, rows, s in self.ranked(anchors, np.flatnonzero(held & (anchors.labels == label)), np.flatnonzero(self.labels != label)):
                # low * p <= 100 * n <= high * p, as bounds of the whole number n
                up = np.array([min(high * p // 100, int(LONGEST)) for _, p in positives[a]], np.int64)
                down = np.array([max(-(-low * p // 100), -int(LONGEST)) for _, p in positives[a]], np.int64)
                first, last = np.searchsorted(-s, -up, "left"), np.searchsorted(-s, -down, "right")
                for p, (f, t) in enumerate(zip(first, np.minimum(first + most, last), strict=True)):
                    for at in range(f, t):
                        yield a, p, self.keys[rows[at]], anchors.ids[a], positives[a][p][0], positives[a][p][1], self.ids[rows[at]], s[at]


def _blocks(batches, wide: int):
    """Blocks of a task's rows, bounded in rows and bytes."""
    import pyarrow as pa

    most, held, n = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(wide, 1)))), [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, most):
            part = batch.slice(i, most)
            if n + part.num_rows > most:
                yield Block(pa.Table.from_batches(held))
                held, n = [], 0
            held, n = [*held, part], n + part.num_rows
    if n:
        yield Block(pa.Table.from_batches(held))


def _sent(rows, schema: str):
    """Rows of longs as Arrow batches; the id that stands for null is null again."""
    import pyarrow as pa

    names = [(c.split()[0], pa.int32() if c.split()[1] == "int" else pa.int64()) for c in schema.split(", ")]
    held: list = []

    def batch():
        cols = [np.array(c, dtype=np.int64) for c in zip(*held, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, mask=(c == LONGEST) if n.endswith("id") else None).cast(k) for c, (n, k) in zip(cols, names, strict=True)], names=[n for n, _ in names])

    for row in rows:
        held.append(row)
        if len(held) >= 20_000:
            yield batch()
            held = []
    if held:
        yield batch()


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Hard negatives of the rows (vec_id, label, embedding) for which `anchors` is true.

    A row per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score. The
    positives are the first rows of the anchor's label, the negatives the first of other labels whose score lies between
    `low` and `high` percent of the positive's.
    """
    spark = rows.sparkSession
    ship(spark)
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd)
    held = stage(usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding", F.monotonically_increasing_id().alias("_key")), "vectors")
    asked = stage(held.where(anchors), "anchors")
    n, wide = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    chunks = -(-n // max(1, CHUNK_BYTES // (8 * max(wide or 1, 1))))
    done = [_mine_chunk(held, asked.where(F.pmod(F.xxhash64("_key"), F.lit(chunks)) == k), wide, positives, negatives, low, high) for k in range(chunks)]
    unstage(asked)
    if not done:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return spark.read.schema(done[0].schema).parquet(*[d._threatloom_path for d in done])


def _mine_chunk(held: DataFrame, asked: DataFrame, wide: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    sc = held.sparkSession.sparkContext
    chunk = Block(asked.toArrow())  # CHUNK_BYTES at most
    shared = sc.broadcast(chunk)

    def near(batches):
        for block in _blocks(batches, wide):
            yield from _sent(block.positives(shared.value, positives), FOUND)
        give_back()

    first = lambda keys, score, name: Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(name).asc_nulls_last(), "_key")
    own = held.mapInArrow(near, FOUND).withColumn("_r", F.row_number().over(first(["_a"], "score", "id"))).where(F.col("_r") <= positives)
    found: list = [[] for _ in chunk.ids]
    for a, _, i, s, _ in sorted(own.collect(), key=lambda r: (r["_a"], r["_r"])):  # `positives` rows an anchor of the chunk
        found[a].append((int(LONGEST) if i is None else i, s))
    known = sc.broadcast(found)

    def far(batches):
        for block in _blocks(batches, wide):
            yield from _sent(block.negatives(shared.value, known.value, negatives, low, high), MINED)
        give_back()

    ranked = held.mapInArrow(far, MINED).withColumn("rank", F.row_number().over(first(["_a", "_p"], "negative_score", "negative_id"))).where(F.col("rank") <= negatives)
    out = stage(ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")
    shared.unpersist()
    known.unpersist()
    return out


def relabelled(rows: DataFrame) -> DataFrame:
    """Every seventh id gets the next label, so that labels and vectors disagree somewhere."""
    label = F.col("label").cast("long")
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return mine(relabelled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH r AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.k AS ak, a.vec_id AS anchor_id, a.label = b.label AS same, b.k, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a, r b WHERE a.vec_id % 100 = 0 AND a.k <> b.k
), p AS (
  SELECT ak, anchor_id, k AS pk, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY ak ORDER BY score DESC, vec_id NULLS LAST, k) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (ak, anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY ak, pk ORDER BY s.score DESC, s.vec_id NULLS LAST, s.k)
QUALIFY row_number() OVER w <= 10
"""
