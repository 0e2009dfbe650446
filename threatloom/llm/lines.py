"""Line dedup: a suffix array over line-ID sequences, built by distributed prefix doubling.

A document is the sequence of its non-blank lines. Doubling ranks the suffixes by their first 1, 2, 4, ... lines; at
each step a suffix that shares its rank with no other has no repeat of that depth and leaves, so only repeated runs
travel on. A longest-common-prefix interval of the array is a set of suffixes that share a rank. A repeated run counts
when its lines hold at least ``min_chars`` characters; every maximal repeated run is the union of its minimal windows
(the shortest stretch from a line on that holds min_chars), and the interval of a window of n lines, 2^k <= n < 2^(k+1),
is named by the depth-2^k ranks at its two ends. In each interval the first copy in (doc_id, line) order stays and the
lines of later copies are deleted; overlapping copies inside one document count too.

Edge cases: null text is a document without lines and stays null; blank lines never match and are never deleted;
documents are told apart by (doc_id, text), so repeated rows are one document and get the same result; a null doc_id is
a value of its own and comes first; an empty table gives an empty result; extra columns pass through untouched, but for
those named as the three that are added, which the new ones replace.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threatloom.runtime import give_back, ship, stage, unstage

MIN_CHARS = 150
BLANK = " \t\n\x0b\x0c\r"
LINES = "_d long, _t long, _i int, _p int, _w int, _h1 long, _h2 long"
_KEY = ["_d", "_t", "_i"]
ADDED = ("_n_lines", "_n_removed", "_n_runs")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row per non-blank line: its document, index, place in the text, 128-bit id and the lines of its minimal window."""
    import pyarrow as pa

    ship(docs.sparkSession)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    names = [x.split()[0] for x in LINES.split(", ")]
    per_batch = 20_000

    def rows(batches):
        cols: tuple[list, ...] = tuple([] for _ in names)

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
            for c in cols:
                c.clear()
            return out

        for batch in batches:
            for d, t, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                lines = [(p, x) for p, x in enumerate((text or "").split("\n")) if x.strip(BLANK)]
                end = held = 0
                for i, (p, line) in enumerate(lines):
                    while end < len(lines) and held < min_chars:
                        held += len(lines[end][1])
                        end += 1
                    v = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
                    width = end - i if held >= min_chars else 0
                    for c, x in zip(cols, (d, t, i, p, width, _signed(v >> 64), _signed(v & (1 << 64) - 1)), strict=True):
                        c.append(x)
                    held -= len(line)
                if len(cols[0]) >= per_batch:
                    yield flush()
        yield flush()
        give_back()

    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_d"), F.xxhash64("text").alias("_t"), "text"
    ).mapInArrow(rows, LINES)


def _rank(classes: DataFrame, keys: list[str]) -> DataFrame:
    """Dense ranks of classes in key order: range-sorted, with each partition starting where the earlier ones end."""
    spark = classes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = stage(classes.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()), "line-classes")
    sizes = {r["_part"]: r["n"] for r in ordered.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    start, starts = 0, []
    for k in sorted(sizes):
        starts.append((k, start))
        start += sizes[k]
    first = spark.createDataFrame(starts or [(0, 0)], "_part int, _start long")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return ordered.withColumn("_local", local).join(F.broadcast(first), "_part").select(*keys, (F.col("_start") + F.col("_local")).alias("_r"))


def repeated_windows(docs: DataFrame, min_chars: int = MIN_CHARS) -> tuple[DataFrame, list[DataFrame]]:
    """Later copies of repeated minimal windows: (_d, _t, _i, _w); and staged tables to drop once that is used."""
    lines = stage(_line_rows(docs, min_chars), "lines")
    where = F.struct(*_KEY)

    def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
        """Classes with two places at least; min and max, not count, so a repeated row is no second place."""
        return rows.groupBy(*keys).agg(F.min(where).alias("_first"), F.max(where).alias("_last")).where("_first != _last")

    first = _rank(repeated(lines, ["_h1", "_h2"]).select("_h1", "_h2"), ["_h1", "_h2"])
    at = stage(lines.join(first, ["_h1", "_h2"]).select(*_KEY, "_w", "_p", "_r").dropDuplicates(_KEY), "suffixes")
    held, found, depth = [lines, at], [], 1
    while True:
        # windows of depth..2*depth-1 lines end here: named by the ranks at their two ends
        here = at.where(F.col("_w").between(depth, 2 * depth - 1))
        tail = at.select("_d", "_t", F.col("_i").alias("_j"), F.col("_r").alias("_r2"))
        if depth == 1:
            window = here.select(*_KEY, "_w", F.col("_r").alias("_ra"), F.col("_r").alias("_rb"))
        else:
            window = (
                here.withColumn("_j", F.col("_i") + F.col("_w") - depth)
                .join(tail, ["_d", "_t", "_j"])
                .select(*_KEY, "_w", F.col("_r").alias("_ra"), F.col("_r2").alias("_rb"))
            )
        classes = repeated(window, ["_w", "_ra", "_rb"]).select("_w", "_ra", "_rb", "_first")
        found.append(window.join(classes, ["_w", "_ra", "_rb"]).where(where != F.col("_first")).select(*_KEY, "_w"))
        if not at.where(F.col("_w") >= 2 * depth).limit(1).count():
            break
        # suffixes of longer windows, and those their ends need, go on with the rank of twice the depth
        pairs = at.withColumn("_j", F.col("_i") + depth).join(tail, ["_d", "_t", "_j"]).select(*_KEY, "_w", "_p", F.col("_r").alias("_r1"), "_r2")
        ranks = _rank(repeated(pairs, ["_r1", "_r2"]).select("_r1", "_r2"), ["_r1", "_r2"])
        at = stage(pairs.join(ranks, ["_r1", "_r2"]).select(*_KEY, "_w", "_p", "_r"), "suffixes")
        held.append(at)
        depth *= 2
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return stage(out, "windows"), held


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the lines of later copies deleted from ``text``, and _n_lines, _n_removed, _n_runs beside its columns.

    _n_runs counts the stretches of deleted lines; blank lines do not part a stretch.
    """
    windows, held = repeated_windows(docs, min_chars)
    lines, at = held[0], held[1]
    unstage(*held[2:])
    # deleted lines per document: the union of its windows
    span = windows.groupBy("_d", "_t", "_i").agg(F.max("_w").alias("_w"))
    gone = (
        span.select("_d", "_t", F.explode(F.expr("sequence(_i, _i + _w - 1)")).alias("_i"))
        .distinct()
        .join(at.select(*_KEY, "_p"), _KEY)
    )
    gone = gone.groupBy("_d", "_t").agg(F.sort_array(F.collect_list(F.struct("_i", "_p"))).alias("_gone"))
    mine = [c for c in docs.columns if c not in ADDED]
    row, d, t, gone_at = (f"_threatloom_{k}" for k in ("row", "d", "t", "gone"))
    keyed = docs.select(F.struct(*mine).alias(row), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias(d), F.xxhash64("text").alias(t))
    found = keyed.join(gone.select(F.col("_d").alias(d), F.col("_t").alias(t), F.col("_gone").alias(gone_at)), [d, t], "left")
    found = found.select(row, F.col(gone_at).alias("gone"), F.split(F.col(row)["text"], "\n", -1).alias("parts"))
    # the places that stay, by a hash set, so a document costs its lines once
    stay = "array_except(sequence(0, size(parts) - 1), transform(gone, g -> g._p))"
    text = F.expr(f"case when gone is null then {row}.text else array_join(transform({stay}, k -> parts[k]), '\n') end")
    return found.select(
        *((text if c == "text" else F.col(row)[c]).alias(c) for c in mine),
        F.when(F.col(row)["text"].isNull(), 0).otherwise(F.size(F.filter("parts", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))).cast("long").alias("_n_lines"),
        F.expr("case when gone is null then 0 else size(gone) end").cast("long").alias("_n_removed"),
        F.expr("case when gone is null then 0 else 1 + size(filter(sequence(1, size(gone)), k -> k > 1 and gone[k - 1]._i - gone[k - 2]._i > 1)) end").cast("long").alias("_n_runs"),
    )


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.col("_n_runs").alias("n_runs"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"),
        F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"),
    )


OP6_SQL = f"""
WITH raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
l AS (SELECT doc_id, pos, line, length(line) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS idx
      FROM raw WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY idx) AS e FROM l),
w AS (SELECT a.doc_id, a.idx, min(b.idx) AS j FROM c a JOIN c b
      ON a.doc_id = b.doc_id AND b.idx >= a.idx AND b.e - a.e + a.n >= {MIN_CHARS} GROUP BY 1, 2),
k AS (SELECT w.doc_id, w.idx, w.j, string_agg(l.line, chr(10) ORDER BY l.idx) AS t FROM w JOIN l
      ON l.doc_id = w.doc_id AND l.idx BETWEEN w.idx AND w.j GROUP BY 1, 2, 3),
f AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, idx) AS rn FROM k),
rm AS (SELECT DISTINCT l.doc_id, l.idx, l.pos FROM f JOIN l ON l.doc_id = f.doc_id AND l.idx BETWEEN f.idx AND f.j WHERE rn > 1),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE prev IS NULL OR idx - prev > 1) AS n_runs
         FROM (SELECT doc_id, idx, lag(idx) OVER (PARTITION BY doc_id ORDER BY idx) AS prev FROM rm) GROUP BY 1),
kept AS (SELECT raw.doc_id, string_agg(raw.line, chr(10) ORDER BY raw.pos) AS t
         FROM raw LEFT JOIN rm ON rm.doc_id = raw.doc_id AND rm.pos = raw.pos WHERE rm.pos IS NULL GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY 1)
SELECT d.doc_id, coalesce(n.n_lines, 0) AS n_lines, coalesce(runs.n_removed, 0) AS n_removed, coalesce(runs.n_runs, 0) AS n_runs,
       length(coalesce(kept.t, '')) AS kept_chars, md5(coalesce(kept.t, '')) AS kept_md5
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN runs ON runs.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
