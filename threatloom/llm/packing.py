"""Best-fit packing: bulk-synchronous best-fit of token pieces into sequences of a fixed capacity.

Both sides are range-sorted by size. Lengths lie in 1..capacity, so the sorted sides are run-length coded: documents
as (length, how many), gaps as (size, first sequence, how many). A round sweeps both sides from large to small and
gives every document its successor, the smallest open gap that holds it; where several documents want one gap, rank
decides (longest first, then rank inside the length). Then the gaps are updated and the sweep repeats. The run tables
are bounded by the capacity and never by the corpus; what is distributed is the work on rows: token counting, the
histogram (pre-aggregated), ranks inside a length (dealt over hashed buckets, so a length that holds a third of all
pieces is split), and the lookup of every piece's place.

Edge cases: null text packs as empty (the closing id alone); repeated rows are packed once each; ties inside a length
are placed in (doc_id, piece) order within hashed buckets; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threatloom.runtime import give_back, ship, stage

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
CACHE_WORDS = 450_000
ROWS_PER_BUCKET = 20_000
_TOKENIZERS: dict = {}


class Encoder:
    """Token ids of whole texts through a bounded cache of blank-separated words.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids in order.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks = {c: array("I", self.tok.encode(c, add_special_tokens=False).ids).tobytes() for c in ".,"}

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        try:
            # Latin-1 text has no combining marks or context-sensitive capitals: lower case first means fewer words
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > CACHE_WORDS:
            # two generations: what is still in use moves on from the old one
            self.old, self.known = known, {}
            known = self.known
        for w in words:
            if w not in known and w in self.old:
                known[w] = self.old[w]
        new = [w for w in dict.fromkeys(words) if w not in known]
        stems = {w: w[:-1] if w[-1:] in self.marks and w[:-1].isalpha() else w for w in new}  # a lone closing mark is a word of its own
        ask = [w for w in dict.fromkeys(stems.values()) if w not in known]
        for w, e in zip(ask, self.tok.encode_batch_fast(ask, add_special_tokens=False), strict=True):
            known[w] = array("I", e.ids).tobytes()
        for w, stem in stems.items():
            if w is not stem:
                known[w] = known[stem] + self.marks[w[-1]]
        return b"".join([known[w] for w in words])


def encoder(path: str) -> Encoder:
    if path not in _TOKENIZERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _TOKENIZERS[path] = Encoder(path)
    return _TOKENIZERS[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, closing_id: int = 0) -> DataFrame:
    """Cut every document's ids plus the closing id into pieces of at most capacity tokens; only longer ones are cut."""
    import pyarrow as pa

    ship(docs.sparkSession)
    path = tokenizer or tokenizer_path()
    end = array("I", [closing_id]).tobytes()
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def cut(batches):
        enc = encoder(path)
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.ids(text or "") + end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    for c, v in zip(cols, (key, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Bulk-synchronous best-fit on run-length coded sizes.

    counts: pieces by length. Returns runs (length, first rank, how many, first sequence, offset, per sequence) and the
    number of sequences. A run puts its pieces, in rank order, `per sequence` at a time one after another from `offset`
    into consecutive sequences. Long pieces go first: pieces are admitted by halves of the capacity, and sequences are
    opened only when no open gap holds any admitted piece.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    taken = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int, int]] = []
    opened, low = 0, capacity // 2

    def put(length: int, n: int, seq: int, gap: int, per: int) -> None:
        runs.append((length, taken[length], n, seq, capacity - gap, per))
        taken[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]

    while left:
        admitted = sorted((n for n in left if n > low), reverse=True)
        if not admitted:
            low //= 2
            continue
        # the sweep: a stack of open gaps, the smallest on top; its top is a document's successor
        sizes, stack, update, hit, k = sorted(gaps, reverse=True), [], [], False, 0
        for length in admitted:
            while k < len(sizes) and sizes[k] >= length:
                stack += [(sizes[k], seq, n) for seq, n in gaps[sizes[k]]]
                k += 1
            while stack and length in left:
                gap, seq, n = stack.pop()
                hit, per, want = True, gap // length, left[length]
                full = min(n, want // per)
                if full:
                    put(length, full * per, seq, gap, per)
                    update.append((gap - per * length, seq, full))
                if full < n and length in left:
                    rest = left[length]
                    if rest < per:
                        put(length, rest, seq + full, gap, rest)
                        update.append((gap - rest * length, seq + full, 1))
                        full += 1
                if full < n:
                    stack.append((gap, seq + full, n - full))
                    if length in left:
                        continue
                    break
        unused = stack + [(s, seq, n) for s in sizes[k:] for seq, n in gaps[s]]
        gaps = {}
        for size, seq, n in unused + update:
            if size:
                gaps.setdefault(size, []).append((seq, n))
        if hit:
            continue
        # nothing fits: open as many sequences as the admitted pieces need at least, for the longest of them
        need = -(-sum(n * left[n] for n in admitted) // capacity)
        for length in admitted:
            n = min(need, left[length]) if 2 * length <= capacity else left[length]
            if n <= 0:
                break
            put(length, n, opened, capacity, 1)
            if length < capacity:
                gaps.setdefault(capacity - length, []).append((opened, n))
            opened += n
            need -= n
    return runs, opened


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece (columns of PIECES, lengths 1..capacity) its sequence and offset; keeps the columns it got."""
    import pyarrow as pa

    spark = pieces.sparkSession
    ship(spark)
    pieces = stage(pieces, "pieces")
    total = pieces.count()
    buckets = max(1, -(-total // ROWS_PER_BUCKET))
    pieces = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    # counts by length and bucket: ranks inside a length start where earlier buckets end
    sizes = stage(pieces.groupBy("length", "_b").agg(F.count("*").alias("_n")), "piece-sizes")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs, _ = plan_runs(counts, capacity)
    before = sizes.withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_n")
    ranked = (
        pieces.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
        .join(before, ["length", "_b"])
        .select(*[c for c in pieces.columns if c != "_b"], (F.col("_r") + F.col("_before")).cast("long").alias("_rank"))
    )
    by_length: dict[int, tuple[list[int], list[tuple[int, int, int, int]]]] = {}
    for length, rank, n, seq, offset, per in sorted(runs):
        firsts, rest = by_length.setdefault(length, ([], []))
        firsts.append(rank)
        rest.append((rank, seq, offset, per))
    shared = spark.sparkContext.broadcast(by_length)  # bounded by the capacity, see plan_runs
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.drop("_b").schema) + ", sequence_id long, offset long"

    def place(batches):
        for batch in batches:
            lengths, ranks = batch.column("length").to_pylist(), batch.column("_rank").to_pylist()
            seqs, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for i, (n, r) in enumerate(zip(lengths, ranks, strict=True)):
                firsts, rest = shared.value[n]
                first, seq, offset, per = rest[bisect.bisect_right(firsts, r) - 1]
                seqs[i], offsets[i] = seq + (r - first) // per, offset + (r - first) % per * n
            kept = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(seqs), pa.array(offsets)], names=[*kept, "sequence_id", "offset"])

    cols = [c for c in pieces.columns if c != "_b"]
    return ranked.select(*cols, "_rank").mapInArrow(place, schema)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(token_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
