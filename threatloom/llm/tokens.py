"""Token counts of whole texts, huge ones in overlapping chunks that are spliced where they provably agree.

A byte-level tokenizer scans a text from left to right: pieces (runs of letters, of digits, of marks, of white space) are
matched one after another without looking back, and merged on their own. So if two scans of the same text have a piece
begin at the same place, they agree from there on, whatever came before. A document longer than CHUNK characters is cut
into chunks that overlap; each is encoded in a task of its own with offsets, and leaves its piece starts inside both
overlaps. The left chunk's starts are true ones, but for the last characters, where a piece or a special string may be cut
off; the first of them that the right chunk shares is the splice. The count of the document is the sum over the splices.
Where an overlap has no common start (a run without any break), the document is cut anew with chunks and overlaps
WIDEN times as long, until it is one chunk. The proof needs what `proven` checks; other tokenizers are refused.

Shorter texts are counted in the task that reads them: a blank before a character that isn't white space always begins a
piece, so their parts between such blanks are counted once per distinct part (a bounded memory of CACHE_PARTS).

Edge cases: null text counts as empty, 0 bytes and 0 tokens; repeated rows are counted each; a null doc_id stays null;
special strings inside texts are special tokens, the library's default; nothing is truncated; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threatloom.runtime import give_back, ship, stage, table, unstage

CHUNK, OVERLAP, WIDEN = 32_768, 512, 4
LIMIT = 1024
CACHE_PARTS = 400_000
#: Characters of new parts or of a chunk that are encoded at once.
AT_ONCE = 1 << 18
_COUNTERS: dict = {}
BREAK, WIDE = re.compile(r" (?=\S)"), re.compile(r" (?:\s|\Z)")
STARTS = "array<struct<pos: long, before: long>>"
ENCODED = f"doc_id long, n_bytes long, _row long, _k int, last boolean, tokens long, head {STARTS}, tail {STARTS}"


def proven(path: str) -> int:
    """The longest special string, in characters, of a tokenizer that the splice holds for; others raise ValueError."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    scans = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
    unbroken = not any(re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
    if not (scans and plain and unbroken and spec.get("normalizer") is None):
        raise ValueError(f"{path}: not a plain byte-level tokenizer, common boundaries prove nothing")
    return max([1, *(len(t["content"]) for t in spec.get("added_tokens", []))])


class Counter:
    """Token counts of texts through a bounded memory of their parts."""

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.known: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def learn(self, parts: list[str]) -> None:
        """Remember the counts of parts that follow a blank, the blank included."""
        if len(self.known) > CACHE_PARTS:
            self.old, self.known = self.known, {}  # what is still in use moves on
        new, chars = [], 0
        for p in dict.fromkeys(parts):
            if p in self.known:
                continue
            if p in self.old:
                self.known[p] = self.old[p]
                continue
            new.append(p)
            chars += len(p)
            if chars > AT_ONCE:
                self.encode(new)
                new, chars = [], 0
        self.encode(new)

    def encode(self, parts: list[str]) -> None:
        for p, e in zip(parts, self.tok.encode_batch_fast([" " + p for p in parts], add_special_tokens=False), strict=True):
            self.known[p] = len(e)

    def count(self, text: str) -> int:
        # split(" ") does the same wherever no blank is followed by white space or the end
        first, *parts = BREAK.split(text) if WIDE.search(text) else text.split(" ")
        n = len(self.tok.encode_batch_fast([first], add_special_tokens=False)[0]) if first else 0
        known = self.known
        try:
            return n + sum([known[p] for p in parts])
        except KeyError:
            self.learn(parts)
        return n + sum([self.known[p] for p in parts])

    def starts(self, text: str, at: int, left: int, right: int) -> tuple[int, list, list]:
        """Tokens of a chunk that begins at `at`, and (position, tokens before it) of its piece starts up to `left` and
        from `right` on."""
        if left < 0 and right > at + len(text):
            return len(self.tok.encode_batch_fast([text], add_special_tokens=False)[0]), [], []
        e = self.tok.encode(text, add_special_tokens=False)
        words, offsets, head, tail = e.word_ids, e.offsets, [], []
        for i, w in enumerate(words):
            if i == 0 or w != words[i - 1]:
                pos = at + offsets[i][0]
                if pos <= left:
                    head.append({"pos": pos, "before": i})
                if pos >= right:
                    tail.append({"pos": pos, "before": i})
        return len(words), head, tail


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_whole(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of texts that fit one chunk."""
    import pyarrow as pa

    def count(batches):
        c = counter(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            cols = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([c.count(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_tokens"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")


def cut(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunks (doc_id, n_bytes, _row, _k, at, last, text): every one but the last has `chunk` characters and shares
    `overlap` of them with the next."""
    import pyarrow as pa

    step = chunk - overlap
    names = ["doc_id", "n_bytes", "_row", "_k", "at", "last", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.string()]

    def pieces(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc, n_bytes, row, text = (batch.column(c)[i].as_py() for c in range(4))
                count = max(1, -(-(len(text) - overlap) // step))
                for k in range(count):
                    values = (doc, n_bytes, row, k, k * step, k == count - 1, text[k * step : k * step + chunk])
                    yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds, strict=True)], names=names)
        give_back()

    return docs.select("doc_id", "n_bytes", "_row", "text").mapInArrow(pieces, "doc_id long, n_bytes long, _row long, _k int, at long, last boolean, text string")


def encode_chunks(chunks: DataFrame, path: str, overlap: int, longest: int) -> DataFrame:
    """ENCODED: tokens of each chunk with the piece starts of its two overlaps."""
    import pyarrow as pa

    starts = pa.list_(pa.struct([("pos", pa.int64()), ("before", pa.int64())]))

    def encode(batches):
        c = counter(path)
        for batch in batches:
            for i in range(batch.num_rows):
                doc, n_bytes, row, k, at, last, text = (batch.column(x)[i].as_py() for x in range(7))
                end = at + len(text)
                tokens, head, tail = c.starts(text, at, at + overlap if k else -1, end + 1 if last else end - overlap)
                # a start is true if what follows it before the cut can't be the beginning of a special string
                tail = [s for s in tail if s["pos"] < end - longest]
                cols = [pa.array([doc], pa.int64()), pa.array([n_bytes], pa.int64()), pa.array([row], pa.int64()), pa.array([k], pa.int32()), pa.array([last]), pa.array([tokens], pa.int64()), pa.array([head], starts), pa.array([tail], starts)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "_row", "_k", "last", "tokens", "head", "tail"])
        give_back()

    return chunks.mapInArrow(encode, ENCODED)


def splice(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, _row, n_tokens): documents of encoded chunks; n_tokens is null where a splice failed."""
    both = encoded.withColumn("next", F.lead("head").over(Window.partitionBy("_row").orderBy("_k")))
    common = F.array_min(F.array_intersect(F.col("tail.pos"), F.col("next.pos")))
    both = both.withColumn("at", common)
    before = lambda c: F.get(F.filter(c, lambda s: s["pos"] == F.col("at")), F.lit(0))["before"]
    # what the left chunk has before the splice, less what the right one will count again
    part = F.when(F.col("last"), F.col("tokens")).otherwise(before(F.col("tail")) - before(F.col("next")))
    found = both.select("doc_id", "n_bytes", "_row", part.alias("part")).groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.sum("part").alias("n"), F.count_if(F.col("part").isNull()).alias("failed"))
    return found.select("doc_id", "n_bytes", "_row", F.when(F.col("failed") == 0, F.col("n")).alias("n_tokens"))


def count_huge(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of documents (doc_id, n_bytes, _row, text), each cut, spliced and widened as needed."""
    longest, done, todo = proven(path), [], docs
    while True:
        # chunks of a document are dealt over all tasks; what is staged is counts and piece starts
        encoded = stage(encode_chunks(cut(todo, chunk, overlap).repartition("_row", "_k"), path, overlap, longest), "chunks")
        found = stage(splice(encoded), "splices")
        unstage(encoded)
        done.append(found.where("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens"))
        failed = found.where("n_tokens is null").select("_row")
        if failed.isEmpty():
            break
        todo = docs.join(failed, "_row", "left_semi")
        chunk, overlap = WIDEN * chunk, WIDEN * overlap
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of documents (doc_id, text)."""
    ship(docs.sparkSession)
    path = tokenizer or tokenizer_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    huge = rows.where(F.length("text") > chunk).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("_row"), "text")
    found = count_whole(rows.where(F.length("text") <= chunk), path).unionByName(count_huge(stage(huge, "huge"), path, chunk, overlap))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
