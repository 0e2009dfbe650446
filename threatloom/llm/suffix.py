"""Suffix-array dedup: every byte covered by a 200-byte string that also starts elsewhere is removed.

Which windows of 200 bytes can repeat is narrowed before any suffix is sorted. Each window is led by its anchor, the
40-byte gram in it with the smallest hash (equal windows have equal anchors at equal places); an anchor leads a run of
windows. A window spans at least 80 bytes before or behind its anchor's gram, so an anchor whose 120-byte strings to both
sides occur once in the corpus leads no repeat. What is left, the anchor's context (its windows' bytes), is dealt by the
gram, equal contexts are pre-aggregated to one, and a task builds the suffix array of its contexts by grouping: suffixes
are grouped by their Lyndon prefix in descending order of groups, each group lengthening the prefixes that previous-smaller
pointers name, and the groups' inner order is then emitted in one pass over the array, without recursive renaming. The
array's symbols are the contexts' 40-byte blocks, aligned to the anchor (an array over single bytes gives the same result
at about ten times the CPU): every window holds three whole blocks, so only contexts with neighbours that share three
symbols can repeat, and their windows are compared exactly. Contexts of a gram with more than ``GROUP`` different contexts
are compared by window over all tasks instead of in one.

Edge cases: null text is empty; texts under 200 bytes are never touched; equal texts (repeated rows too) remove each other
wholly; a null doc_id is kept as null; an empty table gives an empty result; extra columns are ignored. Texts are UTF-8
bytes and matches never cross documents. Equal windows and
texts are told by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.runtime import give_back, ship, stage, unstage

WINDOW = 200
GRAM = 40
SIDE = 80
#: Whole anchor-aligned GRAM-byte blocks that every window holds.
WHOLE = 3
GROUP = 3000
BLOCK_BYTES = 1_000_000
BROADCAST_BYTES = 64_000_000
CHUNK = 1 << 21
_A = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def suffix_array(seq: list[int]) -> list[int]:
    """Suffix array of a sequence of integers by linear grouping.

    Phase 1 keeps suffixes in groups that share a prefix, ordered by it, and goes through the groups from the highest
    down. For each suffix of the group at hand its previous-smaller pointer is the nearest earlier suffix in a lower
    group; a suffix named k times gets the group's prefix k times behind its own, so it leaves its group for a new one
    just above it, ordered by k. Phase 2 goes through the array from its start: a suffix that is in place puts the ones
    that end before it, along the pointers, into the next free places of their groups.
    """
    n = len(seq)
    by_symbol: dict[int, list[int]] = {}
    for i, v in enumerate(seq):
        by_symbol.setdefault(v, []).append(i)
    # groups in prefix order, linked; group 0 holds the end of the sequence, below everything
    members: list = [[n], *(by_symbol[v] for v in sorted(by_symbol))]
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    group = [0] * (n + 1)
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    prev, done = [-1] * (n + 1), [False] * (n + 1)
    rising: list[int] = []
    g = len(members) - 1
    while g >= 0:
        here = members[g] = sorted(members[g])
        rising.append(g)
        for i in here:
            done[i] = True
        named: dict[int, int] = {}
        for i in here:
            j = i - 1
            while j >= 0 and done[j]:  # done: in this group or a higher one, and its pointer skips what is higher still
                j = prev[j]
            prev[i] = j
            if j >= 0:
                named[j] = named.get(j, 0) + 1
        leave: dict[int, dict[int, list[int]]] = {}
        for j, k in named.items():
            leave.setdefault(group[j], {}).setdefault(k, []).append(j)
        for old, by_count in leave.items():
            counts = sorted(by_count)
            if sum(map(len, by_count.values())) == len(members[old]):
                members[old] = by_count[counts.pop(0)]  # nobody stays behind: the smallest count keeps the place
            else:
                if not isinstance(members[old], set):
                    members[old] = set(members[old])
                for k in counts:
                    members[old].difference_update(by_count[k])
            at = old
            for k in counts:
                new = len(members)
                members.append(by_count[k])
                for j in by_count[k]:
                    group[j] = new
                up = above[at]
                below.append(at)
                above.append(up)
                above[at] = new
                if up >= 0:
                    below[up] = new
                at = new
        g = below[g]
    free, at = [0] * len(members), 0
    for g in reversed(rising):
        free[g] = at
        at += len(members[g])
    out, placed = [0] * (n + 1), [False] * (n + 1)
    out[0], placed[n] = n, True
    for k in range(n + 1):
        i = out[k] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            placed[i] = True
            i = prev[i]
    return out[1:]


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte strings, by doubling: 1, 2, 4, ... 32 bytes and the last 8."""
    h = (b.astype(np.uint64) + np.uint64(1)) * _A[0]
    held, n = {1: h}, 1
    while n < 32:
        h = h[: h.size - n] * _A[1] + (h[n:] ^ (h[n:] >> np.uint64(29)))
        n *= 2
        held[n] = h
    size = b.size - GRAM + 1
    h = held[32][:size] * _A[2] + held[8][32 : 32 + size]
    h ^= h >> np.uint64(31)
    return h * _A[3]


def side_hash(h: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of the 120-byte strings at the given places, from the hashes of their three grams."""
    x = h[at] * _A[1] + (h[at + GRAM] ^ (h[at + GRAM] >> np.uint64(27))) * _A[4] + (h[at + 2 * GRAM] ^ (h[at + 2 * GRAM] >> np.uint64(33))) * _A[5]
    return (x ^ (x >> np.uint64(30))) * _A[salt]


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window) of every anchor of a text, given its gram hashes; the windows partition."""
    wide = WINDOW - GRAM + 1
    n = h.size - wide + 1
    if n <= 0:
        e = np.empty(0, np.int64)
        return e, e, e
    mask = np.uint64((1 << 24) - 1)
    key = (h & ~mask) | np.arange(h.size, dtype=np.uint64)
    # minima of sliding windows from running minima of blocks, forward and backward
    pad = np.full(-(-h.size // wide) * wide, np.uint64(0xFFFFFFFFFFFFFFFF))
    pad[: h.size] = key
    blocks = pad.reshape(-1, wide)
    fore = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(back[:n], fore[wide - 1 : wide - 1 + n]) & mask).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return place[first], first, np.append(first[1:], n) - 1


def _chunks(b: np.ndarray):
    """Overlapping stretches of a text that share no window: (start, bytes)."""
    for k in range(0, max(1, b.size - WINDOW + 1), CHUNK):
        yield k, b[k : k + CHUNK + WINDOW - 1]


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """(f, c, p): the strings to both sides of every anchor that its windows rely on; c names the text."""
    import pyarrow as pa

    def find(batches):
        for batch in batches:
            fs, cs, ps, held = [], [], [], 0
            for c, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
                if b.size < WINDOW:
                    continue
                for base, part in _chunks(b):
                    h = gram_hashes(part)
                    p, first, last = anchors(h)
                    left, right = p[first <= p - SIDE], p[last >= p - SIDE]
                    f = np.concatenate([side_hash(h, left - SIDE, 2), side_hash(h, right, 3)])
                    fs.append(f)
                    cs.append(np.full(f.size, c, np.int64))
                    ps.append(np.concatenate([left, right]) + base)
                    held += f.size
                if held > 100_000:
                    yield rows(fs, cs, ps)
                    fs, cs, ps, held = [], [], [], 0
            if held:
                yield rows(fs, cs, ps)
        give_back()

    def rows(fs, cs, ps):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(fs).view(np.int64)), pa.array(np.concatenate(cs)), pa.array(np.concatenate(ps))], names=["f", "c", "p"])

    return texts.select("c", "text").mapInArrow(find, "f long, c long, p long")


def _contexts(texts: DataFrame) -> DataFrame:
    """texts with `places` (candidate anchors) -> (g, c, l, k, ctx): gram, text, first window, context's name and bytes."""
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def cut(batches):
        for batch in batches:
            out, held = [], 0
            for c, text, places in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                wanted = set(places)
                for base, part in _chunks(np.frombuffer(raw, np.uint8)):
                    h = gram_hashes(part)
                    for p, first, last in zip(*(x.tolist() for x in anchors(h)), strict=True):
                        if p + base not in wanted:
                            continue
                        ctx = raw[base + first : base + last + WINDOW]
                        k = xxhash.xxh3_64_intdigest(ctx, seed=(p - first) & 0xFFFFFFFF)
                        out.append((int(h[p].astype(np.int64)), c, base + first, k - (1 << 64) if k >> 63 else k, p - first, ctx))
                        held += len(ctx)
                if held > 4_000_000:
                    yield rows(out)
                    out, held = [], 0
            yield rows(out)
        give_back()

    def rows(out):
        cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["g", "c", "l", "k", "o", "ctx"])

    return texts.select("c", "text", "places").mapInArrow(cut, "g long, c long, l long, k long, o int, ctx binary")


def window_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of all WINDOW-byte strings of b."""
    h = gram_hashes(b)
    n = b.size - WINDOW + 1
    x = np.zeros(n, np.uint64)
    for j in range(0, WINDOW, GRAM):
        x = (x ^ h[j : j + n]) * _A[4]
        x ^= x >> np.uint64(32)
    return x * _A[5]


def repeated_starts(contexts: list[bytes], places: list[int]) -> list[np.ndarray]:
    """For each context, which of its windows also start in another place of these contexts. places: the anchors in them.

    A suffix array over the contexts' blocks names the contexts that share WHOLE blocks or more with another suffix; only
    their windows are then compared.
    """
    sizes = np.array([len(x) for x in contexts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    b = np.frombuffer(b"".join(contexts), np.uint8)
    h = gram_hashes(b)
    # whole blocks on both sides of the anchor; a zero, below all symbols, ends each context
    first = np.array(places) % GRAM
    many = (sizes - first) // GRAM
    owner = np.repeat(np.arange(sizes.size), many + 1)
    step = np.arange(owner.size) - np.repeat(np.cumsum(many + 1) - many - 1, many + 1)
    inside = step < many[owner]
    at = np.where(inside, starts[owner] + first[owner] + step * GRAM, 0)
    seq = np.zeros(owner.size, np.int64)
    seq[inside] = np.unique(h[at[inside]], return_inverse=True)[1] + 1
    sa = np.array(suffix_array(seq.tolist()), np.int64)
    pad = np.concatenate([seq, np.zeros(WHOLE, np.int64)])
    close = np.ones(max(0, sa.size - 1), bool)
    for d in range(WHOLE):
        x, y = pad[sa[1:] + d], pad[sa[:-1] + d]
        close &= (x == y) & (x > 0)
    named = np.zeros(sizes.size, bool)
    named[owner[sa[1:][close]]] = True
    named[owner[sa[:-1][close]]] = True
    hit = np.zeros(b.size, bool)
    # places of the windows of the named contexts
    n = np.where(named, sizes - WINDOW + 1, 0)
    w_at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
    if w_at.size:
        _, back, count = np.unique(window_hashes(b)[w_at], return_inverse=True, return_counts=True)
        hit[w_at[count[back] > 1]] = True
    return [hit[s : s + k - WINDOW + 1] for s, k in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _runs(hit: np.ndarray) -> list[int]:
    """[from, to, from, to, ...] of the true stretches, ends included."""
    edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
    edge[1::2] -= 1
    return edge.tolist()


def _evaluate(cold: DataFrame) -> DataFrame:
    """(k, runs) of contexts with repeated windows; rows (g, k, o, ctx) come dealt and sorted by g."""
    import pyarrow as pa

    def work(batches):
        held: list[tuple[int, int, bytes]] = []
        size, last = 0, None
        for batch in batches:
            for g, k, o, ctx in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
                if g != last and size > BLOCK_BYTES:
                    yield out(held)
                    held, size = [], 0
                last = g
                held.append((k, o, ctx))
                size += len(ctx)
        if held:
            yield out(held)
        give_back()

    def out(held):
        ks, runs = [], []
        for (k, _, _), hit in zip(held, repeated_starts([x[2] for x in held], [x[1] for x in held]), strict=True):
            if hit.any():
                ks.append(k)
                runs.append(_runs(hit))
        return pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(runs, pa.list_(pa.int32()))], names=["k", "runs"])

    return cold.select("g", "k", "o", "ctx").mapInArrow(work, "k long, runs array<int>")


def _all_windows(hot: DataFrame) -> DataFrame:
    """(w, k, i): every window of the contexts of hot grams, for comparison over all tasks."""
    import pyarrow as pa

    def explode(batches):
        for batch in batches:
            for k, ctx in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = window_hashes(np.frombuffer(ctx, np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(np.full(w.size, k)), pa.array(np.arange(w.size, dtype=np.int32))], names=["w", "k", "i"])

    return hot.select("k", "ctx").mapInArrow(explode, "w long, k long, i int")


def _maybe_broadcast(df: DataFrame, size: DataFrame) -> DataFrame:
    """Hint a broadcast only where the measured size allows; else the join deals both sides."""
    n = size.first()[0] or 0
    return F.broadcast(df) if n <= BROADCAST_BYTES else df


def _merged(spans: DataFrame) -> DataFrame:
    """(c, runs): a text's runs of window starts in order, joined where their bytes touch."""
    import pyarrow as pa

    def work(batches):
        for batch in batches:
            out = []
            for runs in batch.column(1).to_pylist():
                spans: list[int] = []
                for a, e in sorted(zip(runs[::2], runs[1::2], strict=True)):
                    if spans and a <= spans[-1] + WINDOW:
                        spans[-1] = max(spans[-1], e)
                    else:
                        spans += [a, e]
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["c", "runs"])

    return spans.mapInArrow(work, "c long, runs array<long>")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes (`kept`)."""
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("c", F.xxhash64("text"))
    # equal texts: one class, which stands in for all of them as a partner
    classes = stage(texts.where(F.octet_length("text") >= WINDOW).groupBy("c").agg(F.count("*").alias("n"), F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("d")), "text-classes")
    place = F.struct("c", "p")
    rows = stage(_anchor_rows(texts), "anchors")
    twice = rows.groupBy("f").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("f")
    found = rows.join(twice, "f").groupBy("c").agg(F.collect_set("p").alias("places"))
    places = stage(found.join(classes.select("c", "d"), "c"), "places")
    unstage(rows)
    wanted = _maybe_broadcast(places, places.select(F.sum(F.size("places") * 8 + 40)))
    mine = texts.withColumn("d", F.coalesce("doc_id", F.lit(-(2**63)))).join(wanted, ["c", "d"])
    cut = stage(_contexts(mine), "contexts")
    unstage(places)
    at = F.struct("c", "l")
    distinct = cut.groupBy("k").agg(F.first("g").alias("g"), F.min(at).alias("a"), F.max(at).alias("b"), F.first("o").alias("o"), F.first("ctx").alias("ctx"))
    distinct = stage(distinct.withColumn("many", F.col("a") != F.col("b")).drop("a", "b"), "distinct-contexts")
    groups = distinct.groupBy("g").agg(F.count("*").alias("size"))
    sized = distinct.join(groups.where(F.col("size") > 1), "g")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cold = sized.where(F.col("size") <= GROUP).repartition(parts, "g").sortWithinPartitions("g")
    windows = _all_windows(sized.where(F.col("size") > GROUP))
    windows = stage(windows, "windows")
    often = windows.groupBy("w").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").select("w")
    hot = windows.join(often, "w").groupBy("k").agg(F.sort_array(F.collect_set("i")).alias("i")).select("k", F.expr("flatten(transform(i, x -> array(x, x)))").alias("runs"))
    whole = distinct.where("many").select("k", F.expr("array(0, cast(octet_length(ctx) as int) - 200)").alias("runs"))
    runs = stage(_evaluate(cold).unionByName(hot).unionByName(whole), "runs")
    spans = cut.select("c", "l", "k").join(runs, "k").select("c", F.expr("transform(runs, x -> cast(x + l as bigint))").alias("runs"))
    spans = _merged(spans.groupBy("c").agg(F.flatten(F.collect_list("runs")).alias("runs")))
    full = classes.where("n > 1").select("c", F.lit(True).alias("whole"))
    marks = stage(spans.join(full, "c", "full"), "spans")
    unstage(windows, runs, cut, distinct)
    marked = texts.join(_maybe_broadcast(marks, marks.select(F.sum(F.coalesce(F.size("runs"), F.lit(0)) * 8 + 40))), "c", "left")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def finish(batches):
        for batch in batches:
            out = []
            for d, text, runs, full in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                n, kept, removed, n_spans = len(raw), raw, 0, 0
                if full:
                    kept, removed, n_spans = b"", n, 1
                elif runs:
                    pairs = sorted(zip(runs[::2], runs[1::2], strict=True))
                    spans = []
                    for a, e in pairs:
                        e += WINDOW
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], e)
                        else:
                            spans.append([a, e])
                    last, keep = 0, []
                    for a, e in spans:
                        keep.append(raw[last:a])
                        removed += e - a
                        last = e
                    kept, n_spans = b"".join([*keep, raw[last:]]), len(spans)
                out.append((d, n, removed, n_spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return marked.select("doc_id", "text", "runs", "whole").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op4_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
