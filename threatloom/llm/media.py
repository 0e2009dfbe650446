"""Media columns: local image descriptors find cropped and edited copies of images.

Images are 8-bit grey PGM (P5) bytes. Equal bytes form a class, and one image stands for it. Its corners (Harris response,
local maxima at full and at half size) are turned to the direction of their patch's centroid and described by 256
brightness comparisons on the turned patch. Five tables over 48-bit parts of the descriptors give candidates. A list of a
part that holds over ``SHORT`` entries is parted by the neighbouring part and then by the whole descriptor, so lists by chance
stay short; images of one short list are paired. A pair is a candidate where two corners on either side say nearly
the same shift, or four corners match. A list of equal descriptors can be long: each member is paired with the list's first
image, and members that the copies found do not connect are compared with all other groups of the list, block by block.
The pairs that parting leaves out are made up for: images of different groups whose corners share a part's list of over
``SHORT`` entries and are near each other are compared in tasks, and the links found connect the groups.
A candidate is a copy if one similarity transform, proposed by each of its mutually nearest descriptors, carries at least
``MIN_INLIERS`` corners of the one onto the other's. The copies found this way connect images to groups.
Links are then counted over all pairs of a group: its images are dealt in blocks, each pair of blocks is compared in one
task, and only counts leave the task.

Edge cases: null or unreadable bytes, and images too small or too flat for corners, link with nothing but equal bytes (null
not even with null); repeated rows fall into one class; a null id is kept as null and counts as the smallest; an empty
table gives an empty result; extra columns are ignored. Copies inside one class are not expanded into pairs.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm.graph import components
from threatloom.runtime import give_back, ship, stage, unstage

CORNERS = 24
RADIUS = 9
BINS = 32
PARTS = 5
SHORT = 8
BLOCK = 256
ENTRIES_PER_BUCKET = 1_000_000
IMAGES_PER_BLOCK, ENTRIES_PER_GROUP, COPIES_AT_ONCE = 2_000, 50_000, 2
SHIFT = 24
HALF = 2**17
BROADCAST_IDS = 500_000
MAX_DISTANCE = 48
MIN_INLIERS = 6
NO_ID = -(2**63)
FEATURES = "id long, xy binary, angle binary, desc binary"
ENTRY = np.dtype([("id", "i8"), ("bucket", "u4"), ("key", "u4"), ("middle", "u2"), ("whole", "u2"), ("x", "u2"), ("y", "u2"), ("turn", "u1"), ("corner", "u1"), ("part", "u1"), ("extra", "?")])
TRAVELS = ("key", "middle", "whole", "x", "y", "turn", "corner", "part")


def _pattern() -> np.ndarray:
    """Offsets of the 256 comparisons for each direction: [BINS, 256, 2 ends, (y, x)]."""
    rng = np.random.default_rng(20240229)
    p = np.clip(rng.normal(0, RADIUS / 2.2, (256, 2, 2)), -RADIUS * 0.7, RADIUS * 0.7)
    t = 2 * np.pi * np.arange(BINS) / BINS
    c, s = np.cos(t)[:, None, None], np.sin(t)[:, None, None]
    y, x = p[..., 0], p[..., 1]
    return np.rint(np.stack([y * c + x * s, x * c - y * s], -1)).astype(int)


_PATTERN = _pattern()
_DISC = np.array([(y, x) for y in range(-8, 9) for x in range(-8, 9) if y * y + x * x <= 64])


def decode_pgm(raw: bytes | None) -> np.ndarray | None:
    """A grey image from binary PGM, or None."""
    try:
        kind, width, height, depth = raw.split(None, 4)[:4]
        if kind != b"P5" or int(depth) != 255:
            return None
        w, h = int(width), int(height)
        return np.frombuffer(raw[-w * h :], np.uint8).reshape(h, w) if w * h else None
    except (ValueError, AttributeError):
        return None


def encode_pgm(img: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (img.shape[1], img.shape[0]) + img.astype(np.uint8).tobytes()


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over (2r + 1) squares, zeros beyond the border."""
    for axis in (1, 2):
        out, n = x.copy(), x.shape[axis]
        for d in range(1, r + 1):
            low, high = [slice(None)] * 3, [slice(None)] * 3
            low[axis], high[axis] = slice(0, n - d), slice(d, n)
            out[tuple(low)] += x[tuple(high)]
            out[tuple(high)] += x[tuple(low)]
        x = out
    return x


def describe(stack: np.ndarray, corners: int = CORNERS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per image of a stack [B, H, W]: corners' (x, y, scale) in full-size pixels, direction bins and 32-byte descriptors."""
    found: list[list] = [[] for _ in stack]
    level = stack.astype(np.float32)
    for scale, take in ((1.0, corners * 2 // 3), (2.0, corners - corners * 2 // 3)):
        if scale > 1:
            h, w = level.shape[1] // 2 * 2, level.shape[2] // 2 * 2
            level = level[:, :h, :w].reshape(len(level), h // 2, 2, w // 2, 2).mean((2, 4))
        b, h, w = level.shape
        edge = RADIUS + 2
        if h <= 2 * edge + 2 or w <= 2 * edge + 2:
            break
        smooth = _box(level, 1) / 9
        gy, gx = np.zeros_like(smooth), np.zeros_like(smooth)
        gy[:, 1:-1] = smooth[:, 2:] - smooth[:, :-2]
        gx[:, :, 1:-1] = smooth[:, :, 2:] - smooth[:, :, :-2]
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = r[:, edge:-edge, edge:-edge]
        peak = inner > 1e4
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    near = r[:, edge + dy : h - edge + dy, edge + dx : w - edge + dx]
                    peak &= inner > near if (dy, dx) > (0, 0) else inner >= near
        # the strongest `take` peaks of each image, in image order
        img, y, x = np.nonzero(peak)
        order = np.lexsort((-inner[img, y, x], img))
        rank = np.arange(order.size) - np.repeat(np.searchsorted(img, np.arange(b)), np.bincount(img, minlength=b))
        order = order[rank < take]
        img, y, x = img[order], y[order] + edge, x[order] + edge
        patch = smooth[img[:, None], y[:, None] + _DISC[:, 0], x[:, None] + _DISC[:, 1]]
        turn = np.arctan2(patch @ _DISC[:, 0].astype(np.float32), patch @ _DISC[:, 1].astype(np.float32))
        bins = np.rint(turn / (2 * np.pi) * BINS).astype(int) % BINS
        p = _PATTERN[bins]
        v = smooth[img[:, None, None], y[:, None, None] + p[..., 0], x[:, None, None] + p[..., 1]]
        bits = np.packbits(v[..., 0] < v[..., 1], axis=1)
        half = (scale - 1) / 2
        for i, row in enumerate(img.tolist()):
            found[row].append((x[i] * scale + half, y[i] * scale + half, scale, bins[i], bits[i]))
    return [
        (np.array([f[:3] for f in fs], np.float32).reshape(-1, 3), np.array([f[3] for f in fs], np.uint8), np.array([f[4] for f in fs], np.uint8).reshape(-1, 32))
        for fs in found
    ]


def inliers(a: tuple, b: tuple) -> int:
    """Corners of a that one similarity transform carries onto their matches in b."""
    (pa_, ta, da), (pb, tb, db) = a, b
    if not len(da) or not len(db):
        return 0
    dist = np.unpackbits(da[:, None] ^ db[None], axis=2).sum(2)
    i, j = np.arange(len(da)), dist.argmin(1)
    ok = (dist[i, j] <= MAX_DISTANCE) & (dist.argmin(0)[j] == i)
    i, j = i[ok], j[ok]
    if not i.size:
        return 0
    za, zb = pa_[i, 0] + 1j * pa_[i, 1], pb[j, 0] + 1j * pb[j, 1]
    turn = (pb[j, 2] / pa_[i, 2]) * np.exp(2j * np.pi * (tb[j].astype(int) - ta[i].astype(int)) / BINS)
    # the direction is known to a bin only, so the transform is also tried without turning
    best = 0
    for t in (turn, np.abs(turn).astype(complex)):
        moved = t[:, None] * (za[None] - za[:, None]) + zb[:, None]
        best = max(best, int((np.abs(moved - zb[None]) <= 3.5).sum(1).max()))
    return best


def read_features(xy: list, angle: list, desc: list) -> list[tuple]:
    """Features from the bytes of FEATURES' columns."""
    return [(np.frombuffer(x, np.float32).reshape(-1, 3), np.frombuffer(t, np.uint8), np.frombuffer(d, np.uint8).reshape(-1, 32)) for x, t, d in zip(xy, angle, desc, strict=True)]


def inliers_of(feats: list[tuple], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`inliers` of the pairs (feats[a[k]], feats[b[k]]), many at a time; 0 where fewer than MIN_INLIERS corners match."""
    n = np.array([len(f[1]) for f in feats], int)
    out = np.zeros(len(a), int)
    top = max(n.max(initial=0), 1)
    xy, angle, desc = np.zeros((len(feats), top, 3), np.float32), np.zeros((len(feats), top), int), np.zeros((len(feats), top, 32), np.uint8)
    for k, f in enumerate(feats):
        xy[k, : n[k]], angle[k, : n[k]], desc[k, : n[k]] = f
    z, words = xy[..., 0] + 1j * xy[..., 1], desc.view(np.uint64)
    # pairs of like numbers of corners go together
    like = np.ceil(np.log2(np.maximum(n[a], 1))).astype(int) * 64 + np.ceil(np.log2(np.maximum(n[b], 1))).astype(int)
    like[(n[a] < MIN_INLIERS) | (n[b] < MIN_INLIERS)] = -1
    for kind in np.unique(like[like >= 0]).tolist():
        mine = np.flatnonzero(like == kind)
        ca, cb = n[a[mine]].max(), n[b[mine]].max()
        step = max(1, 500_000 // int(ca * cb))
        for k in range(0, mine.size, step):
            at = mine[k : k + step]
            i, j = a[at], b[at]
            dist = np.zeros((at.size, ca, cb), np.uint16)
            for w in range(4):
                dist += np.bitwise_count(words[i, :ca, None, w] ^ words[j, None, :cb, w])
            dist[np.arange(ca)[None] >= n[i][:, None]] = 999
            dist.swapaxes(1, 2)[np.arange(cb)[None] >= n[j][:, None]] = 999
            near = dist.argmin(2)
            ok = (np.take_along_axis(dist, near[..., None], 2)[..., 0] <= MAX_DISTANCE) & (np.take_along_axis(dist.argmin(1), near, 1) == np.arange(ca))
            some = ok.sum(1) >= MIN_INLIERS
            if not some.any():
                continue
            at, i, j, ok, near = at[some], i[some], j[some], ok[some], near[some]
            first = np.argsort(~ok, axis=1, kind="stable")[:, : ok.sum(1).max()]
            ok, near = np.take_along_axis(ok, first, 1), np.take_along_axis(near, first, 1)
            za, zb = z[i[:, None], first], z[j[:, None], near]
            turn = (xy[j[:, None], near, 2] / np.where(ok, xy[i[:, None], first, 2], 1)) * np.exp(2j * np.pi * (angle[j[:, None], near] - angle[i[:, None], first]) / BINS)
            for t in (turn, np.abs(turn).astype(complex)):
                moved = t[:, :, None] * (za[:, None] - za[:, :, None]) + zb[:, :, None]
                moved -= zb[:, None]
                hits = ((moved.real**2 + moved.imag**2 <= 3.5**2) & ok[:, None]).sum(2)
                out[at] = np.maximum(out[at], np.where(ok, hits, 0).max(1))
    return out


def features(images: DataFrame) -> DataFrame:
    """images (id, image) -> FEATURES; images of one shape are described together."""
    import pyarrow as pa

    def work(batches):
        for batch in batches:
            shapes: dict[tuple, tuple[list, list]] = {}
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                img = decode_pgm(raw)
                if img is not None:
                    ids, imgs = shapes.setdefault(img.shape, ([], []))
                    ids.append(key)
                    imgs.append(img)
            for ids, imgs in shapes.values():
                for k in range(0, len(ids), 16):
                    out = describe(np.stack(imgs[k : k + 16]))
                    cols = [ids[k : k + 16], [x[0].tobytes() for x in out], [x[1].tobytes() for x in out], [x[2].tobytes() for x in out]]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["id", "xy", "angle", "desc"])

    return images.select("id", "image").mapInArrow(work, FEATURES)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit hashes of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def keys_of(desc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of descriptors' 48-bit parts [n, PARTS], 16-bit hashes of each part's right neighbour and of the whole."""
    wide = np.zeros((len(desc), PARTS, 8), np.uint8)
    wide[:, :, :6] = desc[:, : 6 * PARTS].reshape(-1, PARTS, 6)
    part = wide.view(np.uint64)[..., 0] + (np.arange(PARTS, dtype=np.uint64) << np.uint64(48))
    whole = np.zeros(len(desc), np.uint64)
    for word in np.ascontiguousarray(desc).view(np.uint64).T:
        whole = mixed(whole ^ word)
    return mixed(part), (mixed(np.roll(part, -1, 1)) >> np.uint64(48)).astype(np.uint16), (whole >> np.uint64(48)).astype(np.uint16)


def entries(ids: list, feats: list[tuple]) -> np.ndarray:
    """ENTRY records of a batch of images, one a corner and part.

    Where over SHORT corners of the batch share a whole descriptor, SHORT + 1 stay, which makes their lists long wherever they
    meet; the rest are ``extra``, members of the long list and of nothing else.
    """
    n = np.array([len(f[1]) for f in feats], int)
    image = np.repeat(np.arange(len(feats)), n)
    xy, angle, desc = (np.concatenate([f[k] for f in feats]) for k in range(3))
    part, middle, whole = keys_of(desc)
    out = np.zeros((image.size, PARTS), ENTRY)
    out["id"] = np.array(ids, np.int64)[image][:, None]
    out["bucket"], out["key"], out["middle"], out["whole"] = part & np.uint64(0xFFFFFFFF), part >> np.uint64(32), middle, whole[:, None]
    out["part"] = np.arange(PARTS)
    out["x"], out["y"] = np.rint(xy[:, :1] * 2), np.rint(xy[:, 1:2] * 2)
    out["turn"] = (angle + np.where(xy[:, 2] > 1, BINS, 0))[:, None]
    out["corner"] = (np.arange(image.size) - np.repeat(np.cumsum(n) - n, n))[:, None] % 63
    name = list_name(out[:, 0])
    order = np.lexsort((image, name))
    start = np.flatnonzero(np.r_[True, np.diff(name[order]) != 0])[: order.size]
    rank = np.empty(order.size, int)
    rank[order] = np.arange(order.size) - np.repeat(start, np.diff(np.r_[start, order.size]))
    out["extra"] = (rank > SHORT)[:, None]
    return out.ravel()


def list_name(e: np.ndarray) -> np.ndarray:
    """The number of the list of a whole descriptor, from the entry of its first part."""
    return (e["key"].astype(np.uint64) << np.uint64(32) | e["middle"].astype(np.uint64) << np.uint64(16) | e["whole"]).view(np.int64)


def packed(e: np.ndarray) -> bytes:
    """Records as columns of bytes, ids once an image."""
    ids, image = np.unique(e["id"], return_inverse=True)
    cols = [ids, image.astype(np.uint16), *(np.ascontiguousarray(e[c]) for c in TRAVELS)]
    return np.array([ids.size, e.size], np.int32).tobytes() + b"".join(c.tobytes() for c in cols)


def unpacked(raw: bytes) -> np.ndarray:
    m, n = np.frombuffer(raw, np.int32, 2).tolist()
    ids, image = np.frombuffer(raw, np.int64, m, 8), np.frombuffer(raw, np.uint16, n, 8 + 8 * m)
    out, at = np.zeros(n, ENTRY), 8 + 8 * m + 2 * n
    out["id"] = ids[image]
    for c in TRAVELS:
        out[c] = np.frombuffer(raw, ENTRY[c], n, at)
        at += n * ENTRY[c].itemsize
    return out


def hits_of(e: np.ndarray):
    """From a bucket's entries: (a, b, shift and corners) of every two images in one short list; (image, list, -1) of long ones.

    A list of one part with over SHORT entries is parted by the neighbouring part, and what is still long by the whole
    descriptor. What is long even then holds equal descriptors; it is named, by its first part alone.
    """
    live = np.arange(e.size)
    for level in range(3):
        name = e["key"].astype(np.uint64) << np.uint64(32)
        for c, by in (("middle", 16), ("whole", 0))[:level]:
            name |= e[c].astype(np.uint64) << np.uint64(by)
        live = live[np.lexsort((e["id"][live], name[live]))]
        start = np.flatnonzero(np.r_[True, np.diff(name[live]) != 0])[: live.size]
        size = np.diff(np.r_[start, live.size])
        for n in range(2, SHORT + 1):
            first, (i, j) = start[size == n], np.triu_indices(n, 1)
            step = max(1, 200_000 // i.size)
            for k in range(0, first.size, step):
                rows = live[first[k : k + step, None] + np.arange(n)]
                a, b = e[rows[:, i].ravel()], e[rows[:, j].ravel()]
                apart = a["id"] != b["id"]
                a, b = a[apart], b[apart]
                octave = (b["turn"] // BINS).astype(int) - a["turn"] // BINS
                turn = (b["turn"].astype(int) - a["turn"]) * (2 * np.pi / BINS)
                moved = (a["x"] + 1j * a["y"]) * 2.0**octave * np.exp(1j * turn)
                shift = [np.clip(np.rint(v), -HALF, HALF - 1).astype(np.int64) + HALF for v in (b["x"] - moved.real, b["y"] - moved.imag)]
                yield a["id"], b["id"], (((shift[0] * 2 * HALF + shift[1]) * 4 + octave + 1) * 64 + a["corner"]) * 64 + b["corner"]
        live = live[np.repeat(size > SHORT, size)]
    live = live[e["part"][live] == 0]
    if live.size:
        yield e["id"][live], list_name(e[live]), np.full(live.size, -1)


def index_hits(feats: DataFrame, buckets: int) -> DataFrame:
    """(a, b, g): two images a < b of a short list with the shift and corners g >= 0 of their entries, or image a of the
    long list b, g = -1. Entries travel once, packed by bucket."""
    import pyarrow as pa

    names = ["bucket", "data", "extra"]

    def deal(batches):
        # `packed` numbers a batch's images by 16 bits
        for batch in (b.slice(k, 50_000) for b in batches for k in range(0, b.num_rows, 50_000)):
            ids = batch.column(0).to_pylist()
            e = entries(ids, read_features(*(batch.column(k).to_pylist() for k in (1, 2, 3)))) if ids else np.zeros(0, ENTRY)
            bucket = e["bucket"] % buckets
            order = np.argsort(bucket, kind="stable")
            e, bucket = e[order], bucket[order]
            start = np.flatnonzero(np.r_[True, np.diff(bucket) != 0])[: e.size]
            groups = np.split(e, start[1:]) if e.size else []
            rest = [g[g["extra"] & (g["part"] == 0)] for g in groups]
            data, extra = [packed(g[~g["extra"]]) for g in groups], [g["id"].tobytes() + list_name(g).tobytes() for g in rest]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[start].astype(np.int32)), pa.array(data, pa.binary()), pa.array(extra, pa.binary())], names=names)

    def meet(batches):
        held = []
        out = lambda a, b, g: pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (a, b, g)], names=["a", "b", "g"])
        for batch in batches:
            held += [unpacked(x) for x in batch.column(1).to_pylist()]
            for raw in batch.column(2).to_pylist():
                ids, named = np.frombuffer(raw, np.int64).reshape(2, -1)
                yield out(ids, named, np.full(ids.size, -1))
        if held:
            for hit in hits_of(np.concatenate(held)):
                yield out(*hit)
        give_back()

    dealt = feats.select("id", "xy", "angle", "desc").mapInArrow(deal, "bucket int, data binary, extra binary")
    return dealt.repartitionById(buckets, "bucket").mapInArrow(meet, "a long, b long, g long")


def candidates(feats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of images that the tables propose, and members (list, id) of the long lists of equal descriptors.

    A pair of short lists needs two corners on either side, whose shifts agree unless there are four; a member of a long list
    is paired with the list's first image.
    """
    buckets = max(1, -(-feats.count() * CORNERS * PARTS // ENTRIES_PER_BUCKET))
    hits = index_hits(feats, buckets).repartition("a", "b").withColumn("t", F.shiftright("g", 12))
    x, y, octave = F.expr(f"t div {8 * HALF}"), F.expr(f"(t div 4) % {2 * HALF}"), F.expr("t % 4")
    spread = lambda c: F.max(c) - F.min(c)
    corners = [F.bit_count(F.bit_or(F.expr(f"shiftleft(1L, cast({c} as int))"))).alias(f"n{k}") for k, c in enumerate(("(g div 64) % 64", "g % 64"))]
    seen = hits.groupBy("a", "b", (F.col("g") < 0).alias("listed")).agg(*corners, spread(x).alias("dx"), spread(y).alias("dy"), spread(octave).alias("do"))
    agree = f"least(n0, n1) >= 4 or (least(n0, n1) >= 2 and dx <= {2 * SHIFT} and dy <= {2 * SHIFT} and do = 0)"
    seen = stage(seen.where(f"listed or {agree}").select("a", "b", "listed"), "image-hits")
    members = seen.where("listed").select(F.col("b").alias("list"), F.col("a").alias("id"))
    heads = members.groupBy("list").agg(F.min("id").alias("a"))
    led = members.join(heads, "list").where("id > a").select("a", F.col("id").alias("b"))
    return seen.where("not listed").select("a", "b").unionByName(led).distinct(), members


def links_of_long_lists(members: DataFrame, groups: DataFrame, feats: DataFrame) -> DataFrame:
    """(a, b): copies in long lists whose first image did not connect all: members of different groups are compared, block
    by block, and of the links between two groups one leaves a task."""
    import pyarrow as pa

    def work(table):
        ids, root, block, (first, *_), (second, *_) = (table.column(c).to_numpy() for c in ("id", "root", "block", "first", "second"))
        feats = read_features(*(table.column(c).to_pylist() for c in ("xy", "angle", "desc")))
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        i, j = np.nonzero(root[left][:, None] != root[right][None])
        i, j = left[i], right[j]
        i, j = (i[i < j], j[i < j]) if first == second else (i, j)
        ok = inliers_of(feats, i, j) >= MIN_INLIERS
        i, j = i[ok], j[ok]
        ends = np.sort(np.stack([root[i], root[j]], 1), axis=1)
        keep = np.unique(ends, axis=0, return_index=True)[1] if i.size else i
        return pa.table({"a": pa.array(ids[i[keep]]), "b": pa.array(ids[j[keep]])})

    rooted = members.join(groups, "id", "left").withColumn("root", F.coalesce("root", "id"))
    apart = rooted.groupBy("list").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    dealt = rooted.join(apart.select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "list")
    dealt = dealt.withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("list", "id", "root", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    return dealt.join(feats, "id").groupBy("list", "first", "second").applyInArrow(work, "a long, b long")


def links_across_parts(groups: DataFrame, feats: DataFrame) -> DataFrame:
    """(a, b): copies in different groups with corners that share a part's list of over SHORT entries and whose descriptors
    are within MAX_DISTANCE of each other, as matching corners are; of the links between two groups one leaves a task.

    Nothing of a list is left out: its images meet in tasks of a bounded size, small lists many at a time, the blocks of a
    large one two by two. The comparisons grow with the square of the groups that a list holds.
    """
    import pyarrow as pa

    def parts(batch):
        ids = batch.column(0).to_pylist()
        desc = [np.frombuffer(d, np.uint8).reshape(-1, 32) for d in batch.column(1).to_pylist()]
        return np.repeat(np.array(ids, np.int64), [len(d) for d in desc]), keys_of(np.concatenate([np.zeros((0, 32), np.uint8), *desc]))[0].view(np.int64)

    def count(batches):
        for batch in batches:
            key, n = np.unique(parts(batch)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    def deal(batches):
        for batch in batches:
            ids, key = parts(batch)
            both = np.unique(np.stack([key.ravel(), np.repeat(ids, PARTS)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in both.T], names=["key", "id"])

    def compare(table):
        ids, root, block = (table.column(c).to_numpy() for c in ("id", "root", "block"))
        (first, *_), (second, *_) = (table.column(c).to_numpy() for c in ("first", "second"))
        feats = read_features(*(table.column(c).to_pylist() for c in ("xy", "angle", "desc")))
        image = np.repeat(np.arange(ids.size), [len(f[2]) for f in feats])
        desc = np.concatenate([f[2] for f in feats])
        key, words = keys_of(desc)[0].view(np.int64), np.ascontiguousarray(desc).view(np.uint64)
        corner, part = np.nonzero(np.isin(key, np.unique(np.concatenate([v.values.to_numpy() for v in table.column("keys")]))))
        order = np.lexsort((corner, key[corner, part]))
        corner, key = corner[order], key[corner, part][order]
        start = np.flatnonzero(np.r_[True, np.diff(key) != 0])[: key.size]
        up: dict[int, int] = {}
        out, found, held = [], [], 0

        def top(c):
            while up.get(c, c) != c:
                c = up[c] = up.get(up[c], up[c])
            return c

        def check():
            i, j = np.divmod(np.unique(np.concatenate(found)), ids.size)
            for k in range(0, i.size, 200_000):
                tops = np.array([top(r) for r in root.tolist()])
                at = np.flatnonzero(tops[i[k : k + 200_000]] != tops[j[k : k + 200_000]]) + k
                for n in at[inliers_of(feats, i[at], j[at]) >= MIN_INLIERS].tolist():
                    x, y = top(int(root[i[n]])), top(int(root[j[n]]))
                    if x != y:
                        up[x] = y
                        out.append(sorted((int(ids[i[n]]), int(ids[j[n]]))))

        for at, end in zip(start.tolist(), [*start[1:].tolist(), key.size]):
            mine = corner[at:end]
            left, right = (mine[block[image[mine]] == k] for k in (first, second))
            for k in range(0, left.size, 1_000):
                some = left[k : k + 1_000]
                far = sum(np.bitwise_count(words[some, None, w] ^ words[None, right, w]).astype(np.uint16) for w in range(4))
                i, j = np.nonzero((far <= MAX_DISTANCE) & (root[image[some]][:, None] != root[image[right]][None]))
                i, j = image[some[i]], image[right[j]]
                found.append(np.unique(np.minimum(i, j) * ids.size + np.maximum(i, j)))
                held += found[-1].size
                if held > 2_000_000:
                    check()
                    found, held = [], 0
        if held:
            check()
        give_back()
        return pa.table({c: pa.array([v[n] for v in out], pa.int64()) for n, c in enumerate("ab")})

    columns = feats.select("id", "desc")
    long = columns.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > SHORT)
    long = stage(long.select("key"), "long-lists")
    few = lambda t: F.broadcast(t) if t.count() <= BROADCAST_IDS else t  # noqa: E731  # keys and ids only
    held = columns.mapInArrow(deal, "key long, id long").join(few(long), "key")
    held = stage(held.join(few(groups), "id", "left").withColumn("root", F.coalesce("root", "id")), "long-list-entries")
    apart = held.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    buckets = -(-held.count() // ENTRIES_PER_GROUP)
    apart = apart.select("key", F.ceil(F.col("n") / IMAGES_PER_BLOCK).cast("int").alias("blocks"))
    apart = apart.withColumn("bucket", F.when(F.col("blocks") == 1, F.expr(f"pmod(key, {max(1, buckets)}L)")).otherwise(F.col("key")))
    dealt = held.join(apart, "key").withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("bucket", "blocks", "key", "id", "root", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    dealt = dealt.groupBy("bucket", "blocks", "first", "second", "id", "root", "block").agg(F.collect_set("key").alias("keys"))
    dealt = stage(dealt, "long-list-images")
    # features travel COPIES_AT_ONCE times at a time, and their shuffle files go before the next part is dealt
    passes = max(1, -(-dealt.count() // max(1, COPIES_AT_ONCE * feats.count())))
    found = []
    for k in range(passes):
        mine = dealt.where(F.expr(f"pmod(xxhash64(bucket, first, second), {passes}L) = {k}"))
        found.append(stage(mine.join(feats, "id").groupBy("bucket", "blocks", "first", "second").applyInArrow(compare, "a long, b long"), "long-list-links"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = stage(out.distinct(), "long-list-links")
    unstage(dealt, *found)
    unstage(long, held)
    return out


def verified(pairs: DataFrame) -> DataFrame:
    """(a, b) of pairs (a, b and both sides' features) that are copies."""
    import pyarrow as pa

    def work(batches):
        for batch in batches:
            a, b, *f = (batch.column(k).to_pylist() for k in range(8))
            at = np.arange(len(a))
            at = np.flatnonzero(inliers_of([*read_features(*f[:3]), *read_features(*f[3:])], at, at + len(a)) >= MIN_INLIERS).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for k in at], pa.int64()) for x in (a, b)], names=["a", "b"])

    return pairs.mapInArrow(work, "a long, b long")


def links_in_groups(groups: DataFrame, feats: DataFrame) -> DataFrame:
    """(id, n_links) from groups (id, root): how many images of its group an image is a copy of, by all pairs."""
    import pyarrow as pa

    def work(table):
        ids, block, (first, *_), (second, *_) = (table.column(c).to_numpy() for c in ("id", "block", "first", "second"))
        feats = read_features(*(table.column(c).to_pylist() for c in ("xy", "angle", "desc")))
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        i, j = np.nonzero(np.triu(np.ones((left.size, right.size), bool), 1) if first == second else np.ones((left.size, right.size), bool))
        i, j = left[i], right[j]
        ok = inliers_of(feats, i, j) >= MIN_INLIERS
        n = np.bincount(np.concatenate([i[ok], j[ok]]), minlength=ids.size)
        return pa.table({"id": pa.array(ids), "n": pa.array(n.astype(np.int64))})

    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = groups.join(sizes, "root").withColumn("block", F.expr("pmod(xxhash64(id), blocks)").cast("int"))
    dealt = dealt.select("id", "root", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    dealt = dealt.select("id", "root", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    return dealt.join(feats, "id").groupBy("root", "first", "second").applyInArrow(work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n_links"))


def copies(images: DataFrame) -> DataFrame:
    """images (media_id long, image binary) -> media_id, class_id (smallest id it is connected with), n_links (verified
    links of its class of equal bytes to others of its group), n_same (rows with equal bytes)."""
    ship(images.sparkSession)
    keyed = images.select(F.coalesce(F.col("media_id").cast("long"), F.lit(NO_ID)).alias("id"), "image")
    # null images are each their own
    rows = stage(keyed.select("id", F.when(F.col("image").isNotNull(), F.xxhash64("image")).alias("dg")), "digests")
    classes = stage(rows.where("dg is not null").groupBy("dg").agg(F.min("id").alias("rep"), F.count("*").alias("n_same")), "image-classes")
    asked = classes.select(F.col("rep").alias("id"), F.col("dg").alias("_dg"))
    asked = F.broadcast(asked) if classes.count() <= BROADCAST_IDS else asked  # ids only; images aren't dealt below that
    reps = keyed.join(asked, "id").where(F.xxhash64("image") == F.col("_dg"))
    feats = features(reps.select(F.col("_dg").alias("id"), "image"))
    once = rows.count() == rows.select("id").distinct().count()
    feats = stage(feats if once else feats.dropDuplicates(["id"]), "features")
    pairs, members = candidates(feats)
    pairs, side = stage(pairs, "image-pairs"), lambda c: feats.select(F.col("id").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("xy", "angle", "desc")))
    edges = stage(verified(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_xy", "a_angle", "a_desc", "b_xy", "b_angle", "b_desc")), "copies")
    unstage(pairs)
    groups = stage(components(edges), "image-groups")
    more = stage(links_of_long_lists(members, groups, feats).unionByName(links_across_parts(groups, feats)), "copies-of-lists")
    if more.limit(1).count():
        groups = stage(components(edges.unionByName(more)), "image-groups")
    degree = links_in_groups(groups, feats).select(F.col("id").alias("dg"), "n_links")
    roots = groups.select(F.col("id").alias("dg"), "root")
    named = classes.join(roots, "dg", "left").withColumn("root", F.coalesce("root", "dg")).join(degree, "dg", "left")
    least = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = named.join(least, "root").select("dg", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_same")
    back = lambda c: F.when(c == NO_ID, F.lit(None).cast("long")).otherwise(c)
    return rows.join(named, "dg", "left").select(
        back(F.col("id")).alias("media_id"), back(F.coalesce("class_id", "id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_same", F.lit(1)).cast("long").alias("n_same")
    )


SIZE = 96


def draw(name: str) -> np.ndarray:
    """A picture that its name determines: coarse and fine random blocks."""
    rng = np.random.default_rng(zlib.crc32(name.encode()))
    fine = rng.integers(0, 150, (16, 16), np.uint8)
    coarse = rng.integers(0, 90, (8, 8), np.uint8)
    return np.repeat(np.repeat(fine, 6, 0), 6, 1) + np.repeat(np.repeat(coarse, 12, 0), 12, 1)


def edit(img: np.ndarray, how: int, seed: int) -> np.ndarray:
    """0: none; 1: cropped; 2: other brightness; 3: a box over it; 4: framed; 5: noise."""
    if how == 1:
        y, x = 4 + 6 * (seed % 3), 4 + 6 * (seed // 3 % 3)
        return img[y : y + 76, x : x + 76]
    if how == 2:
        return (img.astype(int) * 4 // 5 + 20).astype(np.uint8)
    if how == 3:
        out = img.copy()
        out[2:26, 60:92] = 255
        return out
    if how == 4:
        return np.pad(img, 6)
    if how == 5:
        noise = np.random.default_rng(seed).integers(-3, 4, img.shape)
        return np.clip(img.astype(int) + noise, 0, 255).astype(np.uint8)
    return img


def page_images(pages: DataFrame) -> DataFrame:
    """(media_id, image) of pages, which carry no pictures of their own: each page shows its host's sign or a picture of
    its section, in one of six edits."""
    import pyarrow as pa

    ship(pages.sparkSession)

    def work(batches):
        for batch in batches:
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for k, url in zip(ids, urls, strict=True):
                host = (url or "").split("://")[-1].split("/")[0]
                n = k or 0
                name = host if n % 3 == 0 else f"{host}/{n // 6}"
                out.append(encode_pgm(edit(draw(name), n * 7 // 3 % 6, n)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["media_id", "image"])

    return pages.select(F.col("page_id").cast("long"), "url").mapInArrow(work, "media_id long, image binary")


def op10_media_columns(spark, sf_dir: str) -> DataFrame:
    return copies(page_images(spark.read.parquet(f"{sf_dir}/pages.parquet")))
