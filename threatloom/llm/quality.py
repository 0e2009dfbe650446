"""Quality rules: a linear-chain CRF labels each line content or boilerplate; content share decides retention.

Nobody labels lines, so the CRF learns from documents' labels: ``signature`` proposes boilerplate lines, in good and bad
documents alike, and then fits and relabelling alternate. A relabelling takes the chain's own best labels, signatures
aside, where they agree with the document's label (content holds at least the share in good documents, less in bad ones), else what is nearest to
them and agrees. So labels vary inside documents, and a document of either kind can hold lines of both.

Edge cases: null text is a document without words (fails the base rules); repeated rows are judged row by row;
an empty table gives an empty result; extra columns are ignored. With no usable labels the documented prior
weights ``PRIOR`` are used, so the operator is total. A line of over 400 characters never counts as a notice, which is one
of twelve features (it is judged by the others). Whole texts are read; only the *training* sample is bounded
(``max_train_docs`` labelled documents, the ones with the smallest hashed ids).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.runtime import give_back, ship

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
N_FEATURES = 12
#: Words of notices: licence, copyright, cookie and subscription lines.
NOTICE = ("licens", "licence", "copyright", "rights reserved", "cookie", "subscribe", "privacy policy", "terms of use")
MAX_TRAIN_DOCS = 3000
CONTENT_SHARE = 0.5
#: Emission weights for (content minus boilerplate) and the 2 x 2 transitions used when nothing can be learned.
PRIOR = {"w": [2.0, 0.0, -6.0, -4.0, -3.0, -2.0, 0.5, -4.0, -1.0, 0.0, -4.0, -3.0], "t": [[0.5, -0.5], [-0.5, 0.5]]}
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, n_content_words long, n_lines long, n_content_lines long"
)


def line_features(line: str, again: bool = False) -> list[float]:
    """Features of one line; shares, bounded logarithms and marks. again: it equals an earlier line of its document."""
    words = line.split()
    n = len(words)
    if not n:
        return [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, float(again)]
    chars = len(line)
    symbols = sum(line.count(c) for c in SYMBOLS)
    upper = sum(map(str.isupper, words))
    same = 0
    if n > 1:
        same = sum(map(str.__eq__, words, words[1:]))
    stops = line.count(".") + line.count("?")
    return [
        1.0,
        math.log1p(n) / 4,
        min(1.0, symbols / n),
        upper / n,
        min(1.0, line.count("|") / n),
        min(1.0, line.count("!!") / n),
        1.0 if line.rstrip()[-1:] in ".?!" else 0.0,
        same / n,
        1.0 if n < 3 else 0.0,
        min(1.0, 8 * stops / (chars / 6 + 1)),
        float(is_notice(line)),
        float(again),
    ]


def is_notice(line: str) -> bool:
    low = line[:400].lower() if len(line) <= 400 else ""  # a notice is a short line
    return any(map(low.__contains__, NOTICE))


def signature(x: np.ndarray) -> np.ndarray:
    """Which lines, given their features, look like boilerplate by themselves: symbols, bars, shouting, notices, repeats."""
    return (x[..., 2] > 0.3) | (x[..., 4] > 0.1) | (x[..., 5] > 0.3) | (x[..., 3] > 0.7) | (x[..., 7] > 0.3) | (x[..., 10] > 0) | (x[..., 11] > 0)


def lines_of(text: str | None) -> tuple[list[list[float]], list[int]]:
    """Features and word counts of a text's lines that have a word."""
    seen: set[str] = set()
    out, counts = [], []
    for line in (text or "").split("\n"):
        n = len(line.split())
        if n:
            out.append(line_features(line, line in seen))
            counts.append(n)
            seen.add(line)
    return out, counts


def repeated_words(words: list) -> int:
    """Words inside 8-word windows that occur twice or more in the text, the first occurrence included. Exact."""
    n = len(words)
    if n < 9:
        return 0
    names: dict = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    m, step = len(names), 1
    while step < 8:
        if ids.size <= step:
            return 0
        key = ids[:-step] * m + ids[step:]
        distinct, ids = np.unique(key, return_inverse=True)
        m = distinct.size
        if m == key.size:
            return 0
        step *= 2
    often = np.bincount(ids, minlength=m)[ids] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + 8, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_row(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    repeat = repeated_words(words)
    return (
        n,
        len(text) - sum(text.count(c) for c in SPACE),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeat,
        n < 20 or 100 * repeat > 30 * n,
    )


def viterbi(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best label sequence of a two-label chain. scores: per line, content minus boilerplate. Ties go to content."""
    (t00, t01), (t10, t11) = trans.tolist()
    b, c, back = 0.0, float(scores[0]), []
    for s in scores[1:].tolist():
        stay_b, leave_b, from_b, stay_c = b + t00, c + t10, b + t01, c + t11
        back.append((leave_b >= stay_b, stay_c >= from_b))
        b, c = (leave_b if leave_b >= stay_b else stay_b), s + (stay_c if stay_c >= from_b else from_b)
    label = c >= b
    out = [label]
    for to_b, to_c in reversed(back):
        label = to_c if label else to_b
        out.append(label)
    return np.array(out[::-1])


def line_labels(text: str | None, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """For each line with a word: whether it is content, and its words."""
    x, counts = lines_of(text)
    if not x:
        return np.zeros(0, bool), np.zeros(0, int)
    return viterbi(np.array(x) @ np.asarray(model["w"]), np.asarray(model["t"])), np.array(counts)


def content_words(text: str | None, model: dict) -> tuple[int, int, int, int]:
    """Words in lines labelled content, words in all, lines that have a word, and those labelled content."""
    labels, counts = line_labels(text, model)
    return int(counts[labels].sum()), int(counts.sum()), labels.size, int(labels.sum())


def _agree(labels: np.ndarray, scores: np.ndarray, good: np.ndarray, words: np.ndarray, share: float) -> np.ndarray:
    """The labels nearest to a labelling [pieces, lines] whose content share agrees with the pieces' quality.

    Lines change in the order of their scores, as few as are needed; words are 0 beyond a piece's end.
    """
    total = words.sum(1)
    for k in np.flatnonzero(((labels * words).sum(1) >= share * total) != good):
        mine = np.flatnonzero((words[k] > 0) & (labels[k] != good[k]))
        mine = mine[np.argsort(-scores[k, mine] if good[k] else scores[k, mine], kind="stable")]
        held = (labels[k] * words[k]).sum() + np.cumsum(words[k, mine]) * (1 if good[k] else -1)
        done = np.flatnonzero(held >= share * total[k]) if good[k] else np.flatnonzero(held < share * total[k])
        labels[k, mine[: done[0] + 1 if done.size else mine.size]] = good[k]
    return labels


def _best_paths(scores: np.ndarray, tr: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """viterbi for many pieces [pieces, lines]."""
    n, t = scores.shape
    best, back = np.stack([np.zeros(n), scores[:, 0]], 1), np.zeros((n, t, 2), bool)
    for i in range(1, t):
        come = best[:, :, None] + tr[None]
        back[:, i] = come[:, 1] >= come[:, 0]
        step = come.max(1) + np.stack([np.zeros(n), scores[:, i]], 1)
        best = np.where(mask[:, i, None] > 0, step, best)
    label = best[:, 1] >= best[:, 0]
    out = np.zeros((n, t), bool)
    for i in range(t - 1, -1, -1):
        live = mask[:, i] > 0
        out[:, i] = label & live
        label = np.where(live, np.where(label, back[:, i, 1], back[:, i, 0]), label)
    return out


def _ascend(w, tr, x, mask, y, weight, epochs: int, rate: float, l2: float):
    """Gradient ascent on the conditional log-likelihood of line labels y [pieces, lines]."""
    n, t = mask.shape
    m1, v1, m2, v2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)
    pair = mask[:, 1:] * weight[:, None]
    seen = np.array([[((y[:, :-1] == p) & (y[:, 1:] == q) * 1 > 0).astype(float).ravel() @ pair.ravel() for q in (0, 1)] for p in (0, 1)])
    for step in range(1, epochs + 1):
        s = np.stack([np.zeros((n, t)), x @ w], 2)
        a, b = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        a[:, 0] = s[:, 0]
        for i in range(1, t):
            a[:, i] = np.logaddexp(a[:, i - 1, :1] + tr[0], a[:, i - 1, 1:] + tr[1]) + s[:, i]
            a[:, i] = np.where(mask[:, i, None] > 0, a[:, i], a[:, i - 1])
        for i in range(t - 2, -1, -1):
            nxt = b[:, i + 1] + s[:, i + 1]
            b[:, i] = np.where(mask[:, i + 1, None] > 0, np.logaddexp(nxt[:, :1] + tr[:, 0], nxt[:, 1:] + tr[:, 1]), 0)
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        gold = (y - np.exp(a[:, :, 1] + b[:, :, 1] - z[:, None])) * mask * weight[:, None]
        gw = np.einsum("nt,ntf->f", gold, x) - l2 * w
        gt = np.zeros((2, 2))
        for p in (0, 1):
            for q in (0, 1):
                e = np.exp(a[:, :-1, p] + tr[p, q] + s[:, 1:, q] + b[:, 1:, q] - z[:, None])
                gt[p, q] = seen[p, q] - (e * pair).sum()
        gt -= l2 * tr
        for val, g, m, v in ((w, gw, m1, v1), (tr, gt, m2, v2)):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            val += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        np.clip(tr, -3, 3, out=tr)


def train(rows: list[tuple[str, int]], turns: int = 3, epochs: int = 60, rate: float = 0.15, l2: float = 1e-4, piece: int = 48, share: float = CONTENT_SHARE) -> dict:
    """Fit the CRF from documents' labels alone; long documents are cut into pieces, not truncated."""
    if len({y for _, y in rows}) < 2:
        return PRIOR
    xs, ys, ns = [], [], []
    for text, y in rows:
        lines, counts = lines_of(text)
        for k in range(0, len(lines), piece):
            xs.append(lines[k : k + piece])
            ns.append(counts[k : k + piece])
            ys.append(y)
    if not xs:
        return PRIOR
    n, t = len(xs), max(map(len, xs))
    x, mask, words = np.zeros((n, t, N_FEATURES)), np.zeros((n, t)), np.zeros((n, t), int)
    for i, v in enumerate(xs):
        x[i, : len(v)], mask[i, : len(v)], words[i, : len(v)] = v, 1, ns[i]
    good = np.array(ys) == 1
    # each class counts the same, each piece as the square root of its lines
    weight = 1 / np.sqrt(mask.sum(1))
    for k in (False, True):
        weight[good == k] /= max(1e-9, (weight * mask.sum(1))[good == k].sum())
    w, tr = np.array(PRIOR["w"]), np.array(PRIOR["t"])
    y = _agree(~signature(x) & (mask > 0), x @ w, good, words, share)
    w, tr = np.zeros(N_FEATURES), np.zeros((2, 2))
    for turn in range(turns):
        if turn:
            scores = x @ w
            y = _agree(_best_paths(scores, tr, mask) & ~signature(x), scores, good, words, share)
        _ascend(w, tr, x, mask, y.astype(float), weight, epochs, rate, l2)
    return {"w": w.tolist(), "t": tr.tolist()}


def fit(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> dict:
    """Train on at most max_train_docs labelled documents (smallest hashed ids), the one bounded read of the operator."""
    ids = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .select("doc_id", F.col("quality").alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "_y")
        .limit(max_train_docs)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "_y").toPandas()
    rows = rows.sort_values(["doc_id", "_y"]).drop_duplicates("doc_id")
    return train(list(zip(rows["text"], rows["_y"].astype(int), strict=True)))


def label_quality(docs: DataFrame, model: dict, share: float = CONTENT_SHARE) -> DataFrame:
    """One row per document row: the base statistics, whether they failed, and the verdict."""
    import pyarrow as pa

    ship(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ") for x in x.split(",") if x.strip()]

    def judge(batches):
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = base_row(text)
                good, total, lines, content = (0, 0, 0, 0) if base[5] else content_words(text, model)
                rows.append((key, *base, not base[5] and good >= share * total, good, lines, content))
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, SCHEMA)


def keep_good(docs: DataFrame, model: dict, share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of docs that label_quality keeps, with all their columns."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def judge(batches):
        for batch in batches:
            keep = []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                good, total, *_ = (0, 1) if base_row(text)[5] else content_words(text, model)
                keep.append(good >= share * total)
            yield batch.filter(pa.array(keep, pa.bool_()))
        give_back()

    return docs.mapInArrow(judge, docs.schema)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return label_quality(docs, fit(docs, labels))
