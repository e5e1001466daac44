"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad.  A line's potential depends on its
own features and on those of the lines before and after; neighbouring labels are
tied by a learned transition.  Forward-backward gives each line's probability of
being good; their mean, weighted by line length, is the document's raw quality,
and a two-parameter logistic fitted on the same training documents makes it a
probability.

Training takes at most `max_docs` labelled documents and `max_bytes` of their
text, those with the smallest digests of their ids (the bounds are the one sample
here; scoring reads every line of every text).  Lines start with their document's label; after a first fit, lines
of bad documents that the model takes for good are relabelled, and it is fitted
again.  Lines are features of bytes only: no id, language, source or label.

Edge cases: null or empty text is one empty line and gets a score like any other;
a null id is not held out; several labels of one id count as bad if any is, and of
several texts of one id the least is taken for training; with no labels, or one
kind alone, every score is the share of good documents (0.5 with none); repeated
rows are scored alike, and ties play no part; a very long text is scored whole, in
a chunk of its own, and one beyond max_bytes trains nothing; extra columns are
ignored and may have any name; an empty table gets no scores.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.llm import textkernels as K

MAX_DOCS, MAX_BYTES = 6000, 64 << 20
NAMES = ("length", "symbols", "pipes", "bangs", "upper", "digits", "spaces", "other", "end_mark", "empty", "repeats", "distinct", "word_length", "seen_before")


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256, np.uint8)
    m[list(chars)] = 1
    return m


_CLASSES = [_mask(b"#*$%&<>~^=_\\"), _mask(b"|"), _mask(b"!"), _mask(bytes(range(65, 91))), _mask(bytes(range(48, 58))), _mask(b" \t\x0b\x0c\r"), _mask(b"'\"()[]{}:;-+/@,.?")]
_LETTER = _mask(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_END = _mask(b".!?:;\"')]}\xa6\x9d\xbb")


def line_features(c: K.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes, and the first line of each document (and the end)."""
    at = np.arange(len(c))
    cuts = np.flatnonzero(c.data == 10)
    doc = np.searchsorted(c.offsets, cuts, "right") - 1
    # a line starts at each document's start and after each of its \n
    starts = np.concatenate([c.offsets[:-1], cuts + 1])
    owner = np.concatenate([at, doc])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    first = np.searchsorted(owner, np.arange(len(c) + 1))
    ends = np.append(starts[1:] - 1, len(c.data))
    last = first[1:] - 1
    ends[last] = c.offsets[1:]
    size = ends - starts
    n = np.maximum(size, 1)
    full = np.append(c.data, 0)

    def count(mask):
        total = np.concatenate([[0], np.cumsum(mask[full], dtype=np.int64)])
        return total[ends] - total[starts]

    shares = [count(m) for m in _CLASSES]
    letters = count(_LETTER)
    w = K.split_words(c)
    h = K.word_hashes(c, w)
    line = np.searchsorted(starts, w.starts, "right") - 1
    # among lines that start at one place (empty documents) the last holds the words; it is the only one with bytes
    words = np.bincount(line, minlength=len(starts))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line[same], minlength=len(starts))
    key = (line.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
    key.sort()
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=len(starts))
    # a line's hash: that of its words in order
    place = np.arange(len(h)) - np.concatenate([[0], np.cumsum(words)])[line]
    whole = np.zeros(len(starts), np.uint64)
    np.add.at(whole, line, h * K.mix(place.astype(np.uint64) + np.uint64(77)))
    rank = np.lexsort((np.arange(len(starts)), whole, owner))
    seen = np.zeros(len(starts), bool)
    seen[rank[1:]] = (whole[rank[1:]] == whole[rank[:-1]]) & (owner[rank[1:]] == owner[rank[:-1]]) & (words[rank[1:]] > 0)
    x = np.stack(
        [
            np.log1p(size) / 8, *[s / n for s in shares[:3]], shares[3] / np.maximum(letters, 1), shares[4] / n, shares[5] / n, 1 - (letters + sum(shares) - shares[3]) / n,
            (_END[full[np.maximum(ends - 1, 0)]] > 0) & (size > 0), size == 0, repeats / np.maximum(words, 1), distinct / np.maximum(words, 1), np.minimum((letters / np.maximum(words, 1)) / 10, 3), seen,
        ],
        axis=1,
    )
    return x.astype(np.float32), size, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zero at a text's ends), and flags for the ends."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    begin, end = first[:-1], first[1:] - 1
    before[begin], after[end] = 0, 0
    ends = np.zeros((len(x), 2), np.float32)
    ends[begin, 0] = 1
    ends[end, 1] = 1
    return np.concatenate([x, before, after, ends, np.ones((len(x), 1), np.float32)], axis=1)


def forward_backward(e: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected label pairs (2 x 2), and the log partition sum.

    e: log odds of good of each line; trans[i, j]: log weight of label j after i.
    All texts advance together, the longest first, so a step handles those that still have lines.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    start, n = first[:-1][order], n[order]
    steps = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(steps), "left")
    t = np.exp(trans)
    e = np.clip(e, -30, 30)
    psi = np.stack([np.exp(-e / 2), np.exp(e / 2)], axis=1)
    alpha, beta = np.empty((len(e), 2)), np.ones((len(e), 2))
    log_z = 0.0
    for k in range(steps):
        i = start[: active[k]] + k
        a = psi[i] if k == 0 else (alpha[i - 1] @ t) * psi[i]
        s = a.sum(axis=1, keepdims=True)
        alpha[i] = a / s
        log_z += float(np.log(s).sum())
    for k in range(steps - 2, -1, -1):
        i = start[: active[k + 1]] + k
        b = (psi[i + 1] * beta[i + 1]) @ t.T
        beta[i] = b / b.sum(axis=1, keepdims=True)
    p = alpha * beta
    p /= p.sum(axis=1, keepdims=True)
    inner = np.ones(len(e), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    j = np.flatnonzero(inner)
    pair = alpha[j - 1][:, :, None] * t[None] * (psi[j] * beta[j])[:, None, :]
    pair /= np.maximum(pair.sum(axis=(1, 2), keepdims=True), 1e-300)
    return p[:, 1], pair.sum(axis=0), log_z


class LineField:
    """The fitted model: weights of standardised features, transitions, and the logistic of documents."""

    def __init__(self, mean, scale, w, trans, slope, offset):
        self.mean, self.scale, self.w, self.trans, self.slope, self.offset = mean, scale, w, trans, slope, offset

    def lines(self, x, first):
        return forward_backward(((x - self.mean) / self.scale) @ self.w, self.trans, first)[0]

    def raw(self, x, size, first):
        p, weight = self.lines(x, first), size + 1.0
        return np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])

    def score(self, x, size, first):
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x, size, first) + self.offset, -40, 40)))


def _climb(params, gradient, steps, rate=0.1):
    """Adam ascent."""
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    for k in range(1, steps + 1):
        for p, g, a, b in zip(params, gradient(*params), m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
    return params


def fit(x: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = 150) -> LineField:
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale < 1e-6, 1, scale)
    mean[-1], scale[-1] = 0, 1
    z = ((x - mean) / scale).astype(np.float64)
    doc = np.repeat(np.arange(len(label)), np.diff(first))
    y = label[doc].astype(float)
    share = np.clip(label.mean(), 0.05, 0.95)
    # both kinds of documents weigh alike
    weight = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))[doc]
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    j = np.flatnonzero(inner)
    w, trans = np.zeros(z.shape[1]), np.zeros((2, 2))
    for _ in range(2):
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[j - 1].astype(int), y[j].astype(int)), 1)

        def gradient(w, trans, y=y, seen=seen):
            p, pairs, _ = forward_backward(z @ w, trans, first)
            return ((weight * (y - p)) @ z - 0.5 * w) / len(y), (seen - pairs - 2.0 * trans) / len(y)

        w, trans = _climb([w, trans], gradient, steps)
        # lines of bad documents that look good by themselves
        own = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        y = np.where(label[doc] == 1, 1.0, (own > 0.5).astype(float))
    model = LineField(mean, scale, w, trans, 1.0, 0.0)
    raw = model.raw(x, size, first)
    a, b = np.array([4.0]), np.array([-2.0])
    doc_weight = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))

    def slope(a, b):
        d = doc_weight * (label - 1 / (1 + np.exp(-np.clip(a * raw + b, -40, 40))))
        return np.array([d @ raw - 0.01 * a[0]]) / len(label), np.array([d.sum()]) / len(label)

    a, b = _climb([a, b], slope, 400)
    model.slope, model.offset = float(a[0]), float(b[0])
    return model


def _training_rows(batches):
    for batch in batches:
        for c in K.chunks(batch.column(1)):
            x, size, first = line_features(c)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(c.lo, len(c)), pa.array([x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()), pa.array([size[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["label", "x", "size"]
            )


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineField | float:
    """A model, or the share of good documents where there are no two kinds to tell apart."""
    key = F.col(f"`{id_col}`").cast("long")
    known = labels.select(key.alias("k"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("k is not null and label in (0, 1)")
    known = known.filter(~held_out(F.col("k"))).groupBy("k").agg(F.min("label").alias("label"))
    some = known.orderBy(F.md5(F.col("k").cast("string")), "k").limit(max_docs)
    text = docs.select(key.alias("k"), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("t"))
    # sizes first, max_docs small rows, so that the texts taken have a bound too
    sizes = text.join(F.broadcast(some), "k").groupBy("k", "label").agg(F.max(F.octet_length("t")).alias("n")).collect()
    sizes.sort(key=lambda r: (hashlib.md5(str(r["k"]).encode()).hexdigest(), r["k"]))
    room, taken = max_bytes, []
    for r in sizes:
        if r["n"] <= room:
            room -= r["n"]
            taken.append((r["k"], r["label"]))
    own = F.broadcast(docs.sparkSession.createDataFrame(taken, "k long, label int"))
    rows = text.join(own, "k").groupBy("k", "label").agg(F.min("t").alias("t")).select("label", "t").mapInArrow(_training_rows, "label int, x binary, size binary").collect()
    rows.sort(key=lambda r: (bytes(r["x"]), r["label"]))
    label = np.array([r["label"] for r in rows])
    if len(set(label.tolist())) < 2:
        return float(label.mean()) if len(label) else 0.5
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, len(NAMES)) for r in rows])
    size = np.concatenate([np.frombuffer(r["size"], np.int64) for r in rows])
    first = np.concatenate([[0], np.cumsum([len(r["size"]) // 8 for r in rows])])
    return fit(with_neighbours(x, first), size, first, label)


def _scores(model):
    def run(batches):
        for batch in batches:
            for c in K.chunks(batch.column(1)):
                if isinstance(model, float):
                    s, n = np.full(len(c), model), np.zeros(len(c), np.int64)
                else:
                    x, size, first = line_features(c)
                    s, n = np.round(model.score(with_neighbours(x, first), size, first), 9), np.diff(first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, len(c)), pa.array(s, pa.float64()), pa.array(n, pa.int64())], ["doc_id", "score", "n_lines"])

    return run


def score_quality(docs: DataFrame, model: LineField | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, n_lines), a row for each row of docs."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    out = rows.mapInArrow(_scores(model), "doc_id long, score double, n_lines long")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines")
