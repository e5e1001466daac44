"""Language identification by error-correcting output codes.

Every language has a codeword of bits.  One linear classifier for each bit reads a
text's n-grams of 1 to 4 bytes and gives the log odds of that bit; the language whose
codeword loses least is chosen, where each bit's loss weighs as the classifier was
right on that language's training texts.  With 5 languages or fewer all splits into
two are bits; with more, codewords are the best of TRIES fixed draws, by their least
distance.

Bytes are lower-cased (A-Z); digits, marks and white space read as one blank, and an
n-gram without a letter does not count.  n-grams fall into BUCKETS hashed buckets; a
text is the square roots of its shares, so length plays no part in the sum of squares.

Training takes at most MAX_DOCS documents, as many of each language (those with the
smallest digests of their ids), each whole and by one fragment; that bound is the one
sample here.  Scoring reads every text whole.  Languages are all values that such
documents have, MAX_DOCS at most.

A prediction is ambiguous where the second codeword's loss is within `margin` of the
first's.  The score is the chosen codeword's share of exp(-bits * loss).

Edge cases: null texts and texts without a letter are und, with score 0; a null id is
not held out; documents without a language teach nothing; a document in several
languages, by rows that share its id, teaches each; of several texts of one id and
language the least is taken; with one language learned all texts with letters have
it, with none all are und; ties go to the language that is first by code point;
repeated rows are scored alike; a very long text is read whole, in a chunk of its
own; extra columns are ignored and may have any name; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.llm import textkernels as K

MAX_DOCS = 1000
BUCKETS = 1 << 13
ORDERS = (1, 2, 3, 4)
CHUNK_DOCS, FRAGMENT = 64, 80
TRIES = 200

_CLASS = np.full(256, 32, np.uint8)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)
_FACTORS = [2654435761, 2246822519, 3266489917, 668265263]


def gram_counts(c: K.Chunk) -> np.ndarray:
    """Counts of n-grams, documents x BUCKETS."""
    data, n = _CLASS[c.data], len(c)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(c.offsets))
    room = c.offsets[1:][doc] - np.arange(len(data)) if len(data) else np.zeros(0, np.int64)
    wide, letter = data.astype(np.uint32), data != 32
    total = np.zeros(n * (BUCKETS + 1), np.int64)
    for k in ORDERS:
        m = len(data) - k + 1
        if m <= 0:
            break
        h, some = np.full(m, k * 374761393 % 2**32, np.uint32), np.zeros(m, bool)
        for j in range(k):
            h = (h ^ wide[j : j + m]) * np.uint32(_FACTORS[j])
            h ^= h >> np.uint32(15)
            some |= letter[j : j + m]
        place = np.where(some & (room[:m] >= k), (h % np.uint32(BUCKETS)).astype(np.int32), BUCKETS)
        total += np.bincount(doc[:m] * (BUCKETS + 1) + place, minlength=len(total))
    return total.reshape(n, BUCKETS + 1)[:, :BUCKETS]


def profiles(c: K.Chunk) -> np.ndarray:
    """Square roots of shares of n-grams, documents x BUCKETS."""
    counts = gram_counts(c)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def _parts(column: pa.Array):
    for c in K.chunks(column):
        for a in range(0, len(c), CHUNK_DOCS):
            b = min(a + CHUNK_DOCS, len(c))
            yield K.Chunk(c.lo + a, c.lo + b, c.data[c.offsets[a] : c.offsets[b]], c.offsets[a : b + 1] - c.offsets[a])


def codewords(n: int) -> np.ndarray:
    """Codewords of n languages, n x bits of -1 and 1; no bit is alike for all."""
    if n <= 5:
        bits = [[1 if k == 0 or split >> (k - 1) & 1 else -1 for k in range(n)] for split in range(2 ** (n - 1) - 1)]
        return np.array(bits, np.int8).T.reshape(n, -1)
    rng, length = np.random.default_rng(12), max(15, int(np.ceil(10 * np.log2(n))))
    best, most = None, -1
    for _ in range(TRIES):
        code = rng.choice(np.array([-1, 1], np.int8), (n, length))
        apart = (length - code.astype(np.int32) @ code.T) // 2
        least = int(apart[~np.eye(n, dtype=bool)].min())
        # a bit that all languages share teaches nothing
        if least > most and (np.abs(code.sum(axis=0)) < n).all():
            best, most = code, least
    return best


@dataclass
class Coder:
    """Languages, their codewords, the bits' weights and offsets, and how far each bit is trusted for each language."""

    langs: list[str]
    code: np.ndarray
    weight: np.ndarray
    offset: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss of each codeword, texts x languages."""
        odds = x @ self.weight + self.offset
        signed = self.code[None].astype(np.float64) * odds[:, None, :]
        return (self.trust[None] * np.logaddexp(0, -signed)).sum(axis=2)

    def decode(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the chosen language, score, whether it is ambiguous."""
        loss = np.round(self.losses(x), 9)
        best = loss.argmin(axis=1)
        least = loss[np.arange(len(loss)), best]
        share = np.exp(-self.code.shape[1] * (loss - least[:, None]))
        second = np.partition(loss, 1, axis=1)[:, 1] if len(self.langs) > 1 else least + np.inf
        return best, np.round(1 / share.sum(axis=1), 6), second - least < margin


def fit(x: np.ndarray, lang: list[str], steps: int = 150, rate: float = 0.5, decay: float = 1e-5) -> Coder:
    """Logistic regression of every bit at once, languages weighing alike."""
    langs = sorted(set(lang))
    place = np.array([langs.index(k) for k in lang])
    code = codewords(len(langs))
    y = code[place].astype(np.float32)
    weigh = (1 / np.bincount(place)[place] / len(langs)).astype(np.float32)[:, None]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, b)]
    for k in range(1, steps + 1):
        pull = weigh * y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        for p, g, m in zip((w, b), (x.T @ pull - decay * w, pull.sum(axis=0)), moments, strict=True):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            p += rate * (m[0] / (1 - 0.9**k)) / (np.sqrt(m[1] / (1 - 0.99**k)) + 1e-8)
    right = (y * (x @ w + b) > 0).astype(np.float64)
    trust = np.array([right[place == k].mean(axis=0) for k in range(len(langs))]) + 1e-3
    return Coder(langs, code, w.astype(np.float64), b.astype(np.float64), trust / trust.sum(axis=1, keepdims=True) if code.shape[1] else trust)


def _fragment(text: bytes) -> bytes:
    """FRAGMENT bytes of a text, from a place that its length gives."""
    at = len(text) * 2654435761 % max(1, len(text) - FRAGMENT + 1)
    return text[at : at + FRAGMENT]


def _training_rows(batches):
    for batch in batches:
        whole = batch.column("t").to_pylist()
        for lang, texts in ((batch.column("lang"), whole), (batch.column("lang"), [_fragment(t) for t in whole])):
            for c in _parts(pa.array(texts, pa.large_binary())):
                x = profiles(c).astype(np.float16)
                yield pa.RecordBatch.from_arrays([lang.slice(c.lo, len(c)), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", salts: int = 64) -> Coder | None:
    """The model, or None where no document has a language."""
    key, lang, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{lang_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    known = docs.select(key.alias("k"), lang.alias("lang")).filter("lang is not null").filter(~held_out(F.col("k")))
    known = known.withColumn("digest", F.md5(F.coalesce(F.col("k").cast("string"), F.lit(""))))
    order = ["digest", F.col("k").asc_nulls_last()]
    # the first of each language within salts, then of those; max_docs languages at most
    first = known.distinct().withColumn("place", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("k"), F.lit(salts))).orderBy(*order))).filter(F.col("place") <= max_docs)
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= max_docs)
    some = first.orderBy("place", "lang").limit(max_docs).select("k", "lang")
    texts = docs.select(key.alias("k"), lang.alias("lang"), text.alias("t")).filter(_has_letter(F.col("t")))
    same = F.col("s.k").eqNullSafe(F.col("d.k")) & (F.col("s.lang") == F.col("d.lang"))
    rows = texts.alias("d").join(F.broadcast(some.alias("s")), same).groupBy("d.k", "d.lang").agg(F.min("t").cast("binary").alias("t")).select("lang", "t")
    rows = sorted(((r["lang"], bytes(r["x"])) for r in rows.mapInArrow(_training_rows, "lang string, x binary").collect()))
    if not rows:
        return None
    return fit(np.stack([np.frombuffer(x, np.float16) for _, x in rows]).astype(np.float32), [k for k, _ in rows])


def _predictions(model: Coder | None, margin: float):
    def run(batches):
        for batch in batches:
            known = batch.column("known").to_numpy(zero_copy_only=False)
            for c in _parts(batch.column("t")):
                spoken = known[c.lo : c.hi]
                if model is None:
                    names, score, unsure = ["und"] * len(c), np.zeros(len(c)), np.zeros(len(c), bool)
                else:
                    best, score, unsure = model.decode(profiles(c), margin)
                    names = [model.langs[k] if s else "und" for k, s in zip(best.tolist(), spoken.tolist(), strict=True)]
                    score, unsure = np.where(spoken, score, 0.0), unsure & spoken
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(c.lo, len(c)), pa.array(names, pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return run


def predict_language(docs: DataFrame, model: Coder | None, margin: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous), a row for each row of docs."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _has_letter(text).alias("known"), text.cast("binary").alias("t"))
    out = rows.mapInArrow(_predictions(model, margin), "doc_id long, lang_pred string, score double, ambiguous boolean")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
