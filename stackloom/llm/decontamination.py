"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all 32-word passages of the corpus.
2. A randomised SVD of the TF-IDF matrix A (passages x features): every task
   adds its part of Z = A'(A W) for one fixed random W; with M = A'A the
   decomposition of M follows from Z and W alone (single-pass Nystroem form), so
   the corpus is read once for it.  Z has FEATURES x SKETCH entries whatever the
   corpus holds, and is summed by blocks of features across tasks.
3. Windows of 16, 32 or 64 words, every 8 words, over whole texts are projected
   on the leading right singular vectors, scaled to unit variance, and compared
   by cosine with the benchmark items of about their length.
4. Windows over the threshold whose surroundings (an item's length on either side) hold as many of the item's rarer
   words as any long enough subsequence has are checked word by word: the longest common
   subsequence of item and surroundings, and the share of the item's answer (its
   last sentence) found there.  An item leaks if the subsequence
   covers lcs_exact of the item, or lcs_paraphrase with most of the answer.

The benchmark is a table of fixed size; it is still taken in blocks of
ITEM_BLOCK items, each a further read of the corpus, so that what a task holds
is bounded.  Nothing but Z, frequencies and matches leaves a task.

Words here are runs of bytes other than white space and ASCII punctuation, A-Z
lower-cased.

Edge cases: null or empty texts match nothing; items without words match
nothing; an item of fewer than 8 words must be found in full; repeated rows give
a match each, and a null id is carried along; a very long text is searched whole,
in groups of GROUP_WORDS words; of equally long subsequences for one document and
item the first in the text is reported; extra columns of both tables are ignored
and may have any name; an empty corpus or benchmark gives no matches.
decontaminate() judges each row by its own text, whatever its id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm import textkernels as K

FEATURES = 4096
SKETCH = 36
RANK = 28
LEADING = 4
PASSAGE = 32
STEP = 8
SCALES = (16, 32, 64)
ITEM_BLOCK = 2000
GROUP_WORDS = 1 << 16
#: Tables of a task are cut in PARTS, and added in SLOTS groups of tasks before they are added up.
PARTS, SLOTS = 16, 64
#: Sums of fractions are kept as whole multiples of 1 / SCALE, so they don't depend on the order of arrival.
SCALE = 1 << 10

BREAK = K.WHITE.copy()
BREAK[[c for c in range(33, 128) if not chr(c).isalnum()]] = True


def _hashed(c: K.Chunk) -> tuple[K.Words, np.ndarray]:
    w = K.split_words(c, BREAK)
    return w, K.word_hashes(c, w, white=BREAK)


def _features(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(52)).astype(np.uint16)


def _passages(first: np.ndarray) -> np.ndarray:
    """Starts of PASSAGE-word passages that don't cross documents."""
    n = np.diff(first)
    per = -(-n // PASSAGE)
    at = np.concatenate([[0], np.cumsum(per)])
    return np.repeat(first[:-1], per) + (np.arange(at[-1]) - np.repeat(at[:-1], per)) * PASSAGE


def _slices(table: np.ndarray) -> pa.RecordBatch:
    slot = TaskContext.get().partitionId() % SLOTS
    return pa.RecordBatch.from_arrays([pa.array([slot] * PARTS, pa.int32()), pa.array(range(PARTS), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in table.reshape(PARTS, -1)], pa.binary())], ["slot", "part", "sums"])


def _frequency_parts(batches):
    total, passages = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for c in K.chunks(batch.column(0)):
            w, h = _hashed(c)
            if not len(h):
                continue
            s = _passages(w.first)
            of = np.repeat(np.arange(len(s)), np.diff(np.append(s, len(h))))
            key = of * FEATURES + _features(h)
            key.sort()
            key = key[np.append(True, key[1:] != key[:-1])]
            total += np.bincount(key % FEATURES, minlength=FEATURES)
            passages += len(s)
    # every slice brings the number of passages along
    yield _slices(np.concatenate([total.reshape(PARTS, -1), np.full((PARTS, 1), passages)], axis=1))


def _sketch_parts(idf: np.ndarray):
    def run(batches):
        w = np.ascontiguousarray((_omega() * idf[:, None]).T.astype(float))
        z = np.zeros((SKETCH, FEATURES))
        for batch in batches:
            for c in K.chunks(batch.column(0)):
                words, h = _hashed(c)
                if not len(h):
                    continue
                f, s = _features(h), _passages(words.first)
                for lo in range(0, len(s), GROUP_WORDS // PASSAGE):
                    some = s[lo : lo + GROUP_WORDS // PASSAGE]
                    a = some[0]
                    b = s[lo + len(some)] if lo + len(some) < len(s) else len(h)
                    g = f[a:b].astype(np.intp)
                    of = np.repeat(np.arange(len(some)), np.diff(np.append(some, b)))
                    for k in range(SKETCH):
                        y = np.bincount(of, weights=w[k][g], minlength=len(some))
                        z[k] += np.bincount(g, weights=y[of], minlength=FEATURES)
        yield _slices(np.rint(z.T * idf[:, None] * SCALE))

    return run


def _add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column("sums"):
            own = np.frombuffer(x.as_buffer(), "<i8")
            total = own.copy() if total is None else total + own
    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([total.tobytes()], pa.binary())], [*["slot", "part"][2 - len(key) :], "sums"])


def _summed(text: DataFrame, parts) -> np.ndarray | None:
    """The sum of all tasks' tables, PARTS x -1, as a tree of two levels."""
    rows = text.mapInArrow(parts, "slot int, part int, sums binary").groupBy("slot", "part").applyInArrow(_add, "slot int, part int, sums binary")
    rows = rows.groupBy("part").applyInArrow(_add, "part int, sums binary").collect()
    if not rows:
        return None
    return np.stack([np.frombuffer(r["sums"], "<i8") for r in sorted(rows, key=lambda r: r["part"])])


def _omega() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((FEATURES, SKETCH)).astype(np.float32)


def fit_latent_space(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """A FEATURES x RANK table, a word's contribution to the latent vector of its passage, and the inverse document frequencies."""
    text = docs.select(F.col(f"`{text_col}`").cast("binary").alias("t"))
    sums = _summed(text, _frequency_parts)
    if sums is None:
        return np.zeros((FEATURES, RANK), np.float32), np.ones(FEATURES)
    idf = np.log((1 + sums[0, -1]) / (1 + sums[:, :-1].ravel())) + 0.01
    z = _summed(text, _sketch_parts(idf)).reshape(FEATURES, SKETCH) / SCALE
    # M = A'A ~ Z (W'Z)^-1 Z'; its eigenvectors are A's right singular vectors
    omega = _omega().astype(float)
    core = omega.T @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(), 0) * 1e-10
    if not good.any():
        return np.zeros((FEATURES, RANK), np.float32), idf
    half = z @ (vectors[:, good] / np.sqrt(values[good]))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    table = np.zeros((FEATURES, RANK), np.float32)
    k = min(RANK + LEADING, int((s > s[0] * 1e-6).sum()))
    # the leading directions tell languages apart and little else; division by A's singular values makes the others count alike
    lead = min(LEADING, max(k - RANK, 0))
    table[:, : k - lead] = u[:, lead:k] / s[lead:k] * idf[:, None] ** 2
    return table, idf


def lcs_length(item: np.ndarray, other: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[int, int] = {}
    for i, x in enumerate(item.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for y in other.tolist():
        m = masks.get(y)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(item) - row.bit_count()


class _Items:
    """Benchmark items, ordered by the window length they are searched with."""

    def __init__(self, items: list[tuple[int, str]], table: np.ndarray, idf: np.ndarray, lcs_paraphrase: float):
        self.words, self.answer, self.ids = [], [], []
        for c in K.chunks(pa.array([t for _, t in items], pa.string()), 1 << 62):
            w, h = _hashed(c)
            for d in range(len(c)):
                a, b = w.first[d], w.first[d + 1]
                if a == b:
                    continue
                ends = [j for j in range(a, b - 1) if any(ch in b".?!" for ch in c.data[w.ends[j] : w.starts[j + 1]].tobytes())]
                self.words.append(h[a:b])
                self.answer.append(h[(ends[-1] + 1) if ends else a : b])
                self.ids.append(items[c.lo + d][0])
        n = np.array([len(x) for x in self.words], int)
        scale = np.where(n <= 24, 0, np.where(n <= 48, 1, 2))
        order = np.argsort(scale, kind="stable")
        self.words, self.answer, self.ids = ([x[k] for k in order] for x in (self.words, self.answer, self.ids))
        self.length, self.cuts = n[order], np.searchsorted(scale[order], np.arange(len(SCALES) + 1))
        # words in more than a tenth of all passages tell nothing apart; an item of such words alone keeps them
        common = idf < np.log(10)
        has = np.zeros((len(order), FEATURES), np.uint8)
        self.rare = np.zeros(len(order), int)
        vectors = np.zeros((len(order), RANK), np.float32)
        for k, x in enumerate(self.words):
            f = _features(x)
            vectors[k] = table[f].sum(axis=0)
            own = f[~common[f]] if (~common[f]).any() else f
            has[k, own] = 1
            self.rare[k] = len(own)
        # the rarer words that are in any subsequence of the length asked for
        self.least = self.rare - self.length + np.where(self.length < 8, self.length, np.ceil(lcs_paraphrase * self.length - 1e-9).astype(int))
        self.rare_by_feature = np.ascontiguousarray(has.T)
        self.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)


class _Searcher:
    """Matches of one block of items, batch by batch; made again in each task."""

    def __init__(self, items: list[tuple[int, str]], table: np.ndarray, idf: np.ndarray, cosine: float, lcs_exact: float, lcs_paraphrase: float, answer_share: float):
        self.args, self.limits = (items, table, idf, lcs_paraphrase), (cosine, lcs_exact, lcs_paraphrase, answer_share)

    def batches(self, batches, column: int):
        """Each batch with its matches: (row, item, cosine, lcs share, answer share, from, to)."""
        it, table = _Items(*self.args), self.args[1]
        counted = [np.unique(x, return_counts=True) for x in it.words]
        for batch in batches:
            out = []
            for c in K.chunks(batch.column(column)) if it.ids else ():
                w, h = _hashed(c)
                if len(h):
                    out += [(d + c.lo, it.ids[i], *x) for d, i, *x in _matches(it, counted, table, w.first, h, *self.limits)]
            yield batch, out

    def matches(self, batches):
        types = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        for batch, found in self.batches(batches, 1):
            if found:
                row, *rest = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(x, t) for x, t in zip(rest, types, strict=True))], ["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "word_from", "word_to"])

    def clean(self, column: int):
        def run(batches):
            for batch, found in self.batches(batches, column):
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in found]] = False
                yield batch.filter(pa.array(keep))

        return run


def _block_sums(table: np.ndarray, f: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of table rows over the words start..end of each block, STEP words at most."""
    out = table[f[start]]
    for j in range(1, STEP):
        at = start + j
        ok = at < end
        if ok.all():
            out += table[f[at]]
        else:
            out[ok] += table[f[at[ok]]]
    return out


def _matches(it, counted, table, first, h, cosine, lcs_exact, lcs_paraphrase, answer_share):
    f, n = _features(h), np.diff(first)
    per = -(-n // STEP)
    at = np.concatenate([[0], np.cumsum(per)])
    doc = np.repeat(np.arange(len(n)), per)
    block = np.arange(at[-1]) - at[doc]
    start = first[doc] + block * STEP
    end = np.minimum(start + STEP, first[doc + 1])
    best: dict[tuple[int, int], tuple] = {}
    more = SCALES[-1] // STEP - 1
    around = -(-int(it.length.max()) // STEP) + 1
    for lo in range(0, len(start), GROUP_WORDS // STEP):
        # a group of blocks with the blocks that its last windows need; a window belongs where it starts
        hi = min(lo + GROUP_WORDS // STEP, len(start))
        top = min(hi + more, len(start))
        sums = np.concatenate([_block_sums(table, f, start[lo:top], end[lo:top]), np.zeros((more, RANK), np.float32)])
        # running counts of each item's rarer words, over the group and what surrounds its windows
        back, ahead = max(lo - around, 0), min(top + around, len(start))
        held = np.zeros((ahead - back + 1, len(it.ids)), np.uint32)
        np.cumsum(_block_sums(it.rare_by_feature, f, start[back:ahead], end[back:ahead]), axis=0, dtype=np.uint32, out=held[1:])
        left = per[doc[lo:hi]] - block[lo:hi]
        for k, scale in enumerate(SCALES):
            a, b = it.cuts[k], it.cuts[k + 1]
            if a == b:
                continue
            m, n_blocks = hi - lo, scale // STEP
            v = sums[:m].copy()
            for j in range(1, n_blocks):
                v += sums[j : j + m]
            # a window cut short by the end of its text counts only where the text has no full one
            short = np.flatnonzero((block[lo:hi] == 0) & (left < n_blocks))
            for j in range(1, n_blocks):
                out = short[left[short] <= j]
                v[out] -= sums[out + j]
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
            cos = v @ it.vectors[a:b].T
            good = cos >= cosine
            good[(block[lo:hi] > 0) & (left < n_blocks)] = False
            r, i = np.nonzero(good)
            # a subsequence that is long enough leaves out no more rarer words than words
            margin = -(-it.length[a + i] // STEP)
            from_, to = np.maximum(lo + r - margin, at[doc[lo + r]]), np.minimum(lo + r + n_blocks + margin, at[doc[lo + r] + 1])
            enough = (held[to - back, a + i] - held[from_ - back, a + i]).astype(np.int64) >= it.least[a + i]
            r, i = r[enough], i[enough]
            for x, y, z in zip((lo + r).tolist(), (a + i).tolist(), cos[r, i].tolist(), strict=True):
                d = int(doc[x])
                m = len(it.words[y])
                known = best.get((d, y))
                if known and known[3] >= lcs_exact:
                    continue
                a, b = max(int(first[d]), int(start[x]) - m), min(int(first[d + 1]), int(start[x]) + scale + m)
                near = h[a:b]
                own, times = counted[y]
                place = np.minimum(np.searchsorted(own, near), len(own) - 1)
                inside = own[place] == near
                some = near[inside]
                # no subsequence is longer than the words, with their counts, that both hold
                if len(some) / m < lcs_paraphrase or np.minimum(np.bincount(place[inside], minlength=len(own)), times).sum() / m < lcs_paraphrase:
                    continue
                lcs = lcs_length(it.words[y], some) / m
                if lcs < (lcs_paraphrase if m >= 8 else 1.0):
                    continue
                answer = float(np.isin(it.answer[y], some).mean()) if len(it.answer[y]) else 0.0
                if lcs < lcs_exact and answer < answer_share:
                    continue
                if known is None or lcs > known[3]:
                    best[d, y] = (d, y, round(z, 6), lcs, answer, a - int(first[d]), b - int(first[d]))
    return best.values()


def _searchers(docs: DataFrame, benchmark: DataFrame, text_col: str, item_id_col: str, item_text_col: str, *limits: float) -> Iterator[_Searcher]:
    items = benchmark.select(F.col(f"`{item_id_col}`").cast("long").alias("i"), F.col(f"`{item_text_col}`").cast("string").alias("t")).filter("t is not null").distinct()
    table, idf = fit_latent_space(docs, text_col)
    block = []
    for r in items.orderBy("i", "t").toLocalIterator():
        block.append((r["i"], r["t"]))
        if len(block) == ITEM_BLOCK:
            yield _Searcher(block, table, idf, *limits)
            block = []
    if block:
        yield _Searcher(block, table, idf, *limits)


def benchmark_leaks(
    docs: DataFrame, benchmark: DataFrame, cosine: float = 0.4, lcs_exact: float = 0.8, lcs_paraphrase: float = 0.6, answer_share: float = 0.6, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share, word_from, word_to): a row for each document and benchmark item that leaks into it."""
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, word_from long, word_to long"
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    out = None
    for x in _searchers(docs, benchmark, text_col, item_id_col, item_text_col, cosine, lcs_exact, lcs_paraphrase, answer_share):
        found = rows.mapInArrow(x.matches, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, cosine: float = 0.4, lcs_exact: float = 0.8, lcs_paraphrase: float = 0.6, answer_share: float = 0.6, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """docs without the rows that any benchmark item leaks into: a filter of the scan, nothing is shuffled."""
    out, column = docs, docs.columns.index(text_col)
    for x in _searchers(docs, benchmark, text_col, item_id_col, item_text_col, cosine, lcs_exact, lcs_paraphrase, answer_share):
        out = out.mapInArrow(x.clean(column), docs.schema)
    return out
