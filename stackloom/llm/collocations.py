"""Phrase collocations by merged count-min sketches and an exact second pass.

Texts are lower-cased (A-Z), cut into pieces at [.,;:!?\\x0A-\\x0D] and pieces into
words [^\\x20\\x09]+.  Everything counts per language (null: und).  Phrases of 2 to
max_words words found at least min_count times are candidates.

1. Texts are written once, in groups (the input splits), and do not shuffle.  Every
   group counts its words and pairs in a sketch of two rows whose width follows the
   corpus.  What moves is the group's own cells of each slice of a row, as gaps and
   counts.
2. A slice adds the groups' sketches.  A cell that reaches min_count may hold a
   frequent n-gram; a group gets back which of its own cells do.  Cells only
   overestimate, so nothing frequent is lost.  Longer n-grams follow in a second
   sketch, where all pairs within them survive the first.
3. A group reads its texts again and counts exactly the n-grams whose cells survive in
   both rows; longer ones only where the shorter ones within them survive.  Words and
   n-grams are told apart by their bytes, never by a hash.  A group's counts shuffle
   once, in buckets of phrases; a bucket follows 128 MB of texts and adds up in runs.
4. A candidate's parts are themselves candidates or words, so its cuts find their
   counts by a join; so do the longer phrases that contain it.  The best of each
   language are first taken within partitions and salts.

Counts and scores are whole numbers; products go through decimals of 38 digits.

Edge cases: null, empty and blank texts have no words; a null language and und are
one; repeated rows and equal ids count each; a very long text is read whole by one
task; ties are ordered by phrase, in the order of UTF-8 bytes; other columns are
ignored and may have any name; an empty table, or no candidate, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackloom.llm import textkernels as K
from stackloom.llm.scratch import Scratch, file_system

ROWS = 2
BYTES_A_CELL = 16
SLICE_CELLS = 1 << 22
MIN_SLICES = 32
RUN_BYTES = 6 << 20
HELD_CELLS = 1 << 22
HELD_ROWS = 1 << 21
FLAGS = 1 << 24
BUCKET_BYTES, MIN_BUCKETS = 1 << 27, 64

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
BLANK = BREAK.copy()
BLANK[[0x20, 0x09]] = True


class Grams:
    """The words of a run of texts, told apart by language, and which n-grams start at each word.

    word: id of each word occurrence; left: words from it to its piece's end; vocabulary: (language, word) of each id.
    """

    def __init__(self, langs: list[str], texts: pa.Array):
        data, offsets = K.buffers(texts)
        base = int(offsets[0])
        data, offsets = K.LOWER[data[base : int(offsets[-1])]], offsets - base
        w = K.split_words(K.Chunk(0, len(texts), data, offsets), BLANK)
        doc = np.repeat(np.arange(len(texts)), np.diff(w.first))
        size = w.ends - w.starts
        solid = ~BLANK[data]
        column = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(data[solid])])
        coded = column.dictionary_encode()
        names = coded.dictionary.to_pylist()
        kinds = sorted(set(langs))
        place = {x: i for i, x in enumerate(kinds)}
        lang = np.array([place[x] for x in langs], np.int64)[doc] if len(doc) else np.zeros(0, np.int64)
        both = lang * len(names) + coded.indices.to_numpy(zero_copy_only=False)
        if len(kinds) == 1:
            used, self.word = np.arange(len(names)), both
        else:
            used, self.word = np.unique(both, return_inverse=True)
        self.vocabulary = [(kinds[i // len(names)], names[i % len(names)]) for i in used.tolist()]
        self.hash = np.fromiter((xxhash.xxh3_64_intdigest(b, xxhash.xxh3_64_intdigest(a)) for a, b in self.vocabulary), np.uint64, len(used))
        self.seen = self.hash[self.word]
        # a piece ends with its text, and where a mark stands before the next word
        marks = np.cumsum(BREAK[data], dtype=np.int32)[w.starts]
        n = len(size)
        last = np.ones(n, bool)
        if n > 1:
            last[:-1] = (doc[1:] != doc[:-1]) | (marks[1:] != marks[:-1])
        ends = np.flatnonzero(last)
        self.left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1 if n else np.zeros(0, np.int64)

    def starts(self, n: int) -> np.ndarray:
        return np.flatnonzero(self.left >= n)

    def gram_hashes(self, n: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the n-grams that start at the given words."""
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h += self.seen[at + j] * K._LANE[j]
        return K.mix(h)


    def surviving_pairs(self, survivors: Survivors) -> np.ndarray:
        """At which words a pair starts that survives."""
        out = np.zeros(len(self.word), bool)
        at = self.starts(2)
        out[at[survivors.has(2, self.gram_hashes(2, at))]] = True
        return out


@dataclass(frozen=True)
class Plan:
    """Rounds of n-gram sizes, the width of each round's sketch rows, cells of a slice, flags of a group."""

    rounds: tuple[tuple[int, ...], ...]
    widths: tuple[int, ...]
    slice_cells: int
    flags: int

    def slices(self, now: int) -> int:
        return -(-self.widths[now] // self.slice_cells)

    def round_of(self, size: int) -> int:
        return next(k for k, sizes in enumerate(self.rounds) if size in sizes)


def cells(h: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each hash in each row."""
    return [(x % np.uint64(width)).astype(np.int64) for x in (h, K.mix(h ^ K._GOLD))]


def packed(x: np.ndarray) -> bytes:
    """Whole numbers below 2**40, the bytes of each rank together."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 5 * n, "zstd", asbytes=True), np.uint8).reshape(5, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :5] = planes.T
    return out.reshape(-1).view("<u8").astype(np.int64)


def gaps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0)


def _texts(folder: str, files: list[str], run_bytes: int) -> Iterator[tuple[list[str], pa.Array]]:
    """(languages, texts) of runs of a group's texts, in the order of its files."""
    store, _ = file_system(folder)
    held, size = [], 0
    for name in sorted(files):
        with store.open_input_file(file_system(name)[1]) as f:
            for batch in pq.ParquetFile(f).iter_batches(128, columns=["lang", "t"]):
                held.append(batch)
                size += batch.column("t").nbytes
                if size >= run_bytes:
                    yield _run(held)
                    held, size = [], 0
    if held:
        yield _run(held)


def _run(held: list[pa.RecordBatch]) -> tuple[list[str], pa.Array]:
    rows = pa.Table.from_batches(held)
    return rows.column("lang").to_pylist(), rows.column("t").cast(pa.large_binary()).combine_chunks()


def _sketches(folder: str, plan: Plan, now: int, run_bytes: int, held_cells: int):
    """Rows (slice, grp, n, at, counts): a group's cells of a slice of a sketch row, ascending, and what it counted there."""
    width, slice_cells = plan.widths[now], plan.slice_cells

    def emit(grp, held):
        out = []
        for row, parts in enumerate(held):
            at, counts = np.concatenate([a for a, _ in parts]), np.concatenate([c for _, c in parts])
            order = np.argsort(at, kind="stable")
            at = at[order]
            new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            counts, at = np.add.reduceat(counts[order], new), at[new]
            slices = -(-width // slice_cells)
            cut = np.searchsorted(at, np.arange(slices + 1) * slice_cells)
            for s in np.flatnonzero(np.diff(cut)).tolist():
                own = slice(cut[s], cut[s + 1])
                out.append((row * slices + s, grp, int(cut[s + 1] - cut[s]), packed(gaps(at[own] - s * slice_cells)), packed(counts[own])))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["slice", "grp", "n", "at", "counts"])

    def run(batches):
        for batch in batches:
            for grp, files, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                survivors = Survivors(found or [], plan)
                held, n = [[] for _ in range(ROWS)], 0
                for langs, texts in _texts(folder, files, run_bytes):
                    grams = Grams(langs, texts)
                    here = grams.surviving_pairs(survivors) if now else None
                    for size in plan.rounds[now]:
                        at = grams.starts(size)
                        for j in range(size - 1 if now else 0):
                            at = at[here[at + j]]
                        h = grams.gram_hashes(size, at)
                        for row, c in enumerate(cells(h, width)):
                            c.sort()
                            new = np.flatnonzero(np.append(True, c[1:] != c[:-1]))[: len(c)]
                            held[row].append((c[new], np.diff(new, append=len(c))))
                            n += len(new)
                    if n >= held_cells:
                        yield emit(grp, held)
                        held, n = [[] for _ in range(ROWS)], 0
                if n:
                    yield emit(grp, held)

    return run


def _survivors(slice_cells: int, min_count: int):
    """Adds the groups' sketches of a slice; rows (slice, grp, n, at): the cells of each that reach min_count."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(slice_cells, np.int64), []
        for batch in batches:
            for grp, n, at, counts in zip(*(batch.column(c).to_pylist() for c in ("grp", "n", "at", "counts")), strict=True):
                total[np.cumsum(unpacked(at, n))] += unpacked(counts, n)
                held.append((grp, n, at))
        enough, out = total >= min_count, []
        del total
        for grp, n, at in held:
            c = np.cumsum(unpacked(at, n))
            c = c[enough[c]]
            if len(c):
                out.append((grp, len(c), packed(gaps(c))))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        slices = pa.array([key[0].as_py()] * len(out), pa.int64())
        yield pa.RecordBatch.from_arrays([slices, *(pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True))], ["slice", "grp", "n", "at"])

    return run


class Survivors:
    """A group's surviving cells of each round, as flags of plan.flags places a row; places that meet let more through, never less."""

    def __init__(self, found: list[dict], plan: Plan):
        self.plan, self.flags = plan, {}
        for x in found:
            row, s = divmod(x["slice"], plan.slices(x["round"]))
            if (x["round"], row) not in self.flags:
                self.flags[x["round"], row] = np.zeros(plan.flags, bool)
            self.flags[x["round"], row][(np.cumsum(unpacked(x["at"], x["n"])) + s * plan.slice_cells) & (plan.flags - 1)] = True

    def has(self, size: int, h: np.ndarray) -> np.ndarray:
        """Which n-grams of this many words, by their hashes, have surviving cells."""
        now = self.plan.round_of(size)
        out = np.ones(len(h), bool)
        for row, c in enumerate(cells(h, self.plan.widths[now])):
            if (now, row) not in self.flags:
                return np.zeros(len(h), bool)
            out &= self.flags[now, row][c & (self.plan.flags - 1)]
        return out


def exact_counts(grams: Grams, survivors: Survivors, max_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, where each distinct surviving n-gram starts first, its count) for n = 1 ... max_words.

    An n-gram is named by the ids of its first n - 1 and its last n - 1 words, so names are as exact as words are.
    """
    total = len(grams.word)
    name = grams.word
    here = np.ones(total, bool)
    for n in range(1, max_words + 1):
        fits = grams.left >= n
        if n > 1:
            fits[:-1] &= here[:-1] & here[1:]
            fits[-1:] = False
        at = np.flatnonzero(fits)
        at = at[survivors.has(n, grams.gram_hashes(n, at))]
        if not len(at):
            return
        pair = name[at] if n == 1 else name[at] * (int(name.max()) + 1) + name[at + 1]
        _, first, named, count = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
        yield n, at[first], count
        here, name = np.zeros(total, bool), np.zeros(total, np.int64)
        here[at], name[at] = True, named


def _exact(folder: str, plan: Plan, max_words: int, run_bytes: int, held_rows: int, buckets: int):
    """Rows (bucket, lang, n, size, phrases, f): the surviving n-grams of a group and how often it has them, in the order of phrases.

    An empty phrase stands for all words of a language.  Neighbours in that order
    have much in common, so that a phrase takes a few bytes of the shuffle.
    """

    def emit(held):
        rows = pa.Table.from_batches(held).group_by(["lang", "phrase"]).aggregate([("f", "sum"), ("h", "min")])
        rows = rows.append_column("bucket", pa.array((rows.column("h_min").to_numpy() % np.uint64(buckets)).astype(np.int32)))
        rows = rows.sort_by([("bucket", "ascending"), ("lang", "ascending"), ("phrase", "ascending")]).combine_chunks()
        bucket, lang = rows.column("bucket").to_numpy(), rows.column("lang").to_pylist()
        phrases, f = rows.column("phrase").to_pylist(), rows.column("f_sum").to_numpy()
        cut = [0, *(i for i in range(1, len(lang)) if lang[i] != lang[i - 1] or bucket[i] != bucket[i - 1]), len(lang)]
        out = []
        for i, j in zip(cut, cut[1:], strict=False):
            text = b"\n".join(phrases[i:j])
            out.append((int(bucket[i]), lang[i], j - i, len(text), pa.compress(text, "zstd", asbytes=True), packed(f[i:j])))
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["bucket", "lang", "n", "size", "phrases", "f"])

    def run(batches):
        for batch in batches:
            for files, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                survivors, held, n = Survivors(found or [], plan), [], 0
                for langs, texts in _texts(folder, files, run_bytes):
                    for rows in _run_counts(Grams(langs, texts), survivors, max_words):
                        held.append(rows)
                        n += rows.num_rows
                    if n >= held_rows:
                        yield from emit(held)
                        held, n = [], 0
                if held:
                    yield from emit(held)

    return run


def _run_counts(grams: Grams, survivors: Survivors, max_words: int) -> Iterator[pa.RecordBatch]:
    """Rows (lang, phrase, f, h) of a run; h: a hash that all groups give a phrase."""
    names = pa.array([w for _, w in grams.vocabulary], pa.large_binary())
    kinds = sorted({x for x, _ in grams.vocabulary})
    kind = np.array([kinds.index(x) for x, _ in grams.vocabulary], np.int64)
    if not kinds:
        return
    every = np.bincount(kind[grams.word], minlength=len(kinds))
    yield _counted(pa.array(kinds), pa.array([b""] * len(kinds)), every, np.zeros(len(kinds), np.uint64))
    for n, first, count in exact_counts(grams, survivors, max_words):
        ids = grams.word[first[:, None] + np.arange(n)]
        phrase = pc.binary_join_element_wise(*(names.take(pa.array(ids[:, j])) for j in range(n)), pa.scalar(b" ", pa.large_binary()))
        yield _counted(pa.array(kinds).take(pa.array(kind[ids[:, 0]])), phrase, count, grams.gram_hashes(n, first))


def _counted(lang, phrase, f, h):
    return pa.RecordBatch.from_arrays([lang.cast(pa.string()), phrase.cast(pa.binary()), pa.array(np.asarray(f, np.int64)), pa.array(h)], ["lang", "phrase", "f", "h"])


def _summed(min_count: int, held_rows: int):
    """Adds the counts of a bucket's phrases; rows (lang, phrase, words, f) of those that reach min_count, and of all words."""

    def whole(held):
        out = pa.Table.from_batches(held).group_by("phrase").aggregate([("f", "sum")])
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in (out.column("phrase"), out.column("f_sum"))], ["phrase", "f"])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, bound = [], 0, held_rows
        for batch in batches:
            for m, size, phrases, f in zip(*(batch.column(c).to_pylist() for c in ("n", "size", "phrases", "f")), strict=True):
                text = pa.decompress(phrases, size, "zstd", asbytes=True).split(b"\n")
                held.append(pa.RecordBatch.from_arrays([pa.array(text, pa.binary()), pa.array(unpacked(f, m))], ["phrase", "f"]))
                n += m
                if n >= bound:
                    held = [whole(held)]
                    n = held[0].num_rows
                    bound = max(held_rows, 2 * n)
        rows = whole(held)
        phrase, f = rows.column("phrase"), rows.column("f").to_numpy()
        every = pc.equal(phrase, pa.scalar(b"")).to_numpy(zero_copy_only=False)
        rows = rows.filter(pa.array((f >= min_count) | every))
        phrase = rows.column("phrase").cast(pa.string())
        words = pc.if_else(pc.equal(phrase, ""), 0, pc.add(pc.count_substring(phrase, " "), 1)).cast(pa.int32())
        lang = pa.array([key[1].as_py()] * rows.num_rows, pa.string())
        yield pa.RecordBatch.from_arrays([lang, phrase, words, rows.column("f")], ["lang", "phrase", "words", "f"])

    return run


_FOUND = "array<struct<round:int,slice:bigint,n:int,at:binary>>"


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def phrase_counts(docs: DataFrame, min_count: int = 30, max_words: int = 4, lang_col: str = "lang", text_col: str = "text", bytes_a_cell: int = BYTES_A_CELL, slice_cells: int = SLICE_CELLS, run_bytes: int = RUN_BYTES, held_cells: int = HELD_CELLS, held_rows: int = HELD_ROWS, flags: int = FLAGS, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, Scratch]:
    """A written table (lang, phrase, words, f): words and phrases found min_count times at least, exactly, and an empty phrase (words 0) for all words of a language."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    rows = docs.select(lang.alias("lang"), F.col(f"`{text_col}`").cast("binary").alias("t"), F.spark_partition_id().alias("grp")).filter("octet_length(t) > 0")
    rows = scratch.write(rows, "texts")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    width = max(1024, size // bytes_a_cell)
    slice_cells = min(slice_cells, -(-width // MIN_SLICES))
    files = scratch.write(rows.select("grp", F.col("_metadata.file_path").alias("file")).groupBy("grp").agg(F.collect_set("file").alias("files")), "files")
    groups = max(1, files.count())
    folder = f"{scratch.path}/texts"

    rounds = tuple(x for x in ((1, 2), tuple(range(3, max_words + 1))) if x)
    plan = Plan(rounds, (width, max(1024, width // 2))[: len(rounds)], slice_cells, flags)
    work = files.select("grp", "files", F.lit(None).cast(_FOUND).alias("found"))
    for now in range(len(rounds)):
        # a task a group: a range each
        dealt = work.repartitionByRange(groups, "grp").select("grp", "files", "found")
        sketches = dealt.mapInArrow(_sketches(folder, plan, now, run_bytes, held_cells), "slice long, grp int, n int, at binary, counts binary")
        found = sketches.groupBy("slice").applyInArrow(_survivors(slice_cells, min_count), "slice long, grp int, n int, at binary")
        found = found.select("grp", F.array(F.struct(F.lit(now).alias("round"), "slice", "n", "at")).cast(_FOUND).alias("found"))
        # no join, which could take what a group finds for small and broadcast it
        both = found.unionByName(work, allowMissingColumns=True).groupBy("grp")
        work = scratch.write(both.agg(F.flatten(F.collect_list("files")).alias("files"), F.flatten(F.collect_list("found")).alias("found")), f"work{now}")
    buckets = max(MIN_BUCKETS, size // bucket_bytes)
    exact = work.repartitionByRange(groups, "grp").select("files", "found").mapInArrow(_exact(folder, plan, max_words, run_bytes, held_rows, buckets), "bucket int, lang string, n int, size long, phrases binary, f binary")
    counts = scratch.write(exact.groupBy("bucket", "lang").applyInArrow(_summed(min_count, held_rows), "lang string, phrase string, words int, f long"), "counts")
    scratch.drop("texts", "files", *(f"work{now}" for now in range(len(rounds))))
    return counts, scratch


def collocations(docs: DataFrame, min_count: int = 30, max_words: int = 4, top: int = 2000, subsumed: tuple[int, int] = (80, 100), salts: int = 32, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score), the best `top` phrases of each language; see the module."""
    counts, scratch = phrase_counts(docs, min_count, max_words, **how)
    part = counts.filter("words > 0").select("lang", F.col("phrase").alias("part"), F.col("f").alias("known"))
    phrases = counts.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    # a longer phrase speaks for what lies within it; the largest count is what matters
    spans = [(n, i) for n in range(2, max_words) for i in range(max_words - n + 1)]
    within = F.array(*(F.when((F.col("words") > n) & (F.col("words") >= n + i), F.array_join(F.slice("w", i + 1, n), " ")) for n, i in spans))
    inner = F.filter(within.cast("array<string>"), lambda x: x.isNotNull())
    longer = phrases.select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = phrases.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (_wide(F.col("longer")) * subsumed[1] < _wide(F.col("a")) * subsumed[0])).select("lang", "phrase", "words", "a", "w")

    # a row for each cut and side, so that one join finds all counts
    sides = F.flatten(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit(True).alias("head"), F.array_join(F.slice("w", 1, k), " ").alias("part")),
        F.struct(k.alias("k"), F.lit(False).alias("head"), F.array_join(F.slice("w", k + 1, F.col("words") - k), " ").alias("part")),
    )))
    cuts = free.select("lang", "phrase", "a", F.inline(sides)).join(part, ["lang", "part"])
    cut = cuts.groupBy("lang", "phrase", "k").agg(F.max("a").alias("a"), F.max(F.when(F.col("head"), F.col("known"))).alias("l"), F.max(F.when(~F.col("head"), F.col("known"))).alias("r"))
    cut = cut.withColumn("score", F.expr("cast(2000000 as decimal(19,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    scored = cut.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "s.score")

    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    n = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
