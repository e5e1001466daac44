"""Line dedup by two Bloom filters and exact confirmation.

A line's key is the line without white space at its ends, A-Z lower-cased.  Keys
of at least min_chars code points found in at least min_docs documents lose all
their lines, except in the document with the largest id that holds them.

Texts are written once, in groups (the input splits), and never shuffled; what
moves is hashes, and the keys of suspected lines.

1. Every group sends the 64-bit hashes of its long enough keys, each once a
   document and marked if several documents of the group hold it, to the slice of
   hashes that they fall into.  Slices hold SLICE_LINES lines on the average,
   however large the table.
2. A slice keeps two Bloom filters: hashes seen once, and hashes seen twice.  It
   then reads its hashes again, and sends those in the twice-seen filter, the
   suspects, back to their groups.  A line that all documents share costs a hash a
   group.
3. Suspected lines shuffle with their full key, one row a group and key, with the
   least min_docs ids and the largest id that the group knows of: enough to count
   documents up to min_docs exactly, whichever groups share ids.
4. The keys to drop go back to the groups that hold them; texts are rewritten in
   place.

Edge cases: null or empty text is one empty line; a null id counts as a
document, the smallest, and rows that share an id count as one document, each
keeping its lines where that id is the largest; empty keys and short keys are
never dropped; ties, that is several lines of one key in a document, go or stay
together; a very long text is read whole by one task; extra columns are ignored
and may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm.scratch import Scratch, file_system

BITS_A_LINE = 16
SLICE_LINES = 1 << 22
MIN_SLICES = 64
SPACE = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes | None, min_chars: int) -> list[bytes | None]:
    """A key for each line; None where it is too short to matter."""
    out = []
    for line in (text or b"").split(b"\n"):
        key = line.strip(SPACE).lower()
        out.append(key if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars) else None)
    return out


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def _slices(h: np.ndarray, slices: int) -> np.ndarray:
    """The slice of each hash, by its upper half, so ascending hashes have ascending slices."""
    return (((h >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)).astype(np.int64)


def _sightings(min_chars: int, slices: int, held_hashes: int = 1 << 21):
    """Rows (slice, grp, once, twice): hashes that one document of a run of documents holds, and that several do."""

    def emit(grp, held):
        h, count = np.unique(np.concatenate(held), return_counts=True)
        cut = np.searchsorted(_slices(h, slices), np.arange(slices + 1))
        used = np.flatnonzero(np.diff(cut))
        parts = [(h[a:b], count[a:b]) for a, b in zip(cut[used], cut[used + 1], strict=True)]
        once, twice = ([x[pick(c)].tobytes() for x, c in parts] for pick in (lambda c: c == 1, lambda c: c > 1))
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.full(len(used), grp), pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["slice", "grp", "once", "twice"])

    def run(batches):
        held, n, grp = [], 0, None
        for batch in batches:
            for g, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and (g != grp or n > held_hashes):
                    yield emit(grp, held)
                    held, n = [], 0
                grp = g
                keys = {k for k in line_keys(text.as_py(), min_chars) if k is not None}
                if keys:
                    held.append(_hashes(list(keys)))
                    n += len(keys)
        if held:
            yield emit(grp, held)

    return run


class Bloom:
    """A filter of 2**k bits with two places a hash."""

    def __init__(self, bits: int):
        self.flags, self.mask, self.shift = np.zeros(bits, bool), np.uint64(bits - 1), np.uint64(32)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # upper bits chose the slice: mix them in
        m = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (m & self.mask).astype(np.int64), ((m >> self.shift) & self.mask).astype(np.int64)

    def add(self, h: np.ndarray) -> None:
        for p in self.places(h):
            self.flags[p] = True

    def has(self, h: np.ndarray) -> np.ndarray:
        p, q = self.places(h)
        return self.flags[p] & self.flags[q]


def _twice_seen(bits: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, held = Bloom(bits), Bloom(bits), []
        for batch in batches:
            for grp, a, b in zip(batch.column("grp").to_pylist(), batch.column("once"), batch.column("twice"), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                twice.add(a[once.has(a)])
                once.add(a)
                once.add(b)
                twice.add(b)
                held.append((grp, a, b))
        rows = [(grp, np.concatenate([a[twice.has(a)], b])) for grp, a, b in held]
        rows = [(grp, h.tobytes()) for grp, h in rows if len(h)]
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.int32()), pa.array([h for _, h in rows], pa.binary())], ["grp", "hashes"])

    return run


def _texts(folder: str, files: list[str]):
    """(ids, texts) of the batches of a group's files."""
    store, _ = file_system(folder)
    for name in files:
        with store.open_input_file(file_system(name)[1]) as f:
            for batch in pq.ParquetFile(f).iter_batches(256, columns=["doc_id", "t"]):
                yield batch.column("doc_id").to_pylist(), batch.column("t")


def _confirm(folder: str, min_chars: int, min_docs: int, held_bytes: int = 1 << 26):
    """Rows (key, grp, ids, none, last): of each suspected key the least min_docs ids, whether an id is null, and the largest id."""

    def emit(grp, seen):
        some = [sorted(ids) for _, ids in seen.values()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(list(seen), pa.binary()), pa.array([grp] * len(seen), pa.int32()), pa.array([x[:min_docs] for x in some], pa.list_(pa.int64())),
                pa.array([none for none, _ in seen.values()], pa.bool_()), pa.array([x[-1] if x else None for x in some], pa.int64()),
            ],
            ["key", "grp", "ids", "none", "last"],
        )

    def run(batches):
        for batch in batches:
            for grp, files, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                want = np.unique(np.frombuffer(b"".join(hashes), np.uint64))
                seen, size = {}, 0
                for ids, texts in _texts(folder, files):
                    at, keys = [], []
                    for i, text in zip(ids, texts, strict=True):
                        own = list({k for k in line_keys(text.as_py(), min_chars) if k is not None})
                        keys += own
                        at += [i] * len(own)
                    if not keys:
                        continue
                    h = _hashes(keys)
                    hit = want[np.minimum(np.searchsorted(want, h), len(want) - 1)] == h
                    for r in np.flatnonzero(hit).tolist():
                        none, known = seen.get(keys[r], (False, None))
                        if known is None:
                            known = set()
                            size += len(keys[r])
                        if at[r] is not None:
                            known.add(at[r])
                            if len(known) > 4 * min_docs + 16:
                                least = sorted(known)
                                known = {*least[:min_docs], least[-1]}
                        seen[keys[r]] = (none or at[r] is None, known)
                    if size > held_bytes:
                        yield emit(grp, seen)
                        seen, size = {}, 0
                if seen:
                    yield emit(grp, seen)

    return run


def _rewrite(folder: str, min_chars: int):
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            for files, drops in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last = {d["key"]: d["last"] for d in drops or ()}
                for ids, texts in _texts(folder, files):
                    out = []
                    for i, text in zip(ids, texts, strict=True):
                        text = text.as_py() or b""
                        lines = text.split(b"\n")
                        stay = [x for x, k in zip(lines, line_keys(text, min_chars), strict=True) if last.get(k, i) == i] if last else lines
                        kept = b"\n".join(stay)
                        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256(kept).hexdigest(), kept))
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"])

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", slice_lines: int = SLICE_LINES, bits_a_line: int = BITS_A_LINE, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256[, text]), a row for each row of docs; see the module."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "lines")
    text = F.col(f"`{text_col}`").cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("t"), F.spark_partition_id().alias("grp"))
    rows = scratch.write(rows, "texts")
    # line ends, by byte counts, and a last line each
    lines = rows.agg(F.sum(F.octet_length("t") - F.octet_length(F.replace(F.col("t").cast("string"), F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    slices = max(MIN_SLICES, -(-lines // slice_lines))
    bits = 1 << max(10, bits_a_line * -(-lines // slices)).bit_length()
    files = scratch.write(rows.select("grp", F.col("_metadata.file_path").alias("file")).groupBy("grp").agg(F.collect_set("file").alias("files")), "files")
    groups = max(1, files.count())
    folder = f"{scratch.path}/texts"

    seen = rows.select("grp", "t").mapInArrow(_sightings(min_chars, slices), "slice int, grp int, once binary, twice binary")
    suspects = seen.groupBy("slice").applyInArrow(_twice_seen(bits), "grp int, hashes binary")
    suspects = scratch.write(suspects.groupBy("grp").agg(F.collect_list("hashes").alias("hashes")).join(files, "grp").select("grp", "files", "hashes"), "suspects")
    # a task a group: a range each
    held = suspects.repartitionByRange(groups, "grp").mapInArrow(_confirm(folder, min_chars, min_docs), "key binary, grp int, ids array<long>, none boolean, last long")
    held = scratch.write(held, "held")
    known = F.size(F.array_distinct(F.flatten(F.collect_list("ids")))) + F.max(F.col("none").cast("int"))
    bad = scratch.write(held.groupBy("key").agg(known.alias("docs"), F.max("last").alias("last")).filter(F.col("docs") >= min_docs).select("key", "last"), "bad")
    drops = held.select("key", "grp").join(bad, "key").groupBy("grp").agg(F.collect_set(F.struct("key", "last")).alias("drops"))
    work = scratch.write(files.join(drops, "grp", "left").select("grp", "files", "drops"), "work")
    scratch.drop("suspects", "held", "bad")
    out = work.repartitionByRange(groups, "grp").select("files", "drops").mapInArrow(_rewrite(folder, min_chars), "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept binary")
    return out.withColumn("text", F.col("kept").cast("string")).drop("kept") if keep_text else out.drop("kept")
