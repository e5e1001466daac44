"""Removal of repeated byte strings by a column-wise Burrows-Wheeler transform.

Every byte covered by a `length`-byte string that also starts anywhere else in
the corpus is removed; matches stay inside a document and are judged on the
input.

The plain column-wise construction over whole documents needs as many rounds as
the longest document has bytes, each reading the whole transform.  Here the
collection is first aligned by content, so `length` bounds the rounds:

1. Anchors.  In every `length`-byte string the least hashed GRAM-byte string
   (leftmost of equals) is chosen; equal strings choose the same place.  Texts are
   known by their 128-bit digests; those that occur twice are covered whole and
   count once from here on.
2. An anchor whose hash occurs once cannot lie in a repeat.  For the others, the
   window of length - GRAM bytes before to length bytes after is cut out.
3. Windows of one anchor form a collection of aligned strings.  One symbol of
   each is inserted a round, left to right; the order of windows by their reversed
   prefixes (the positional transform) and the common suffix length of neighbours
   in that order are updated.  Symbols, order and lengths go through files in the
   shared folder that are read and written front to back, BLOCK columns at a time.
   A window repeats a string that ends in the current column if a neighbour agrees
   on the last `length` symbols.  This is checked on bytes, so a hash collision
   costs time, not correctness.
4. An anchor with more than `hot_windows` windows is too much for a task.  Equal
   windows (by their bytes) repeat whole, and one of them stands for all.  If more
   than `hot_windows` different ones are left, the places where a string may start
   are halved: all strings of a half have some columns in common, so windows go on
   by the bytes there, cut to what the half can reach, once for each half.  This is
   repeated until collections are small; at one start they are single strings.
   What is left goes through 3 like any other collection.

Edge cases: null text is empty; texts shorter than `length` lose nothing; a very
long text is read whole by one task; repeated rows are copies of each other; null
and repeated ids are carried along (texts, not ids, are the nodes), so ties need
no order; extra columns are ignored and may have any name; an empty table gives an
empty result.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm import textkernels as K
from stackloom.llm.idfilter import IdFilter
from stackloom.llm.scratch import Scratch, file_system

LENGTH = 200
GRAM = 48
HOT_WINDOWS, COLLECTION = 4_000, 20_000
BLOCK = 32
_PAD = 256


def gram_hashes(data: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of the size bytes from each place on, by doubling."""
    table = K.mix(np.arange(256, dtype=np.uint64) + np.uint64(1000 * seed + 1))
    part, width, out, have = table[data], 1, None, 0
    while True:
        if size & width:
            if out is None:
                out, have = part, width
            else:
                n = len(data) - have - width + 1
                out = out[:n] * np.uint64(0x9FB21C651E98DF25 + 2 * width) + part[have : have + n]
                have += width
        if have == size:
            return K.mix(out)
        n = len(data) - 2 * width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        part = part[:n] * np.uint64(0xD6E8FEB86659FD93 + 2 * width) + part[width : width + n]
        part ^= part >> np.uint64(29)
        width *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each full window."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.append(x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(c: K.Chunk, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the chunk) and hashes of the anchors of all documents of a chunk."""
    if len(c.data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(c.data, gram)
    order = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    least = sliding_min(order, length - gram + 1)
    size = np.diff(c.offsets)
    valid = np.repeat(c.offsets[1:], size)[: len(least)] - np.arange(len(least)) >= length
    place = (least[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    place = np.unique(place)
    return place, h[place]


def _own_repeats(c: K.Chunk, place: np.ndarray, h: np.ndarray, doc: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Which anchors to keep, and the runs of bytes that windows with an equal in their own document cover.

    Periodic text has one anchor a period, all with equal windows: one of them
    stands for all, and each is repeated whole.
    """
    keep, runs = np.ones(len(place), bool), [[] for _ in range(len(c))]
    if len(place) < 2:
        return keep, runs
    order = np.lexsort((place, h, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    twin = np.append(same, False) | np.append(False, same)
    seen, owner = {}, -1
    for i in order[twin].tolist():
        d = int(doc[i])
        if d != owner:
            seen, owner = {}, d
        lo, hi = int(place[i]) - length + gram, int(place[i]) + length
        if lo < c.offsets[d] or hi > c.offsets[d + 1]:
            continue
        window = c.data[lo:hi].tobytes()
        first = seen.setdefault(window, lo)
        if first != lo:
            keep[i] = False
            runs[d] += [(first, first + hi - lo), (lo, hi)]
    for d, some in enumerate(runs):
        merged: list[list[int]] = []
        for lo, hi in sorted(set(some)):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        runs[d] = [{"s": lo - int(c.offsets[d]), "e": hi - int(c.offsets[d])} for lo, hi in merged]
    return keep, runs


_RUNS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def _anchor_rows(length: int, gram: int):
    def run(batches):
        for batch in batches:
            for c in K.chunks(batch.column(1)):
                place, h = anchors(c, length, gram)
                doc = np.searchsorted(c.offsets, place, "right") - 1
                keep, runs = _own_repeats(c, place, h, doc, length, gram)
                place, h, doc = place[keep], h[keep], doc[keep]
                cut = np.searchsorted(place, c.offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, len(c)), K.list_rows(K.as_long(h), cut), K.list_rows((place - c.offsets[doc]).astype(np.int32), cut), pa.array(runs, _RUNS)], ["tid", "ah", "pos", "own"])

    return run


def _once_a_task(batches):
    """Texts (tid, t), each once a task."""
    seen: set[bytes] = set()
    for batch in batches:
        new = []
        for x in batch.column(0).to_pylist():
            new.append(x not in seen)
            seen.add(x)
        yield batch.filter(pa.array(new, pa.bool_()))


_WINDOW = {"key": pa.int64(), "tid": pa.binary(), "start": pa.int32(), "col": pa.int32(), "win": pa.binary()}
_WINDOW_SQL = "key long, tid binary, start int, col int, win binary"


def _windows(length: int, gram: int):
    """Of each text, the windows of its live anchors: key is the anchor, col the column in which win starts."""
    before = length - gram
    types = {**_WINDOW, "hot": pa.bool_()}

    def emit(out):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types.values(), strict=True)], list(types))

    def run(batches):
        for batch in batches:
            tids, live = batch.column(0).to_pylist(), batch.column(2)
            out: list[list] = [[] for _ in types]
            for i in range(batch.num_rows):
                raw = memoryview(batch.column(1)[i].as_buffer())
                own = live[i].values
                for pos, ah, hot in zip(*(own.field(x).to_pylist() for x in ("pos", "ah", "hot")), strict=True):
                    lo = max(0, pos - before)
                    for col, x in zip(out, (ah, tids[i], lo, before - (pos - lo), bytes(raw[lo : pos + length]), hot), strict=True):
                        col.append(x)
                if len(out[0]) > 20_000:
                    yield emit(out)
                    out = [[] for _ in types]
            if out[0]:
                yield emit(out)

    return run


def _halves(length: int):
    """Of windows whose strings start in columns lo..hi, those of either half of these columns, by the bytes that all strings of the half have."""
    types = {**_WINDOW, "lo": pa.int32(), "hi": pa.int32()}

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in types]
            for key, tid, start, col, win, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mid = (lo + hi) // 2
                for a, b in ((lo, mid), (mid + 1, hi)):
                    # strings that start in a..b all hold columns b to a + length
                    common = win[max(b - col, 0) : a + length - col]
                    first = max(a, col)
                    part = win[first - col : b + length - col]
                    if col > b or len(common) < a + length - b or len(part) < length:
                        continue
                    own = xxhash.xxh3_64_intdigest(common, seed=(key ^ (a << 20 | b)) & 0xFFFFFFFFFFFFFFFF)
                    for c, x in zip(out, (own - (own >> 63 << 64), tid, start + first - col, first, part, a, b), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types.values(), strict=True)], list(types))

    return run


def positional_transform(symbols: np.ndarray, group: np.ndarray, length: int, folder: str, block: int = BLOCK) -> np.ndarray:
    """Rows x columns flags: the string of `length` symbols that ends here also ends in this column of another row of the group.

    symbols: rows x columns, _PAD outside a row's text; group: ascending.  The
    columns, the order of rows, and the common suffix lengths are files in a folder
    of this call under `folder`.
    """
    rows, columns = symbols.shape
    bits = max(1, int(rows - 1).bit_length())
    place = np.int64((1 << bits) - 1)
    flags = np.zeros((rows, columns), bool)
    store, root = file_system(folder)
    own = f"{root}/transform-{uuid.uuid4().hex}"
    store.create_dir(own, recursive=True)

    def put(name, x):
        with store.open_output_stream(f"{own}/{name}", compression=None) as f:
            f.write(x.tobytes())

    def get(name, kind):
        with store.open_input_stream(f"{own}/{name}", compression=None) as f:
            return np.frombuffer(f.read(), kind)

    try:
        with store.open_output_stream(f"{own}/columns", compression=None) as f:
            for k in range(0, columns, block):
                f.write(np.ascontiguousarray(symbols[:, k : k + block].T).tobytes())
        put("order0", np.arange(rows, dtype=np.int32))
        put("common0", np.zeros(rows + 1, np.int16))
        head = group.astype(np.int64) << np.int64(bits + 9)
        with store.open_input_stream(f"{own}/columns", compression=None) as source:
            for step, k in enumerate(range(0, columns, block)):
                order, common = get(f"order{step & 1}", np.int32), get(f"common{step & 1}", np.int16)
                width = min(block, columns - k)
                for j, column in enumerate(np.frombuffer(source.read(rows * width * symbols.itemsize), symbols.dtype).reshape(width, rows)):
                    s = column[order].astype(np.int64)
                    # groups keep their places in the order; inside one, rows go by the new symbol, then by their old place
                    key = head[order] | (s << np.int64(bits)) | np.arange(rows)
                    key.sort()
                    old = key & place
                    same = ((key[1:] >> np.int64(bits)) == (key[:-1] >> np.int64(bits))) & (s[old[1:]] != _PAD)
                    p, q = old[:-1][same], old[1:][same]
                    nxt = np.zeros(rows + 1, np.int16)
                    if len(p):
                        edges = np.stack([p + 1, q + 1], axis=1).ravel()
                        nxt[1:-1][same] = np.minimum(np.minimum.reduceat(common, edges)[::2] + 1, length)
                    order, common = order[old], nxt
                    flags[order, k + j] = np.maximum(nxt[:-1], nxt[1:]) >= length
                put(f"order{step + 1 & 1}", order)
                put(f"common{step + 1 & 1}", common)
    finally:
        with contextlib.suppress(OSError):
            store.delete_dir(own)
    return flags


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of every run of flags."""
    wide = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    wide[:, 1:-1] = flags
    step = np.diff(wide, axis=1)
    row, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)
    return row, first, last - 1


def _transform(length: int, gram: int, folder: str):
    columns = 2 * length - gram

    def repeats(t: pa.Table):
        t = t.combine_chunks()
        key, start, col = (np.asarray(t.column(x).combine_chunks()) for x in ("key", "start", "col"))
        raw, at = K.buffers(t.column("tid"))
        tid = raw[at[0] : at[-1]].reshape(-1, 16).view("<u8")
        # a text that came from several tasks is one text
        keep = np.append(True, (key[1:] != key[:-1]) | (tid[1:] != tid[:-1]).any(axis=1) | (start[1:] != start[:-1]) | (col[1:] != col[:-1]))
        raw, at = K.buffers(t.column("win"))
        key, tid, start, col, lo, size = key[keep], tid[keep], start[keep], col[keep], at[:-1][keep], np.diff(at)[keep]
        group = np.cumsum(np.append(False, key[1:] != key[:-1]))
        many = np.bincount(group)[group] > 1
        tid, start, col, lo, size, group = (x[many] for x in (tid, start, col, lo, size, group))
        if not len(group):
            return
        symbols = np.full((len(group), columns), _PAD, np.int16)
        for r in range(0, len(group), 4096):
            place = np.arange(columns)[None, :] - col[r : r + 4096, None]
            inside = (place >= 0) & (place < size[r : r + 4096, None])
            symbols[r : r + 4096][inside] = raw[(lo[r : r + 4096, None] + place)[inside]]
        row, first, last = _runs(positional_transform(symbols, np.unique(group, return_inverse=True)[1], length, folder))
        off = start[row] + first - col[row]
        tids = K.binary_rows(np.ascontiguousarray(tid[row]).view(np.uint8).ravel(), np.arange(len(row) + 1) * 16)
        yield pa.RecordBatch.from_arrays([tids, pa.array((off - length + 1).astype(np.int32)), pa.array((off + last - first + 1).astype(np.int32))], ["tid", "s", "e"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < COLLECTION:
                continue
            t = pa.Table.from_batches(held)
            key = np.asarray(t.column("key").combine_chunks())
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if cut:
                yield from repeats(t.slice(0, cut))
                held, rows = t.slice(cut).to_batches(), t.num_rows - cut
        if rows:
            yield from repeats(pa.Table.from_batches(held))

    return run


def _cool(windows: DataFrame, scratch: Scratch, length: int, gram: int, hot_windows: int) -> tuple[DataFrame, DataFrame]:
    """Windows of hot anchors as collections of at most hot_windows different windows, and the runs (tid, s, e) that equal ones cover."""
    spark, columns = scratch.spark, 2 * length - gram
    rows = windows.select(*_WINDOW, F.lit(0).alias("lo"), F.lit(columns - length).alias("hi"))
    small, covered = spark.createDataFrame([], _WINDOW_SQL), spark.createDataFrame([], "tid binary, s int, e int")
    same, k = ["key", "col", "win"], 0
    while True:
        rows = scratch.write(rows.dropDuplicates(["key", "tid", "start", "col"]), f"hot{k}")
        one = F.min(F.struct("tid", "start", "lo", "hi")).alias("one")
        kinds = scratch.write(rows.groupBy(*same).agg(F.count("*").alias("n"), one), f"kinds{k}")
        twins = rows.join(kinds.filter((F.col("n") > 1) & (F.octet_length("win") >= length)).select(*same), same)
        covered = covered.unionByName(scratch.write(twins.select("tid", F.col("start").alias("s"), (F.col("start") + F.octet_length("win")).cast("int").alias("e")), f"twins{k}"))
        large = scratch.write(kinds.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > hot_windows).select("key"), f"large{k}")
        flat = kinds.select("key", "col", "win", "one.*")
        small = small.unionByName(flat.join(large, "key", "left_anti").select(*_WINDOW))
        left = flat.join(large, "key").filter("lo < hi")
        if large.isEmpty():
            return small, covered
        # at one start, strings of one key are equal, or their hashes are: no more than a few
        small = small.unionByName(flat.join(large, "key").filter("lo = hi").select(*_WINDOW))
        rows = left.select(*_WINDOW, "lo", "hi").mapInArrow(_halves(length), f"{_WINDOW_SQL}, lo int, hi int")
        k += 1


def _remove(length: int):
    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            copies, ivs = batch.column(2).to_pylist(), batch.column(3)
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                n, kept, spans = len(text), text, 0
                if (copies[i] or 0) > 1 and n >= length:
                    kept, spans = b"", 1
                elif ivs[i].is_valid:
                    pairs = ivs[i].values
                    s, e = np.asarray(pairs.field("s")).astype(np.int64), np.asarray(pairs.field("e")).astype(np.int64)
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, s, 1)
                    np.add.at(step, e, -1)
                    gone = np.cumsum(step[:-1]) > 0
                    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                for col, x in zip(cols, (n, n - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    col.append(x)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(cols, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot_windows: int = HOT_WINDOWS, keep_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]), a row for each row of docs; kept is binary, as a cut may split a character."""
    scratch = Scratch(docs.sparkSession, "repeats")
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("tid"), text.alias("t"))
    table = scratch.write(base.select("tid", "t").mapInArrow(_anchor_rows(length, gram), "tid binary, ah array<long>, pos array<int>, own array<struct<s:int,e:int>>"), "anchors")
    copies = table.groupBy("tid").agg(F.count("*").alias("copies"))
    # copies of a text count once: a partial aggregation takes them out before the shuffle
    once = table.select("tid", "ah", "pos").groupBy("tid").agg(F.first("ah").alias("ah"), F.first("pos").alias("pos"))

    posts = once.select("tid", F.explode(F.arrays_zip("ah", "pos")).alias("z")).select(F.col("z.ah").alias("ah"), "tid", F.col("z.pos").alias("pos"))
    # written, so that AQE can split the posts of a common anchor in the join
    shared = posts.groupBy("ah").agg(F.count("*").alias("c")).filter("c > 1").select("ah", (F.col("c") > hot_windows).alias("hot"))
    shared = scratch.write(shared, "shared")
    live = posts.join(shared, "ah").groupBy("tid").agg(F.collect_set(F.struct("pos", "ah", "hot")).alias("live"))
    live = scratch.write(live, "live")
    scratch_copies = scratch.write(copies.filter("copies > 1"), "copies")
    own = scratch.write(table.filter("size(own) > 0").select("tid", F.inline("own")), "own")
    scratch.drop("anchors", "shared")

    ids = lambda t: t.select(F.xxhash64("tid").alias("h"))
    texts = IdFilter(scratch, "live_bits", ids(live)).may_hold(base.select("tid", "t"), F.xxhash64("tid"))
    wanted = texts.mapInArrow(_once_a_task, "tid binary, t binary").join(live, "tid")
    windows = wanted.select("tid", "t", "live").mapInArrow(_windows(length, gram), f"{_WINDOW_SQL}, hot boolean")
    covered = None
    if live.filter(F.exists("live", lambda x: x["hot"])).isEmpty():
        cold = windows.drop("hot")
    else:
        windows = scratch.write(windows, "windows")
        cold, covered = _cool(windows.filter("hot"), scratch, length, gram, hot_windows)
        cold = cold.unionByName(windows.filter("not hot").drop("hot"))
    found = cold.repartition("key").sortWithinPartitions("key", "tid", "start", "col").mapInArrow(_transform(length, gram, scratch.path), "tid binary, s int, e int")
    found = found.union(own) if covered is None else found.union(own).union(covered)
    found = scratch.write(found.groupBy("tid").agg(F.collect_set(F.struct("s", "e")).alias("ivs")), "found")
    scratch.drop("live", "live_bits", "windows", "own")

    facts = scratch.write(scratch_copies.join(found, "tid", "full"), "facts")
    changed, rest = IdFilter(scratch, "bits", ids(facts)).split(base, F.xxhash64("tid"))
    both = changed.join(facts, "tid", "left").select("doc_id", "t", "copies", "ivs")
    both = both.unionByName(rest.select("doc_id", "t", F.lit(None).cast("long").alias("copies"), F.lit(None).cast(facts.schema["ivs"].dataType).alias("ivs")))
    out = both.mapInArrow(_remove(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_bytes else out.drop("kept")
