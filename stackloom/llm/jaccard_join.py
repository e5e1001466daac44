"""N-gram Jaccard self-join: tiles, parity bitmaps, exact intersection.

A document is the set of its k-word shingles (64-bit hashes).  Two sets whose
Jaccard index reaches num/den share a token among their first
n - ceil(n * num / den) + 1 tokens under any one order of tokens.  The order
used puts frequent shingles last: frequency classes come from a table of at most
MAX_COUNTERS counters over the whole corpus (a read of the text of its own).  Documents that share such a token meet in a tile:

1. equal sets (of equal 128-bit hashes) collapse to one node, the row with the
   least id, before anything is joined;
2. a tile holds the nodes of one token, ordered by size; only nodes whose sizes
   allow the threshold (a band that moves with the size) are compared.  Every
   pair is bounded from above first: |x & y| <= (|x| + |y| -
   popcount(bits_x ^ bits_y)) / 2, with parity bitmaps of at least 2n bits (the
   longer folds onto the shorter by XOR).  In a first round tiles of SMALL nodes
   are compared in full; in larger ones each node meets the leader of its band
   and the next node that passes, which joins groups of copies in stars and
   chains.  This round may cut a tile anywhere, and cuts large ones in chunks;
3. in a second round larger tiles that still hold two components compare every
   pair of different components; a tile's main component is not compared with
   itself, and large tiles are cut in chunks of rows, spread over tasks so that
   every pair of chunks meets;
4. pairs that pass are intersected exactly as sorted arrays, which are made again
   from the texts of the documents concerned.

Pairs inside one component are skipped, since they cannot change a result
that is a partition into components; no other pair is dropped.

Edge cases: null or wordless text is the empty set, which links with nothing;
repeated rows are kept, one result row each; a null id comes after all others; a
component of null ids alone has a null component_id; ids may be any long; a very
long text is one set like any other (a task holds its tokens); equal sizes and
equal tokens need no order between them; extra columns are ignored and may have
any name; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm import textkernels as K
from stackloom.llm.graph import components
from stackloom.llm.idfilter import IdFilter
from stackloom.llm.scratch import Scratch

MIN_COUNTERS, MAX_COUNTERS = 1 << 16, 1 << 22
WORDS_A_COUNTER = 64
TILE_ROWS = 1024
RUN_ROWS = 200_000
SMALL = 4
HEAD = 4


def _sketch_parts(k: int, bits: int):
    def run(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for c in K.chunks(batch.column(0)):
                w = K.split_words(c)
                s, _ = K.window_hashes(K.word_hashes(c, w), w.first, k)
                total += np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        parts = total.reshape(16, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([zlib.compress(np.minimum(p, 255).astype(np.uint8).tobytes(), 1) for p in parts], pa.binary())], ["part", "counts"])

    return run


def _sketch_sum(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column("counts"):
            own = np.frombuffer(zlib.decompress(x.as_buffer()), np.uint8).astype(np.int64)
            total = own if total is None else total + own
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary())], ["part", "counts"])


def frequency_classes(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """A class 0..7 for each counter: how far its count, 255 a task at most, lies above the mean, in half octaves.

    The counters grow with the bytes of text, up to MAX_COUNTERS (16 MB).
    """
    schema = "part int, counts binary"
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    bits = int(np.clip(size // (6 * WORDS_A_COUNTER), MIN_COUNTERS, MAX_COUNTERS)).bit_length() - 1
    rows = docs.select(F.col(f"`{text_col}`").cast("binary").alias("t")).mapInArrow(_sketch_parts(k, bits), schema).groupBy("part").applyInArrow(_sketch_sum, schema).collect()
    counts = np.zeros((16, (1 << bits) // 16))
    for r in rows:
        counts[r["part"]] = np.frombuffer(r["counts"], "<u4")
    counts = counts.ravel()
    mean = max(counts.mean(), 16.0)
    return np.clip(np.floor(np.log2(np.maximum(counts / mean, 0.5)) * 2 + 0.2), 0, 7).astype(np.uint8)


class _Sets:
    """The distinct ordered tokens of each document of a chunk, with sizes, set hash, and parity bitmaps."""

    def __init__(self, c: K.Chunk, k: int, classes: np.ndarray):
        w = K.split_words(c)
        s, first = K.window_hashes(K.word_hashes(c, w), w.first, k)
        tok = (s >> np.uint64(3)) | (classes[(s >> np.uint64(65 - len(classes).bit_length())).astype(np.int64)].astype(np.uint64) << np.uint64(61))
        for d in np.flatnonzero(np.diff(first) > 1):
            tok[first[d] : first[d + 1]].sort()
        doc = np.repeat(np.arange(len(c)), np.diff(first))
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (doc[1:] != doc[:-1])
        self.tok, doc = tok[new], doc[new]
        self.n = np.bincount(doc, minlength=len(c)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        own = K.mix(self.tok.copy())
        sums = np.zeros(len(c), np.uint64)
        full = self.n > 0
        if len(own):
            sums[full] = np.add.reduceat(own, self.first[:-1][full])
        self.sid = K.as_long(K.mix(sums + self.n.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)))
        # a second sum of other hashes of the tokens: both together are the set's identity
        other = np.zeros(len(c), np.uint64)
        if len(own):
            other[full] = np.add.reduceat(K.mix(own ^ np.uint64(0x94D049BB133111EB)), self.first[:-1][full])
        self.chk = K.as_long(other)
        width = np.maximum(64, 2 << np.ceil(np.log2(np.maximum(self.n, 1))).astype(np.int64)) * full
        self.bit_first = np.concatenate([[0], np.cumsum(width)])
        at = np.repeat(self.bit_first[:-1], self.n) + (own & (np.repeat(width, self.n) - 1).astype(np.uint64)).astype(np.int64)
        self.bits = np.packbits(np.bincount(at, minlength=int(self.bit_first[-1])) & 1) if len(own) else np.zeros(0, np.uint8)


def _signatures(k: int, num: int, den: int, classes: np.ndarray):
    def run(batches):
        for batch in batches:
            for c in K.chunks(batch.column(2)):
                s = _Sets(c, k, classes)
                p = np.where(s.n > 0, s.n - -(-num * s.n // den) + 1, 0)
                out = np.concatenate([[0], np.cumsum(p)])
                at = np.repeat(s.first[:-1], p) + np.arange(out[-1]) - np.repeat(out[:-1], p)
                bits = K.binary_rows(s.bits, s.bit_first // 8)
                head = np.zeros((len(c), HEAD), np.uint64)
                for j in range(HEAD):
                    has = p > j
                    head[has, j] = s.tok[s.first[:-1][has] + j]
                yield pa.RecordBatch.from_arrays([*batch.slice(c.lo, len(c)).columns[:2], pa.array(s.n), pa.array(s.sid), pa.array(s.chk), K.list_rows(K.as_long(s.tok[at]), out), bits, K.binary_rows(head.view(np.uint8).ravel(), np.arange(len(c) + 1) * 8 * HEAD)], ["doc_id", "tag", "n", "sid", "chk", "prefix", "bits", "head"])

    return run


def _arrays(k: int, classes: np.ndarray):
    def run(batches):
        # a set of many copies leaves a task once
        seen: set = set()
        for batch in batches:
            for c in K.chunks(batch.column(0)):
                s = _Sets(c, k, classes)
                new = np.zeros(len(c), bool)
                for d, key in enumerate(zip(s.sid.tolist(), s.chk.tolist(), strict=True)):
                    if key not in seen:
                        new[d] = True
                        seen.add(key)
                toks = K.binary_rows(s.tok.view(np.uint8), s.first * 8)
                yield pa.RecordBatch.from_arrays([pa.array(s.sid), pa.array(s.chk), toks], ["sid", "chk", "toks"]).filter(pa.array(new))

    return run


def _live(num: int, den: int, run_rows: int = RUN_ROWS):
    """Rows (tok, sid, size), ordered by token and size, that can have the first common token of a linked pair.

    Of a pair that links, the smaller set has it among its first
    n - ceil(n * 2num / (num + den)) + 1 tokens, and the sizes are near.
    Runs of some run_rows rows are held; a run ends anywhere in a token, and
    what is kept does not depend on where.
    """

    def placed(t: pa.Table) -> pa.Table:
        pos = (np.concatenate([np.asarray(x) for x in t.column("size").chunks] or [np.zeros(0, np.int64)]) & 0xFFFFFFFF).astype(np.int32)
        return pa.table({"tok": t.column("tok"), "sid": t.column("sid"), "pos": pa.array(pos)})

    def near(t: pa.Table, before: int) -> tuple[np.ndarray, int]:
        """The rows to keep, and the size of the last early row before the last row in its token; before is that of the first row.  -1: none."""
        tok, size = (np.asarray(t.column(x).combine_chunks()) for x in ("tok", "size"))
        n, pos = size >> 32, size & 0xFFFFFFFF
        early = pos <= n + (-2 * num * n) // (num + den)
        same = tok[1:] == tok[:-1]
        keep = np.zeros(len(tok), bool)
        # the smaller of a pair: the next row is the nearest in size
        keep[:-1] = early[:-1] & same & (n[1:] * num <= n[:-1] * den)
        # the greater: the last early row before it is the nearest in size
        begin = np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(len(tok)), 0))
        last = np.append(-1, np.maximum.accumulate(np.where(early, np.arange(len(tok)), -1))[:-1])
        least = np.where(last >= begin, n[np.maximum(last, 0)], np.where(begin == 0, before, -1))
        keep |= (least >= 0) & (n * num <= least * den)
        return keep, int(least[-1])

    def run(batches):
        held, rows, before = [], 0, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < run_rows:
                continue
            t = pa.Table.from_batches(held)
            keep, before = near(t, before)
            # the last row waits for the one after it
            keep[-1] = False
            yield from placed(t.filter(pa.array(keep))).to_batches()
            held, rows = t.slice(rows - 1).to_batches(), 1
        if rows:
            t = pa.Table.from_batches(held)
            yield from placed(t.filter(pa.array(near(t, before)[0]))).to_batches()

    return run


def _verify(num: int, den: int):
    def run(batches):
        for batch in batches:
            ta, tb = batch.column("ta"), batch.column("tb")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                z = np.concatenate([np.frombuffer(ta[i].as_buffer(), "<u8"), np.frombuffer(tb[i].as_buffer(), "<u8")])
                z.sort()
                # common / (both - common) >= num / den
                keep[i] = np.count_nonzero(z[1:] == z[:-1]) >= -(-num * len(z) // (num + den))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


class _Tiles:
    """Rows (key, n, sid, comp, other, bits) of whole tiles, ordered by tile and size."""

    def __init__(self, t: pa.Table, num: int, den: int):
        t = t.combine_chunks()
        self.num, self.den = num, den
        self.key, self.n, self.sid, self.comp = (np.asarray(t.column(x).combine_chunks()) for x in ("key", "n", "sid", "comp"))
        # no more than the tokens from this one on are common, if it is the first common one
        self.tail = self.n - np.asarray(t.column("pos").combine_chunks())
        self.other = np.asarray(t.column("other").combine_chunks())
        self.raw, self.at = K.buffers(t.column("bits"))
        self.width = np.diff(self.at)
        raw, at = K.buffers(t.column("head"))
        self.head = raw[at[0] : at[-1]].view("<u8").reshape(-1, HEAD)
        self.tok = np.asarray(t.column("tok").combine_chunks()).view(np.uint64)
        self.begin = np.append(np.flatnonzero(np.append(True, self.key[1:] != self.key[:-1])), len(self.key))
        self.size = np.repeat(np.diff(self.begin), np.diff(self.begin))

    def bound(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Where the bit counts of rows i and j leave room for a large enough overlap."""
        ok = np.zeros(len(i), bool)
        both = self.n[i] + self.n[j]
        need = -(-self.num * both // (self.num + self.den))
        for w in np.unique(np.minimum(self.width[i], self.width[j])):
            some = np.flatnonzero(np.minimum(self.width[i], self.width[j]) == w)
            for lo in range(0, len(some), max(1, (1 << 22) // int(w))):
                s = some[lo : lo + max(1, (1 << 22) // int(w))]
                far = np.bitwise_count(self.folded(i[s], int(w)) ^ self.folded(j[s], int(w))).sum(axis=1, dtype=np.int64)
                ok[s] = (both[s] - far) // 2 >= need[s]
        return ok

    def folded(self, rows: np.ndarray, w: int) -> np.ndarray:
        out = np.empty((len(rows), w), np.uint8)
        for own in np.unique(self.width[rows]):
            r = np.flatnonzero(self.width[rows] == own)
            got = self.raw[self.at[rows[r]][:, None] + np.arange(own)]
            out[r] = np.bitwise_xor.reduce(got.reshape(len(r), -1, w), axis=1) if own > w else got
        return out

    def met_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Where rows i and j share one of their least tokens, less than this tile's: they meet in its tile too."""
        out = np.zeros(len(i), bool)
        for x in range(HEAD):
            t = self.head[i, x]
            below = (t != 0) & (t < self.tok[i])
            for y in range(HEAD):
                out |= below & (t == self.head[j, y])
        return out

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.key[i] == self.key[j]) & (self.n[j] * self.num <= self.n[i] * self.den)

    def leaders(self, turns: int):
        """Each row against the first of its tile that is near it in size; those the bits rule out meet a further first, some turns long."""
        left = np.flatnonzero(self.size > SMALL)
        for _ in range(turns):
            if not len(left):
                return
            begin = np.flatnonzero(np.append(True, self.key[left][1:] != self.key[left][:-1]))
            tile = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(left))))
            # tiles are ordered by n, so one search over (tile, n) finds the first near row
            span = int(self.n.max()) + 2
            least = -(-self.n[left] * self.num // self.den)
            first = left[np.searchsorted(tile * span + self.n[left], tile * span + least)]
            own = first == left
            i, j = first[~own], left[~own]
            ok = self.bound(i, j)
            yield i[ok], j[ok]
            left = j[~ok]

    def small(self):
        """All pairs near in size of tiles of SMALL rows or fewer."""
        act = np.flatnonzero(self.size <= SMALL)
        for d in range(1, SMALL):
            act = act[act + d < len(self.key)]
            act = act[self.near(act, act + d)]
            yield self.first_met(act, act + d)

    def crossing(self):
        """All pairs near in size of different components, one of them outside the tile's main component."""
        act, d = np.flatnonzero(self.size <= 256), 1
        while len(act):
            act = act[act + d < len(self.key)]
            act = act[self.near(act, act + d)]
            want = (self.comp[act] != self.comp[act + d]) & (self.other[act] | self.other[act + d])
            yield self.first_met(act[want], act[want] + d)
            d += 1
        for a, b in zip(self.begin[:-1], self.begin[1:], strict=True):
            if b - a <= 256:
                continue
            n = self.n[a:b]
            for x in np.flatnonzero(self.other[a:b]):
                lo, hi = np.searchsorted(n, -(-n[x] * self.num // self.den)), np.searchsorted(n, n[x] * self.den // self.num, "right")
                j = np.arange(a + lo, a + hi)
                j = j[self.comp[j] != self.comp[a + x]]
                yield self.first_met(np.full(len(j), a + x), j)

    def chains(self, steps: int = 64):
        """Each row with the next one, by size, of another component that the bits let pass."""
        act, d = np.flatnonzero(self.size > SMALL), 1
        while len(act) and d <= steps:
            act = act[act + d < len(self.key)]
            act = act[self.near(act, act + d)]
            want = act[self.comp[act] != self.comp[act + d]]
            ok = want[self.bound(want, want + d)]
            yield ok, ok + d
            act = act[~np.isin(act, ok)]
            d += 1

    def first_met(self, i: np.ndarray, j: np.ndarray):
        ok = np.minimum(self.tail[i], self.tail[j]) >= -(-self.num * (self.n[i] + self.n[j]) // (self.num + self.den))
        i, j = i[ok], j[ok]
        ok = ~self.met_before(i, j)
        i, j = i[ok], j[ok]
        ok = self.bound(i, j)
        return i[ok], j[ok]


def _tile_pairs(num: int, den: int, turns: int):
    """Runs over partitions ordered by (key, n, sid); a tile may span batches.  turns 0: crossing pairs; else small tiles in full, leaders and chains of others."""

    def pairs(t: pa.Table):
        tiles = _Tiles(t, num, den)
        a, b = [], []
        for i, j in itertools.chain(tiles.small(), tiles.leaders(turns), tiles.chains()) if turns else tiles.crossing():
            a.append(np.minimum(tiles.sid[i], tiles.sid[j]))
            b.append(np.maximum(tiles.sid[i], tiles.sid[j]))
        if a and sum(map(len, a)):
            ab = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 50_000:
                continue
            t = pa.Table.from_batches(held)
            key = np.asarray(t.column("key").combine_chunks())
            cut = int(np.searchsorted(-(key != key[-1]).astype(np.int8), 0)) if key[0] != key[-1] else 0
            if cut:
                yield from pairs(t.slice(0, cut))
                held, rows = t.slice(cut).to_batches(), t.num_rows - cut
        if rows:
            yield from pairs(pa.Table.from_batches(held))

    return run


def _dealt(table: DataFrame) -> DataFrame:
    """A table that grows with the corpus: joined by a merge at every size, so that small inputs take the plan of large ones."""
    return table.hint("merge")


def near_duplicates(
    docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", tag: Column | None = None, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """(doc_id, tag, n_shingles, component_id, first), a row for each row of docs; see the module.

    tag: a string that tells rows of one id apart, carried along.  first: the one row
    of each component with the least id, then the least tag; rows without words are first.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    classes = frequency_classes(docs, text_col, k)
    rid, words = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("binary")
    tag = F.when(rid.isNull(), F.md5(words)) if tag is None else tag
    text = docs.select(rid.alias("doc_id"), F.coalesce(tag, F.lit("")).alias("tag"), words.alias("t"))
    sig = text.mapInArrow(_signatures(k, num, den, classes), "doc_id long, tag string, n long, sid long, chk long, prefix array<long>, bits binary, head binary")
    # node: a row's number, fixed by writing it
    sig = scratch.write(sig.withColumn("node", F.monotonically_increasing_id()), "sig")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag", "node")

    full = sig.filter("n > 0").select("sid", "chk", "node", place.alias("place"))
    reps = scratch.write(full.groupBy("sid", "chk").agg(F.min("place").alias("place"), F.count("*").alias("copies")), "reps")
    copied = scratch.write(reps.filter("copies > 1").select("sid", "chk", F.col("place.node").alias("rep")), "copied")
    # rows that stand behind another row of their set
    extra = scratch.write(full.select("sid", "chk", "node").join(_dealt(copied), ["sid", "chk"]).filter("node <> rep").select("node", "rep"), "extra")
    maybe, alone = IdFilter(scratch, "extra_bits", extra.select("node")).split(sig.filter("n > 0").select("node", "n", "prefix", "bits", "head"), F.col("node"))
    kept = alone.unionByName(maybe.join(_dealt(extra.select("node")), "node", "left_anti"))

    postings = kept.select(F.col("node").alias("sid"), "n", F.posexplode("prefix").alias("pos", "tok"))
    # size above, place below: ordered as the size is
    postings = postings.select("tok", "sid", F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("size"))
    rare = postings.repartition("tok").sortWithinPartitions("tok", "size", "sid").mapInArrow(_live(num, den), "tok long, sid long, pos int")
    live = scratch.write(rare, "live")
    # of the nodes that no tile holds, few pass the bitmap; the rest meet nothing in the joins
    wanted = IdFilter(scratch, "live_bits", live.select("sid").distinct()).may_hold(kept.select(F.col("node").alias("sid"), "n", "bits", "head"), F.col("sid"))
    sized = scratch.write(wanted, "sized")
    scratch.drop("live_bits", "extra_bits")
    place_of = reps.select(F.col("place.node").alias("node"), "sid", "chk", "place")

    def verified(pairs: DataFrame, tag: str) -> DataFrame:
        pairs = scratch.write(pairs.distinct(), f"pairs_{tag}")
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct().join(_dealt(place_of), "node")
        nodes = scratch.write(nodes, f"nodes_{tag}")
        own = F.xxhash64("doc_id", "tag")
        texts = IdFilter(scratch, f"bits_{tag}", nodes.select(F.xxhash64("place.doc_id", "place.tag").alias("key"))).may_hold(text, own)
        arrays = texts.select("t").mapInArrow(_arrays(k, classes), "sid long, chk long, toks binary")
        sets = scratch.write(arrays.join(_dealt(nodes.select("sid", "chk", "node")), ["sid", "chk"]).dropDuplicates(["sid", "chk"]).select("node", "toks"), f"sets_{tag}")
        left = sets.select(F.col("node").alias("a"), F.col("toks").alias("ta"))
        right = sets.select(F.col("node").alias("b"), F.col("toks").alias("tb"))
        links = scratch.write(pairs.join(_dealt(left), "a").join(_dealt(right), "b").mapInArrow(_verify(num, den), "a long, b long"), tag)
        scratch.drop(f"sets_{tag}", f"nodes_{tag}", f"pairs_{tag}", f"bits_{tag}")
        return links

    tile = "key long, tok long, pos int, n long, sid long, comp long, other boolean, bits binary, head binary"
    columns = [x.split()[0] for x in tile.split(", ")]

    def tiled(rows: DataFrame, turns: int) -> DataFrame:
        return rows.select(columns).repartition("key").sortWithinPartitions("key", "n", "sid").mapInArrow(_tile_pairs(num, den, turns), "a long, b long")

    chunks = lambda x: F.ceil(x / tile_rows).cast("int")
    slot = lambda x: F.pmod(F.xxhash64("sid"), F.col(x)).cast("int")
    counts = scratch.write(live.groupBy("tok").agg(F.count("*").alias("c")), "counts")
    large = scratch.write(counts.filter(F.col("c") > tile_rows).select("tok", chunks(F.col("c")).alias("s")), "large")
    # chunks of large tiles: links between chunks are the second round's
    key = F.when(F.col("s").isNull(), F.col("tok")).otherwise(F.xxhash64("tok", slot("s"))).alias("key")
    alone = live.join(large, "tok", "left").select("tok", "pos", "sid", key).join(_dealt(sized), "sid")
    links = verified(tiled(alone.withColumn("comp", F.col("sid")).withColumn("other", F.lit(True)), 8), "links1")

    def mixed_tiles(comp: DataFrame) -> DataFrame:
        rest = live.join(_dealt(counts.filter(F.col("c") > SMALL).select("tok")), "tok", "left_semi")
        marked = rest.join(_dealt(comp.withColumnRenamed("node", "sid")), "sid", "left").select("tok", "pos", "sid", F.coalesce("comp", "sid").alias("comp"))
        marked = scratch.write(marked, "marked")
        shares = marked.groupBy("tok", "comp").agg(F.count("*").alias("c")).groupBy("tok").agg(F.sum("c").alias("c"), F.max(F.struct("c", "comp")).alias("main"))
        # all rows of a token, in chunks, meet those outside its main component, in chunks
        mixed = shares.filter("c > main.c").select("tok", F.col("main.comp").alias("main"), chunks(F.col("c")).alias("s"), chunks(F.col("c") - F.col("main.c")).alias("s2"))
        mixed = scratch.write(mixed, "mixed")
        rows = marked.join(_dealt(mixed), "tok").join(_dealt(sized), "sid").withColumn("other", F.col("comp") != F.col("main"))
        one = rows.filter("s = 1").withColumn("key", F.col("tok"))
        wide = rows.filter("s > 1")
        every = wide.withColumn("p", slot("s")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("s2") - 1))).withColumn("other", F.lit(False))
        rest = wide.filter("other").withColumn("q", slot("s2")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
        wide = every.select(*rows.columns, "p", "q").union(rest.select(*rows.columns, "p", "q")).withColumn("key", F.xxhash64("tok", "p", "q"))
        return one.select(columns).union(wide.select(columns))

    # tiles that still hold several components are searched in full
    comp = scratch.write(components(spark, links, scratch, "cc1"), "comp1")
    found = verified(tiled(mixed_tiles(comp), 0), "links2")
    links = links.union(found)
    final = scratch.write(components(spark, links, scratch, "cc2"), "comp2")

    # written at each join of a key that many rows may share, so that AQE can split it
    least = scratch.write(final.join(_dealt(place_of.select("node", "place")), "node"), "least")
    heads = scratch.write(least.groupBy("comp").agg(F.min("place").alias("place")), "heads")
    linked = scratch.write(least.select("node", "comp").join(_dealt(heads), "comp").select("node", "place"), "linked")
    # first the head of each row that others stand behind, then theirs
    ahead = copied.select(F.col("rep").alias("node")).join(_dealt(place_of.select("node", "place")), "node").withColumnRenamed("place", "own").join(_dealt(linked), "node", "left")
    ahead = scratch.write(ahead.select(F.col("node").alias("rep"), F.coalesce("place", "own").alias("place")), "ahead")
    behind = scratch.write(extra.join(_dealt(ahead), "rep").select("node", "place"), "behind")
    moved = linked.unionByName(behind).select("node", F.col("place.doc_id").alias("head_id"), F.col("place.node").alias("head"))
    out = sig.select("node", "doc_id", "tag", F.col("n").alias("n_shingles")).join(_dealt(moved), "node", "left")
    own_head = F.col("head").isNull() | (F.col("head") == F.col("node"))
    out = out.select("doc_id", "tag", "n_shingles", F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head_id")).alias("component_id"), own_head.alias("first"))
    out = scratch.write(out, "result")
    scratch.drop("sig", "reps", "copied", "extra", "live", "sized", "counts", "large", "marked", "mixed", "links1", "links2", "comp1", "comp2", "least", "heads", "linked", "ahead", "behind")
    return out


def near_duplicate_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs; see the module."""
    return near_duplicates(docs, k, num, den, id_col, text_col, tile_rows=tile_rows).select("doc_id", "n_shingles", "component_id")
