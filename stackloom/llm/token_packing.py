"""Token ids packed into fixed-length rows, best fit decreasing.

Each task tokenizes its own input split, cuts texts longer than a row into
pieces without loss, and packs blocks of pieces: longest first, each into the
row with the least room that still holds it.  That row is found by a segment
tree over room sizes.  Nothing is shuffled or sorted across tasks: a block holds
BLOCK_TOKENS tokens, so memory is bounded and a row's waste does not depend on
the size of the table; hot sources and long texts spread as the input does.

A packed row carries the id matrix row (little-endian, padded), the cumulative
segment lengths, the position ids (they restart at every segment), and for each
segment its document and the number of its piece, so that documents can be put
together again exactly.

The vocabulary file is shipped with the job, so only the driver needs its path.
write_binary() puts packed rows into plain files in the shared folder: id matrices
and position matrices, row after row, and cumulative lengths; read_binary() gives
their arrays back.

Edge cases: null or empty text gives one segment, the end-of-text id alone (none
if append_end is off); a null id stays null; repeated rows are packed one by one,
and pieces of one length go in the order in which they were read; a very long text
is tokenized whole and becomes as many pieces as it takes; extra columns are
ignored and may have any name; an empty table gives no rows and no files.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm.scratch import file_system

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how texts of this vocabulary are cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = 50256
BLOCK_TOKENS = 1 << 21
SCHEMA = "pack_id string, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, pieces array<int>"

_encoders: dict = {}


def encoder(path: str = VOCABULARY):
    """The tokenizer of a rank file; loaded once a process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def ship(spark: SparkSession, path: str) -> str:
    """Sends a file along with the job; its name there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


class RoomTree:
    """Which room sizes 0..most have an open row: a segment tree of flags over sizes."""

    def __init__(self, most: int):
        self.leaves = 1 << max(1, most).bit_length()
        self.any = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.leaves
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The room and row of the best fit for need, removed from the tree; None if no row has the room."""
        i = need + self.leaves
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.any[i] = 0
            i >>= 1
            while i and not (self.any[2 * i] or self.any[2 * i + 1]):
                self.any[i] = 0
                i >>= 1
        return room, row


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of piece numbers; every length is 1..capacity."""
    tree, rows = RoomTree(capacity), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need) if need < capacity else None
        if found is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(i)
        if room > need:
            tree.add(room - need, row)
    return rows


def _packer(capacity: int, vocabulary: str, end: int | None, pad: int, block_tokens: int, kind: str):
    def block(pieces: list, part: int, number: int) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(x[2]) for x in pieces], np.int64)
        rows = best_fit_decreasing(lengths, capacity)
        ramp = np.arange(capacity, dtype=kind)
        for lo in range(0, len(rows), 512):
            part_rows = rows[lo : lo + 512]
            ids = np.full((len(part_rows), capacity), pad, kind)
            at = np.zeros((len(part_rows), capacity), kind)
            cu, docs, nums, n = [], [], [], []
            for r, row in enumerate(part_rows):
                row.sort()
                ends = [0]
                for i in row:
                    a, b = ends[-1], ends[-1] + int(lengths[i])
                    ids[r, a:b] = pieces[i][2]
                    at[r, a:b] = ramp[: b - a]
                    ends.append(b)
                cu.append(ends)
                n.append(ends[-1])
                docs.append([pieces[i][0] for i in row])
                nums.append([pieces[i][1] for i in row])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{part:06d}-{number:04d}-{lo + r:05d}" for r in range(len(part_rows))]), pa.array(n, pa.int32()), pa.array([x.tobytes() for x in ids], pa.binary()),
                    pa.array([x.tobytes() for x in at], pa.binary()), pa.array(cu, pa.list_(pa.int32())), pa.array(docs, pa.list_(pa.int64())), pa.array(nums, pa.list_(pa.int32())),
                ],
                ["pack_id", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "pieces"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(SparkFiles.get(vocabulary)).encode_ordinary, TaskContext.get().partitionId()
        pieces, held, number = [], 0, 0
        tail = [] if end is None else [end]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, doc in enumerate(ids):
                tokens = np.array(encode(batch.column(1)[i].as_py() or "") + tail, kind)
                for k in range(-(-len(tokens) // capacity)):
                    pieces.append((doc, k, tokens[k * capacity : (k + 1) * capacity]))
                held += len(tokens)
                if held >= block_tokens:
                    yield from block(pieces, part, number)
                    pieces, held, number = [], 0, number + 1
        if pieces:
            yield from block(pieces, part, number)

    return run


def pack_tokens(
    docs: DataFrame, capacity: int = 2048, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", append_end: bool = True, pad: int = END_OF_TEXT, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """Packed rows; see the module.  vocabulary is the path of a rank file on the driver."""
    if not 1 <= capacity <= 65535:
        raise ValueError("capacity must be 1 to 65535: positions are 16 bits")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return rows.mapInArrow(_packer(capacity, ship(docs.sparkSession, vocabulary), END_OF_TEXT if append_end else None, pad, block_tokens, "<u2"), SCHEMA)


MANIFEST = "ids string, positions string, lengths string, rows long, segments long"


def write_binary(packed: DataFrame, folder: str) -> DataFrame:
    """Writes packed rows as little-endian files under folder; returns their manifest, a row a file set.

    `ids` and `positions` hold rows x capacity 16-bit numbers, `lengths` for each row
    the count of its segments and their ends, as 32-bit numbers.  Files carry the
    attempt in their names and count only if the manifest, which the caller must
    write before using it, names them.
    """

    def run(batches):
        store, path = file_system(folder)
        names, out, rows, segments = [], [], 0, 0
        for batch in batches:
            if batch.num_rows and not out:
                store.create_dir(path, recursive=True)
                own = f"{path}/pack-{uuid.uuid4().hex}"
                names = [f"{own}.{x}" for x in ("ids", "positions", "lengths")]
                out = [store.open_output_stream(x, compression=None) for x in names]
            for ids, at, ends in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                ends = np.array([len(ends) - 1, *ends.as_py()[1:]], "<i4")
                for f, x in zip(out, (ids.as_buffer(), at.as_buffer(), ends.tobytes()), strict=True):
                    f.write(x)
                rows, segments = rows + 1, segments + len(ends) - 1
        for f in out:
            f.close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*names, rows, segments)], ["ids", "positions", "lengths", "rows", "segments"])

    return packed.select("input_ids", "position_ids", "cu_seqlens").mapInArrow(run, MANIFEST)


def read_binary(folder: str, entry, capacity: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The id matrix, the position matrix, and each row's cumulative lengths, of one row of the manifest."""
    store, _ = file_system(folder)

    def numbers(name, kind):
        with store.open_input_stream(entry[name]) as f:
            return np.frombuffer(f.read(), kind)

    flat, at, ends = numbers("lengths", "<i4"), 0, []
    while at < len(flat):
        ends.append(np.append(0, flat[at + 1 : at + 1 + flat[at]]))
        at += 1 + flat[at]
    return numbers("ids", "<u2").reshape(-1, capacity), numbers("positions", "<u2").reshape(-1, capacity), ends


def matrix(rows: list, capacity: int, column: str = "input_ids") -> np.ndarray:
    """The (rows, capacity) matrix of collected packed rows."""
    return np.frombuffer(b"".join(bytes(r[column]) for r in rows), "<u2").reshape(-1, capacity)
