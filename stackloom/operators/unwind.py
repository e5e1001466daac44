"""Call stacks from captured user stacks, by call frame information.

Stacks and the mappings of their pid meet in groups of a recording, a pid and a run
of records, so a pid with any share of the samples spreads over tasks.  In a group
all stacks step together: one search finds the mappings, one for each object the
rows, then every stack's frame, return address and frame pointer are computed at
once.  Where no row is known, the chain of frame pointers is followed, as it is in
objects that cannot be opened.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.functions.addresses import ALL_PIDS
from stackloom.operators import objects as O
from stackloom.sources.frames import BP, ROW, STUB, frames_of

MOST_FRAMES = 256
_U = np.uint64


def flattened(start: np.ndarray, size: np.ndarray, rank: list) -> tuple[np.ndarray, np.ndarray]:
    """(starts, owner): where the best of overlapping mappings changes, ascending, and its place there, -1 for none.

    The greatest start is best; of equal ones the greatest rank.
    """
    end = np.where(start + size < start, _U(2**64 - 1), start + size)
    cuts = np.unique(np.concatenate([start, end]))
    owner = np.full(len(cuts), -1, np.int64)
    # the best come last, and overwrite
    for i in sorted(range(len(start)), key=lambda i: (int(start[i]), rank[i])):
        owner[np.searchsorted(cuts, start[i]) : np.searchsorted(cuts, end[i])] = i
    return cuts, owner


class Memory:
    """The captured stacks of a group, each from its own address on."""

    def __init__(self, column: pa.Array, base: np.ndarray):
        blobs = [x.as_buffer() if x.is_valid else b"" for x in column]
        size = np.array([len(b) for b in blobs], np.int64)
        self.first, self.size, self.base = np.concatenate([[0], np.cumsum(size)])[:-1], size, base
        self.data = np.frombuffer(b"".join(blobs), np.uint8)

    def word(self, which: np.ndarray, address: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, known) of 8 bytes at an address of each of the stacks named."""
        at = address - self.base[which]
        known = (address >= self.base[which]) & (at < _U(1 << 40)) & (at.astype(np.int64) + 8 <= self.size[which])
        out = np.zeros(len(which), _U)
        place = self.first[which[known]] + at[known].astype(np.int64)
        if len(place):
            out[known] = np.ascontiguousarray(self.data[place[:, None] + np.arange(8)]).view("<u8").ravel()
        return out, known


def stepped(ip: np.ndarray, sp: np.ndarray, bp: np.ndarray, memory: Memory, rows_of, most: int = MOST_FRAMES) -> list[list[int]]:
    """Addresses of each stack, innermost first; all but the first are return addresses less one."""
    frames: list[list[int]] = [[int(x)] for x in ip]
    live = np.arange(len(ip))
    ip, sp, bp = ip.copy(), sp.copy(), bp.copy()
    for step in range(1, most):
        if not len(live):
            break
        rows, known = rows_of(ip)
        # without a row: the saved frame pointer and the return address stand where the frame pointer says
        frame = np.where(known & (rows["register"] != BP), sp, bp) + rows["offset"].astype(_U)
        stub = known & (rows["register"] == STUB)
        frame[stub] = sp[stub] + _U(8) + np.where(ip[stub] & _U(15) >= _U(11), _U(8), _U(0))
        frame[~known] = bp[~known] + _U(16)
        return_at = np.where(known, np.where(stub, -8, rows["return_at"]), -8).astype(np.int64).astype(_U)
        saved_at = np.where(known, rows["saved_at"], -16).astype(np.int64).astype(_U)
        saved = ~known | (rows["saved"] == 1)
        back, found = memory.word(live, frame + return_at)
        old, old_found = memory.word(live, frame + saved_at)
        # a caller's frame lies above; the first frame may be one that has not grown
        above = (frame > sp) | ((frame == sp) & (step == 1) & known)
        ends = known & ~rows["returns"] & ~stub
        go = found & (back != 0) & above & ~ends & (~saved | old_found)
        sp, bp = frame[go], np.where(saved, old, bp)[go]
        live, ip = live[go], back[go] - _U(1)
        for i, x in zip(live.tolist(), ip.tolist(), strict=True):
            frames[i].append(x)
    return frames


def _unwound(key, stacks: pa.Table, maps: pa.Table) -> pa.Table:
    """A group's stacks: (file, ord, unwound)."""
    unsigned = lambda t, c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
    start, size, offset = (unsigned(maps, c) for c in ("start", "len", "pgoff"))
    names = maps.column("object").to_pylist()
    cuts, owner = flattened(start, size, list(zip(maps.column("own").to_pylist(), maps.column("m_ord").to_pylist(), strict=True)))
    tables = {n: frames_of(n) for n in set(names) if n is not None}

    def rows_of(ip):
        rows, known = np.zeros(len(ip), ROW), np.zeros(len(ip), bool)
        if not len(cuts):
            return rows, known
        k = np.searchsorted(cuts, ip, "right") - 1
        which = np.where(k >= 0, owner[k], -1)
        for i in np.unique(which[which >= 0]).tolist():
            table = tables.get(names[i])
            if table is not None:
                mine = np.flatnonzero(which == i)
                rows[mine], known[mine] = table.rows_at(ip[mine] - start[i] + offset[i])
        return rows, known

    ip, sp, bp = (unsigned(stacks, c) for c in ("ip", "sp", "bp"))
    memory = Memory(stacks.column("stack").combine_chunks(), sp)
    found = stepped(ip, sp, bp, memory, rows_of)
    lists = [np.array(x, _U).view(np.int64) for x in found]
    return pa.table({"file": stacks.column("file"), "ord": stacks.column("ord"), "unwound": pa.array(lists, pa.list_(pa.int64()))})


def unwound_stacks(stacks: DataFrame, mappings: DataFrame, folder: str | None = None, block_bits: int = 9) -> DataFrame:
    """(file, ord, unwound) of stacks (file, ord, pid, ip, sp, bp, stack); mappings with the columns of a recording's.

    Objects are looked for by the executors, as objects.files says; the mappings are
    those at the end of the recording.  A group has 2**block_bits records at most.
    """
    rows = stacks.select("file", "ord", "pid", "ip", "sp", "bp", "stack", F.shiftright("ord", block_bits).alias("block"))
    user = mappings.filter(~F.col("path").startswith("["))
    known = O.files(user, folder).select(F.struct(*O.KEYS).alias("k"), "object")
    user = user.withColumn("k", F.struct(*O.KEYS)).join(known, "k", "left").select(F.col("file").alias("m_file"), F.col("pid").alias("m_pid"), "start", "len", "pgoff", "object", F.col("ord").alias("m_ord"))
    blocks = rows.select("file", "pid", "block").distinct()
    asked = blocks.withColumn("asked", F.explode(F.array_distinct(F.array("pid", F.lit(ALL_PIDS).cast("long")))))
    own = asked.join(user, (F.col("file") == F.col("m_file")) & (F.col("asked") == F.col("m_pid")))
    # other names than those of the stacks, from which they derive
    own = own.select(F.col("file").alias("o_file"), F.col("pid").alias("o_pid"), F.col("block").alias("o_block"), "start", "len", "pgoff", "object", (F.col("pid") == F.col("asked")).cast("int").alias("own"), "m_ord")
    return rows.groupBy("file", "pid", "block").cogroup(own.groupBy("o_file", "o_pid", "o_block")).applyInArrow(_unwound, "file string, ord long, unwound array<long>")
