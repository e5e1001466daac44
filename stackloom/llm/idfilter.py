"""A bitmap of ids, broadcast to keep rows that cannot match out of a shuffle.

One bit an id at a hashed place.  The bitmap has BITS_AN_ID bits for each id, and
MAX_BITS at most (16 MB, the bound of the broadcast); past that, and for the few
ids that share a place, more rows pass.  Every caller joins exactly what passed,
so the bitmap decides how much is shuffled and never what comes out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.llm.scratch import Scratch

BITS_AN_ID = 16
MIN_BITS, MAX_BITS = 1 << 15, 1 << 27
_BLOCK = 15
_OWN = ("block", "bits")


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The names wanted, longer by underscores where a caller's column has them."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


class IdFilter:
    """Built from a table of hashed ids (one long column); may_hold(rows, key) tests rows by the same hash."""

    def __init__(self, scratch: Scratch, name: str, ids: DataFrame, max_bits: int = MAX_BITS):
        column = ids.columns[0]
        self.bits = min(max(MIN_BITS, 1 << max(0, BITS_AN_ID * ids.count() - 1).bit_length()), max_bits)
        place = self._place(F.col(column))
        blocks = ids.select(F.shiftright(place, _BLOCK).alias(_OWN[0]), place.bitwiseAND((1 << _BLOCK) - 1).alias("at")).groupBy(_OWN[0])
        self.table = scratch.write(blocks.agg(F.bitmap_construct_agg("at").alias(_OWN[1])), name)

    def _place(self, key: Column) -> Column:
        return F.xxhash64(key).bitwiseAND(self.bits - 1)

    def split(self, rows: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
        """The rows that may be among the ids, and those that are not; key must be deterministic."""
        place = self._place(key)
        at = place.bitwiseAND((1 << _BLOCK) - 1)
        spot, block, bits = free_names(rows.columns, "__ids_at", "__ids_block", "__ids_bits")
        marked = rows.withColumn(spot, place).join(F.broadcast(self.table.toDF(block, bits)), F.shiftright(spot, _BLOCK) == F.col(block), "left")
        byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), at.bitwiseAND(7).cast("int"))) > 0, F.lit(False))
        own = [F.col(f"`{c}`") for c in rows.columns]
        return marked.filter(hit).select(*own), marked.filter(~hit).select(*own)

    def may_hold(self, rows: DataFrame, key: Column) -> DataFrame:
        return self.split(rows, key)[0]
