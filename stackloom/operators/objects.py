"""Names of user frames: the object behind a mapping, its segments, symbol table, debug information and debug strings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.functions.addresses import within, wrapping_sub
from stackloom.functions.names import normal_debug_name, readable_debug_name, readable_symbol_name
from stackloom.operators import intervals as I
from stackloom.operators.inlines import inline_chains
from stackloom.operators.mappings import IDENTITY, file_offset_to_address
from stackloom.operators.symbols import best_object_symbol, last_below, specialise
from stackloom.sources import dwarf, elf, host

KEYS = ("path", "build_id", *IDENTITY)


def files(asked: DataFrame, folder: str | None = None) -> DataFrame:
    """Distinct KEYS of asked with `object`, the file that has their symbols; keys without one are left out.

    Files are looked for by the executors, which must see them under the recorded paths or in `folder`.
    """

    def run(batches):
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                device = None if r["major"] is None or r["minor"] is None else (r["major"], r["minor"])
                found.append(host.object_file(r["path"], r["build_id"], None if r["inode"] is None else r["inode"] & (1 << 64) - 1, device, folder))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "object"])

    keys = asked.select(*KEYS).filter("path is not null").distinct()
    return keys.mapInArrow(run, "path string, build_id string, major long, minor long, inode long, object string").filter("object is not null")


def units_asked(placed: DataFrame, units: DataFrame) -> DataFrame:
    """Distinct (object, unit) of units (object, unit, low, high) that hold an address of placed (object, at)."""
    u = I.bucketed(units, F.col("low"), wrapping_sub(F.col("high"), F.col("low")))
    want = I.probed(placed.select("object", "at").distinct().join(I.levels_of(u, "object"), "object"), F.col("at"))
    u = u.select(F.col("object").alias("u_object"), "unit", "low", "high", "i_level", "i_bucket")
    on = (F.col("object") == F.col("u_object")) & (F.col("p_level") == F.col("i_level")) & (F.col("p_bucket") == F.col("i_bucket")) & within(F.col("low"), F.col("high"), F.col("at"))
    return want.join(u, on).select("object", "unit").distinct()


def frames(placed: DataFrame, known: DataFrame, table: DataFrame, functions: DataFrame) -> DataFrame:
    """Distinct (object, at) of placed with `names`, the frames there from the outermost inwards; null where nothing names it.

    Inlined calls of debug information say most; then the symbol that contains the
    address, the last one below it, the function of debug information.  A single
    frame takes the symbol's name where that has fewer leading underscores.  At last
    frames take the specialised names that the object's debug strings have for them.
    """
    want = placed.select("object", F.col("at").alias("addr")).distinct()
    base = best_object_symbol(want, table, rename=readable_symbol_name).withColumnRenamed("name", "base")
    rows = want.join(base, ["object", "addr"], "left")
    functions = functions.withColumns({"name": normal_debug_name("name"), "linkage": readable_debug_name(F.col("linkage"))})
    chains = inline_chains(rows, functions).select("object", "addr", "names", "linked")
    below = last_below(rows.filter("base is null"), table).filter("name is not null").select("object", "addr", readable_debug_name(F.col("name")).alias("below"))
    rows = rows.join(chains, ["object", "addr"], "left").join(below, ["object", "addr"], "left")
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
    rows = rows.withColumn("names", F.coalesce("names", one("base"), one("below"), "linked"))
    marks = lambda c: F.length(F.regexp_extract(c, "^(_*)", 1))
    shorter = (F.size("names") == 1) & (marks(F.col("base")) < marks(F.col("names")[0]))
    rows = rows.select("object", "addr", F.when(shorter, one("base")).otherwise(F.col("names")).alias("names"))
    each = rows.select("object", "addr", F.posexplode("names").alias("pos", "name"))
    special = specialise(each, elf.debug_strings(known.join(each.select("object").distinct(), "object", "left_semi")))
    each = each.join(special, ["object", "name"], "left").select("object", "addr", F.struct("pos", F.coalesce("special", "name").alias("name")).alias("f"))
    named = each.groupBy("object", "addr").agg(F.sort_array(F.collect_list("f")).alias("l")).select("object", "addr", F.transform("l", lambda x: x["name"]).alias("names"))
    return rows.select("object", "addr").join(named, ["object", "addr"], "left").select("object", F.col("addr").alias("at"), "names")


def names(asked: DataFrame, folder: str | None = None, keep=lambda df: df) -> DataFrame:
    """Distinct (*KEYS, addr) of asked whose object was found, with `names` as in frames; null where it names nothing there.

    addr is an offset in the file; in no load segment it stands for an address itself.
    keep: cuts the lineage of small tables that are read several times.
    """
    known = keep(files(asked, folder))
    key = F.struct(*KEYS)
    rows = asked.select(*KEYS, "addr").distinct().join(known.select(key.alias("k"), "object"), key == F.col("k")).select(*KEYS, "addr", "object")
    wanted = rows.select("object", F.col("addr").alias("offset")).distinct()
    placed = keep(file_offset_to_address(wanted, elf.segments_of(known)).withColumn("at", F.coalesce("address", "offset")).select("object", "offset", "at"))
    functions = dwarf.functions_of(units_asked(placed, dwarf.units_of(known)))
    found = frames(placed, known.select("object").distinct(), elf.symbols_of(known), functions)
    found = placed.join(found, ["object", "at"]).select("object", F.col("offset").alias("addr"), "names")
    return rows.join(found, ["object", "addr"], "left").select(*KEYS, "addr", "names")
