"""Symbol lookup: nearest symbol at or below an address, best of overlapping symbols, order of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.functions.addresses import contains, order_key, wrapping_add, wrapping_sub
from stackloom.functions.names import debug_leaf


def kallsyms_table(symbols: DataFrame, seq: str = "seq") -> DataFrame:
    """One name for each address: one that starts with __pi_ if there is any, else the first."""
    rank = Window.partitionBy("addr").orderBy(F.col("name").startswith("__pi_").desc(), seq)
    return symbols.withColumn("rn", F.row_number().over(rank)).filter("rn = 1").drop("rn")


def first_address(symbols: DataFrame, seq: str = "seq") -> DataFrame:
    return symbols.groupBy("name").agg(F.min_by("addr", seq).alias("addr"))


#: Bits of the blocks in which addresses are looked up, and of the blocks of blocks.
BLOCK_BITS, OUTER_BITS = 20, 20


def nearest_below(addresses: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct addresses (addr) with the name of the greatest symbol address at or below, unsigned; null if there is none.

    Both sides go by blocks of 2**20 addresses, which hold as many rows of a side at
    most wherever addresses crowd, as those of a side are distinct.  A block's own
    symbols come first, then the last symbol of the blocks before it in its block of
    blocks, then that of the blocks of blocks before: small tables of a row a block.
    No job runs while the plan is made.
    """
    block = F.shiftrightunsigned("addr", BLOCK_BITS)
    want = addresses.select("addr").distinct().withColumn("block", block)
    sym = symbols.select("addr", "name").withColumn("block", block)
    rows = want.select("block", "addr", F.lit(None).cast("string").alias("name"), F.lit(1).alias("side")).union(sym.select("block", "addr", "name", F.lit(0).alias("side")))
    run = Window.partitionBy("block").orderBy(order_key(F.col("addr")), "side").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("name", F.last("name", ignorenulls=True).over(run)).filter("side = 1").select("addr", "block", "name")

    def before(keys: DataFrame, ends: DataFrame, key: str, within: list[str]) -> DataFrame:
        """keys with `before_<key>`, the last name of the keys below each, in the same group."""
        both = keys.join(ends, [*within, key], "full")
        own = Window.partitionBy(*within).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return both.withColumn(f"before_{key}", F.last("last", ignorenulls=True).over(own)).select(*within, key, f"before_{key}")

    outer = F.shiftrightunsigned("block", OUTER_BITS)
    ends = sym.groupBy("block").agg(F.max_by("name", order_key(F.col("addr"))).alias("last")).withColumn("outer", outer)
    below = before(want.select("block").distinct().withColumn("outer", outer), ends, "block", ["outer"])
    last = ends.groupBy("outer").agg(F.max_by("last", "block").alias("last"))
    # 2**24 rows at most, as addresses have 64 bits
    far = before(want.select(F.shiftrightunsigned("block", OUTER_BITS).alias("outer")).distinct(), last, "outer", [])
    found = inside.join(below, "block", "left").join(far, "outer", "left")
    return found.select("addr", F.coalesce("name", "before_block", "before_outer").alias("name"))


def relocated(addresses: DataFrame, symbols: DataFrame, reference: str | Column, recorded: int) -> DataFrame:
    """nearest_below for addresses of a kernel that was moved: shifted by where the reference symbol is now."""
    wanted = addresses.select("addr").withColumn("reference", F.lit(reference)).withColumn("recorded", F.lit(recorded).cast("long"))
    return relocated_below(wanted, symbols).select("addr", "name")


def relocated_below(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """requests (addr, reference, recorded), with the name at or below each address.

    Addresses that name a reference are shifted by where a listing has that symbol
    against where it was recorded, and find nothing in a listing without it.
    """
    keys = ["addr", "reference", "recorded"]
    at = first_address(symbols).select(F.col("name").alias("reference"), F.col("addr").alias("now"))
    moved = requests.select(*keys).distinct().join(at, "reference", "left").filter("reference is null or now is not null")
    shift = wrapping_sub(F.col("now"), F.col("recorded"))
    moved = moved.withColumn("at", F.when(F.col("reference").isNull(), F.col("addr")).otherwise(wrapping_add(F.col("addr"), shift)))
    found = nearest_below(moved.select(F.col("at").alias("addr")), kallsyms_table(symbols)).withColumnRenamed("addr", "at")
    return moved.join(found, "at").select(*keys, "name")


def is_module_path(path: Column) -> Column:
    """A bracketed mapping other than the kernel's own: a kernel module."""
    return path.startswith("[") & ~path.startswith("[kernel") & ~path.startswith("[guest.kernel]")


def is_kernel_object(path: Column) -> Column:
    return is_module_path(path) | path.startswith("[kernel.kallsyms]") | path.startswith("[kernel]") | path.startswith("[guest.kernel]")


def precedence(requests: DataFrame, objects: DataFrame, cached: DataFrame | None = None, system_map: DataFrame | None = None, live: DataFrame | None = None, kernel_image: DataFrame | None = None) -> DataFrame:
    """requests (path, addr, reference, recorded) with `name`, by the order in which sources are asked.

    The kernel: its cached listing, the system map, the live listing, the kernel
    image; a system map is not used beside a kernel image.  Modules: their cached
    object where there is one, whether it names the address or not; else the live
    listing, then the cached listing.  Other paths: their object.
    objects: (path, addr, name), a row for each address whose object was found, with a
    null name where that names nothing there; kernel_image: (addr, name); listings:
    (seq, addr, name).
    """
    keys = ["path", "addr", "reference", "recorded"]
    rows = requests.select(*keys).distinct()
    listed = {}
    for k, table in (("cached", cached), ("map", None if kernel_image is not None else system_map), ("live", live)):
        if table is not None:
            asked = rows.filter(is_kernel_object(F.col("path"))).select("addr", "reference", "recorded")
            listed[k] = relocated_below(asked, table).filter("name is not null").withColumnRenamed("name", k)
    if kernel_image is not None:
        listed["image"] = kernel_image.select("addr", F.lit(None).cast("string").alias("reference"), F.lit(None).cast("long").alias("recorded"), F.col("name").alias("image"))
    out = rows.join(objects.select("path", "addr", F.col("name").alias("object"), F.lit(True).alias("has_object")), ["path", "addr"], "left")
    for k, t in listed.items():
        t = t.select(F.col("addr").alias("t_addr"), F.col("reference").alias("t_ref"), F.col("recorded").alias("t_rec"), k)
        same = (F.col("addr") == F.col("t_addr")) & (F.lit(k == "image") | (F.col("reference").eqNullSafe(F.col("t_ref")) & F.col("recorded").eqNullSafe(F.col("t_rec"))))
        out = out.join(t, same, "left").drop("t_addr", "t_ref", "t_rec")
    name = lambda *order: F.coalesce(*[F.col(k) for k in order if k in (*listed, "object")], F.lit(None).cast("string"))
    chosen = F.when(is_module_path(F.col("path")) & F.col("has_object").isNull(), name("live", "cached")).when(is_module_path(F.col("path")), F.col("object")).when(is_kernel_object(F.col("path")), name("cached", "map", "live", "image")).otherwise(F.col("object"))
    return out.select(*keys, chosen.alias("name"))


def best_object_symbol(requests: DataFrame, symbols: DataFrame, page_bits: int = 12, rename=None) -> DataFrame:
    """requests (object, addr) with the symbol that contains each: greatest start; of equal starts one with a size, not weak, with fewer leading underscores, a longer name, the first.

    rename: from a column of names to that of the names that are compared and given.
    Symbols meet requests by object and page, so the join has an equality beyond the object.
    """
    usable = symbols.filter(F.col("defined") & (F.col("name") != "") & F.col("kind").isin("text", "data", "label"))
    span = F.greatest(F.col("size"), F.lit(1).cast("long"))
    pages = usable.withColumn("page", F.explode(F.sequence(F.shiftright("addr", page_bits), F.shiftright(F.col("addr") + span - 1, page_bits))))
    want = requests.select("object", "addr").distinct().withColumn("page", F.shiftright("addr", page_bits)).withColumnRenamed("addr", "at")
    hit = F.when(F.col("size") == 0, F.col("addr") == F.col("at")).otherwise(contains(F.col("addr"), F.col("size"), F.col("at")))
    both = want.join(pages, ["object", "page"]).filter(hit)
    if rename is not None:
        both = both.withColumn("name", rename(F.col("name")))
    rank = Window.partitionBy("object", "at").orderBy(
        order_key(F.col("addr")).desc(), (F.col("size") > 0).desc(), (F.col("binding") != "weak").desc(), F.length(F.regexp_extract("name", "^(_*)", 1)), F.octet_length("name").desc(), "seq"
    )
    return both.withColumn("rn", F.row_number().over(rank)).filter("rn = 1").select("object", F.col("at").alias("addr"), "name")


def requests(frames: DataFrame, *keys: str) -> DataFrame:
    """What is looked up: distinct keys."""
    return frames.select(*keys).distinct()


def misses(wanted: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Wanted keys that a cache of earlier answers has not."""
    return wanted.select(*keys).distinct().join(known.select(*keys), list(keys), "left_anti")


def first_found(wanted: DataFrame, keys: list[str], *sources: DataFrame) -> DataFrame:
    """wanted with `name` of the first source (keys, name) that has one."""
    out, names = wanted, []
    for k, s in enumerate(sources):
        out = out.join(s.filter("name is not null").select(*keys, F.col("name").alias(f"name_{k}")), keys, "left")
        names.append(f"name_{k}")
    return out.withColumn("name", F.coalesce(*names)).drop(*names)


def last_below(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """requests (object, addr) with the name of the greatest symbol at or below each, whatever its size; null if there is none.

    A window holds the table of one object and what is asked of it.
    """
    want = requests.select("object", "addr", F.lit(None).cast("string").alias("name"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("seq")).distinct()
    usable = symbols.filter(F.col("defined") & (F.col("name") != "") & (F.col("kind").isin("text", "data") | ((F.col("kind") == "label") & (F.col("size") > 0))))
    rows = want.unionByName(usable.select("object", "addr", "name", F.lit(0).alias("side"), (-F.col("seq")).alias("seq")))
    run = Window.partitionBy("object").orderBy(order_key(F.col("addr")), "side", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("name", F.last("name", ignorenulls=True).over(run)).filter("side = 1").select("object", "addr", "name")


def specialise(names: DataFrame, debug: DataFrame) -> DataFrame:
    """names (object, name) with `special`: the one specialised name that debug strings (object, leaf, name) give for their leaf; others are left out."""
    known = debug.select("object", "leaf", F.col("name").alias("special"))
    return names.select("object", "name").distinct().withColumn("leaf", debug_leaf(F.col("name"))).join(known, ["object", "leaf"]).select("object", "name", "special")
