"""Address to mapping: interval joins with a best match.

Mappings are rows (file, pid, start, len, pgoff, path, prot, ord).  Only distinct
(file, pid, address) triples are looked up.  Mappings and addresses meet by
recording, pid (that of all pids apart) and a bucket of addresses whose size fits
the mapping: each mapping lies in few buckets of its level, and an address is
looked up once a level, so the join has an equality that cuts a pid's table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.functions.addresses import ALL_PIDS, contains, is_kernel, order_key, saturating_end, wrapping_add, wrapping_sub
from stackloom.operators import intervals as I

NOT_CODE = ("//anon", "[anon]", "[stack]", "[heap]")
#: Names of the kernel's mapping.
KERNEL, KERNEL_NAMES = "[kernel.kallsyms]", ("[kernel.kallsyms]", "[kernel]", "[guest.kernel]")
#: Columns that tell which file was mapped, where a mapping has them.
IDENTITY = ("major", "minor", "inode")


def with_build_ids(mappings: DataFrame, build_ids: DataFrame) -> DataFrame:
    """Mappings without a build id of their own take that of the file header for their path; the last of one path wins."""
    own = build_ids.groupBy("file", "path").agg(F.max_by("build_id", "seq").alias("header_id"))
    return mappings.join(own, ["file", "path"], "left").withColumn("build_id", F.coalesce("build_id", "header_id")).drop("header_id")


def relative_address(at, start, pgoff, path, pid):
    """Offset in the mapped file; the address itself for bracketed mappings of all pids."""
    return F.when(path.startswith("[") & (pid == ALL_PIDS), at).otherwise(wrapping_add(wrapping_sub(at, start), pgoff))


def _sides(addresses: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """Addresses (file, pid, addr) by level and bucket, mappings by theirs, and when one contains the other."""
    m = I.bucketed(mappings, F.col("start"), F.col("len")).select(
        F.col("file").alias("m_file"), F.col("pid").alias("map_pid"), F.col("start").alias("map_start"), "len", "pgoff", F.col("path").alias("map_path"), "prot", "build_id", F.col("ord").alias("m_ord"), "i_level", "i_bucket",
        # what a pair compares is computed once a mapping
        order_key(F.col("start")).alias("m_low"), order_key(saturating_end(F.col("start"), F.col("len"))).alias("m_high"), *[c for c in ("m_at", *IDENTITY) if c in mappings.columns],
    )
    # the mappings of all pids are asked for under their own number; a pid is asked on the levels of its mappings
    whose = F.explode(F.array_distinct(F.array(F.col("pid"), F.lit(ALL_PIDS).cast("long")))).alias("asked")
    levels = I.levels_of(m, "m_file", "map_pid").select(F.col("m_file").alias("l_file"), F.col("map_pid").alias("l_pid"), "levels")
    probe = addresses.select("file", "pid", "addr", whose)
    probe = I.probed(probe.join(levels, (F.col("file") == F.col("l_file")) & (F.col("asked") == F.col("l_pid"))).drop("l_file", "l_pid"), F.col("addr")).withColumn("p_at", order_key(F.col("addr")))
    inside = (F.col("m_low") <= F.col("p_at")) & (F.col("p_at") < F.col("m_high"))
    on = (F.col("file") == F.col("m_file")) & (F.col("asked") == F.col("map_pid")) & (F.col("p_level") == F.col("i_level")) & (F.col("p_bucket") == F.col("i_bucket")) & inside
    return probe, m, on


def _found(addresses: DataFrame, mappings: DataFrame) -> DataFrame:
    """Every pair of an address (file, pid, addr) and a mapping that contains it, with the mapping's columns and its rank."""
    probe, m, on = _sides(addresses, mappings)
    rank = F.struct(F.col("m_low").alias("start"), (F.col("map_pid") == F.col("pid")).alias("own"), F.col("m_ord").alias("ord"))
    return probe.join(m, on).withColumn("rank", rank)


def resolve(addresses: DataFrame, mappings: DataFrame) -> DataFrame:
    """addresses (file, pid, addr) that a mapping contains, with map_path, map_pid, map_start, relative, prot, build_id and what is known of the file's identity.

    The mapping with the greatest start wins; of equal starts the pid's own, then
    the later one.
    """
    want = addresses.select("file", "pid", "addr").filter("pid is not null").distinct()
    best = _found(want, mappings).groupBy("file", "pid", "addr").agg(F.max_by(F.struct("map_pid", "map_start", "pgoff", "map_path", "prot", "build_id", *[c for c in IDENTITY if c in mappings.columns]), F.col("rank")).alias("m"))
    out = best.select("file", "pid", "addr", "m.*")
    return out.withColumn("relative", relative_address(F.col("addr"), F.col("map_start"), F.col("pgoff"), F.col("map_path"), F.col("map_pid")))


def noise_as_of(frames: DataFrame, mappings: DataFrame, ord_bits: int = 16, time_bits: int = 32) -> DataFrame:
    """frames (file, pid, addr, id, at) whose mapping at `at`, of those recorded before, is no code: (file, id, addr).

    Few addresses ever lie in such a mapping, and only those are looked up again.
    Mappings meet distinct addresses, not frames: a frame takes the best so far of its
    address, a running maximum inside a block of the recording's order and one over
    the blocks before, so the work is that of the pairs plus the frames.
    """
    keys = ["file", "pid", "addr"]
    probe, m, on = _sides(frames.select(*keys).filter("pid is not null").distinct(), mappings.filter(is_dropped_unwind(F.col("path"))))
    some = probe.join(m, on, "left_semi").select(*keys).distinct()
    at = F.struct(order_key(F.coalesce("time", F.lit(0).cast("long"))).alias("time"), F.col("ord").alias("ord"))
    best = F.struct("rank.*", is_dropped_unwind(F.col("map_path")).alias("noise"))
    found = _found(some, mappings.withColumn("m_at", at)).select(*keys, F.lit(None).cast(frames.schema["id"].dataType).alias("id"), F.col("m_at").alias("at"), F.lit(1).alias("side"), best.alias("best"))
    asked = frames.join(some, keys).select(*keys, "id", F.col("at").cast(found.schema["at"].dataType).alias("at"), F.lit(0).alias("side"), F.lit(None).cast(found.schema["best"].dataType).alias("best"))
    # rows without time by number, then the others by time
    none = F.col("at.time") == order_key(F.lit(0).cast("long"))
    timed = F.struct(F.shiftright("at.time", time_bits).alias("t"), F.lit(2**62).cast("long").alias("o"))
    block = F.when(none, F.struct(F.shiftright("at.time", time_bits).alias("t"), F.shiftright("at.ord", ord_bits).alias("o"))).otherwise(timed)
    rows = asked.unionByName(found).withColumn("block", block)
    # a mapping counts for what comes after it
    run = Window.partitionBy(*keys, "block").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, "block").agg(F.max("best").alias("own")).withColumn("before", F.max("own").over(before)).select(*keys, "block", "before")
    inside = rows.withColumn("inside", F.max("best").over(run)).filter("side = 0")
    out = inside.join(ends, [*keys, "block"]).filter(F.greatest("inside", "before")["noise"])
    return out.select("file", "id", "addr").distinct()


def is_recording_path(path):
    """The recording's own buffers, and those of earlier ones beside it."""
    name = F.element_at(F.split(path, "/"), -1)
    return (name == "perf.data") | name.startswith("perf.data.")


def executable_pids(mappings: DataFrame) -> DataFrame:
    """(file, pid) with a mapping that is not known to be non-executable."""
    known = F.coalesce(F.col("prot").bitwiseAND(4) == 0, F.lit(False)) | is_recording_path(F.col("path"))
    return mappings.filter(~known).select("file", "pid").distinct()


def with_executable_maps(rows: DataFrame, mappings: DataFrame) -> DataFrame:
    """The rows whose pid has executable mappings, its own or those of all pids: a semi join."""
    pids = executable_pids(mappings)
    every = pids.filter(F.col("pid") == ALL_PIDS).select("file")
    own = rows.join(pids, ["file", "pid"], "left_semi")
    rest = rows.join(pids, ["file", "pid"], "left_anti").join(every, "file", "left_semi")
    return own.unionByName(rest)


def user_mappings(mappings: DataFrame) -> DataFrame:
    return mappings.filter(~F.col("path").startswith("[") & (F.col("pid") != ALL_PIDS))


def is_dropped_unwind(path):
    """An unwound frame in the recording's own buffer, in anonymous memory, stack or heap is noise."""
    return F.coalesce(path.isin(*NOT_CODE) | is_recording_path(path), F.lit(False))


def is_kernel_mapping(path, relative):
    """A bracketed mapping that leads to a kernel address."""
    return path.startswith("[") & is_kernel(relative)


def symbolizes(addr, path, relative):
    """Kernel addresses are looked up under kernel mappings only."""
    return ~is_kernel(addr) | is_kernel_mapping(path, relative)


def request_path(path, relative):
    """The object in which a symbol is looked up: all names of the kernel's own mapping are one."""
    return F.when(is_kernel_mapping(path, relative) & path.startswith("[kernel"), F.lit(KERNEL)).otherwise(path)


def kernel_relocation(path, pgoff):
    """(reference, recorded): the symbol that a kernel mapping's path names behind its brackets, and where it was; null elsewhere."""
    name = F.substring(path, len(KERNEL) + 1, 2**31 - 1)
    return F.when(path.startswith(KERNEL) & (name != ""), F.struct(name.alias("reference"), pgoff.alias("recorded")))


def kernel_build_id(build_ids: DataFrame) -> DataFrame:
    """(file, build_id) of the first header entry that stands for the kernel."""
    return build_ids.filter(F.col("path").isin(*KERNEL_NAMES)).groupBy("file").agg(F.min_by("build_id", "seq").alias("build_id"))


def file_offset_to_address(offsets: DataFrame, segments: DataFrame) -> DataFrame:
    """offsets (object, offset) with the address of the first load segment that holds them; those in none keep null."""
    inside = contains(F.col("file_offset"), F.col("file_size"), F.col("offset"))
    s = segments.select(F.col("object").alias("o"), "seq", "file_offset", "file_size", "addr")
    hit = offsets.select("object", "offset").distinct().join(s, (F.col("object") == F.col("o")) & inside)
    first = hit.groupBy("object", "offset").agg(F.min_by(wrapping_add(F.col("addr"), wrapping_sub(F.col("offset"), F.col("file_offset"))), "seq").alias("address"))
    return offsets.join(first, ["object", "offset"], "left")
