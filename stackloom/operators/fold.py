"""Folded stacks: two aggregations around the lookup of frames.

Raw stacks are aggregated by addresses first, so mappings and symbols are looked
up once for each distinct stack; rendered stacks are aggregated again, since
different addresses may render alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.functions.addresses import ALL_PIDS, hex_address, is_kernel, is_marker
from stackloom.functions.names import UNKNOWN, comm_label, mapped_label, module_label, render_tidy_stack
from stackloom.operators import mappings as M
from stackloom.operators import timeline


def code_frames(chain: Column) -> Column:
    return F.filter(chain, lambda x: ~is_marker(x))


def fold_frames(callchain: Column, unwound: Column) -> Column:
    """Root first; unwound frames follow the call chain, so they come first.  Kind 1: unwound."""
    kind = lambda k: lambda x: F.struct(x.alias("addr"), F.lit(k).alias("kind"))
    return F.reverse(F.filter(F.concat(F.transform(callchain, kind(0)), F.transform(unwound, kind(1))), lambda x: ~is_marker(x["addr"])))


def weight(count_periods: bool) -> Column:
    return F.coalesce("period", F.lit(1).cast("long")) if count_periods else F.lit(1).cast("long")


def raw_stacks(samples: DataFrame, comms: DataFrame, deferred: DataFrame | None = None, count_periods: bool = False, mappings: DataFrame | None = None) -> DataFrame:
    """(file, pid, comm, frames, count): the samples of the first event, by pid, name at sample time, and addresses.

    mappings: with `time` and `ord`, to drop unwound frames that lay in no code when their stack was recorded.
    """
    first = timeline.first_event_only(samples)
    named = timeline.comm_as_of(first, comms)
    named = timeline.merge_deferred(named, deferred) if deferred is not None else named.withColumn("seen", F.struct(*timeline.replay_order()))
    unwound = F.coalesce("unwound", F.array().cast("array<bigint>")) if "unwound" in samples.columns else F.array().cast("array<bigint>")
    named = named.withColumn("unwound", F.filter(unwound, lambda x: ~is_marker(x)))
    if mappings is not None and "unwound" in samples.columns:
        asked = named.select("file", "pid", F.explode("unwound").alias("addr"), F.col("ord").alias("id"), F.col("seen").alias("at")).filter(~is_kernel(F.col("addr")) & F.col("pid").isNotNull())
        gone = M.noise_as_of(asked, mappings).groupBy("file", F.col("id").alias("ord")).agg(F.collect_set("addr").alias("noise"))
        named = named.join(gone, ["file", "ord"], "left")
        named = named.withColumn("unwound", F.when(F.col("noise").isNull(), F.col("unwound")).otherwise(F.filter("unwound", lambda x: ~F.array_contains("noise", x))))
    stacks = named.select("file", "pid", "comm", fold_frames(F.col("callchain"), F.col("unwound")).alias("frames"), weight(count_periods).alias("count"))
    return stacks.filter(F.size("frames") > 0).groupBy("file", "pid", "comm", "frames").agg(F.sum("count").alias("count"))


def frame_label(addr: Column, path: Column, relative: Column, symbols: bool = False) -> Column:
    """The label of a frame without a symbol."""
    kernel, outside = is_kernel(addr), F.lit(UNKNOWN)
    stray = kernel & ~M.is_kernel_mapping(path, relative)
    if symbols:
        inside = F.when(M.is_kernel_mapping(path, relative) | (path == UNKNOWN), F.lit(UNKNOWN)).when(path.startswith("["), mapped_label(path, relative)).otherwise(module_label(path))
    else:
        inside = F.when(kernel, UNKNOWN).otherwise(mapped_label(path, relative))
        outside = F.when(kernel, UNKNOWN).otherwise(hex_address(addr))
    return F.when(path.isNull(), outside).when(stray, hex_address(addr)).otherwise(inside)


def stack_id() -> Column:
    """128 bits of a raw stack's key: frames go through joins with it instead of the whole stack."""
    key = ["file", "pid", "comm", "frames"]
    return F.struct(F.xxhash64(*key).alias("a"), F.xxhash64(F.lit("stack"), *reversed(key)).alias("b"))


def placed_frames(stacks: DataFrame, mappings: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """A row for each frame of each stack: (id, file, pid, comm, count, pos, addr, kind, path, relative, drops, names).

    symbols: (file, pid, addr, names) with the names of an address, outermost first;
    names is null where a frame has none.  drops: frames that belong to no code.
    """
    flat = stacks.select(stack_id().alias("id"), "file", "pid", "comm", "count", F.posexplode("frames").alias("pos", "f"))
    flat = flat.select("id", "file", "pid", "comm", "count", "pos", F.col("f.addr").alias("addr"), F.col("f.kind").alias("kind"))
    found = M.resolve(flat, mappings).select("file", "pid", "addr", F.col("map_path").alias("path"), "relative")
    flat = flat.join(found, ["file", "pid", "addr"], "left")
    drops = (F.col("kind") == 1) & ~is_kernel(F.col("addr")) & M.is_dropped_unwind(F.col("path"))
    if symbols is None:
        pids = M.executable_pids(mappings)
        every = pids.filter(F.col("pid") == ALL_PIDS).select("file").distinct().withColumn("all_exec", F.lit(True))
        flat = flat.join(pids.withColumn("own_exec", F.lit(True)), ["file", "pid"], "left").join(every, "file", "left")
        runs_code = F.coalesce("own_exec", "all_exec", F.lit(False))
        valid = (F.col("kind") == 0) | F.col("pid").isNull() | ~runs_code | F.col("path").isNotNull() | is_kernel(F.col("addr"))
        return flat.withColumn("drops", drops | ~valid).withColumn("names", F.lit(None).cast("array<string>")).drop("own_exec", "all_exec")
    flat = flat.join(symbols, ["file", "pid", "addr"], "left")
    known = F.col("path").isNotNull() & M.symbolizes(F.col("addr"), F.col("path"), F.col("relative")) & (F.size(F.coalesce("names", F.array())) > 0)
    return flat.withColumn("drops", drops).withColumn("names", F.when(known, F.col("names")))


def labelled_stacks(stacks: DataFrame, mappings: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(id, file, pid, comm, count, labels): labels root first, the comm label in front; symbols as in placed_frames."""
    flat = placed_frames(stacks, mappings, symbols)
    names = F.coalesce("names", F.array(frame_label(F.col("addr"), F.col("path"), F.col("relative"), symbols is not None)))
    # a stack whose frames all drop still counts under its comm label
    flat = flat.withColumn("names", F.when(F.col("drops"), F.array().cast("array<string>")).otherwise(names))
    own = [F.first(c).alias(c) for c in ("file", "pid", "comm", "count")]
    lists = flat.groupBy("id").agg(*own, F.sort_array(F.collect_list(F.struct("pos", "names"))).alias("l"))
    return lists.select("id", "file", "pid", "comm", "count", F.concat(F.array(comm_label(F.col("comm"))), F.flatten(F.transform("l", lambda x: x["names"]))).alias("labels"))


def folded(stacks: DataFrame, mappings: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(stack, count): rendered and summed; write it in stack order with sinks.write_folded."""
    s = labelled_stacks(stacks, mappings, symbols)
    return s.select(render_tidy_stack(F.col("labels")).alias("stack"), "count").groupBy("stack").agg(F.sum("count").alias("count"))
