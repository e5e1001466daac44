"""Off-CPU time: a switch out paired with the next switch in of the same pid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lanes(switches: DataFrame) -> DataFrame:
    """switches with `file` and `lane`: without a `file` all rows are of one recording; `cpu`, where there is one, tells the idle tasks apart that share pid 0."""
    if "file" not in switches.columns:
        switches = switches.withColumn("file", F.lit(""))
    cpu = F.when(F.col("pid") == 0, F.col("cpu")) if "cpu" in switches.columns else F.lit(None)
    return switches.withColumn("lane", F.coalesce(cpu.cast("long"), F.lit(-1).cast("long")))


def pairs(switches: DataFrame, time_bits: int = 32) -> DataFrame:
    """switches (file, pid, time, ord, out, kstack[, cpu]): (file, pid, kstack, start, delta) for each switch in that follows a switch out.

    A window holds one pid's switches of a block of 2**time_bits of time; the last
    switch before a block comes from a table of a row a pid and block, so a pid with
    any share of the switches spreads over tasks.
    """
    keys = ["file", "pid", "lane"]
    rows = lanes(switches).select(*keys, "time", "ord", "out", F.struct("out", "time", "kstack").alias("own"), F.shiftright("time", time_bits).alias("block"))
    inside = Window.partitionBy(*keys, "block").orderBy("time", "ord")
    ends = rows.groupBy(*keys, "block").agg(F.max_by("own", F.struct("time", "ord")).alias("last"))
    ends = ends.withColumn("carried", F.lag("last").over(Window.partitionBy(*keys).orderBy("block"))).drop("last")
    rows = rows.withColumn("before", F.lag("own").over(inside)).join(ends, [*keys, "block"])
    rows = rows.withColumn("before", F.coalesce("before", "carried")).filter(~F.col("out") & F.col("before.out"))
    return rows.select("file", "pid", F.col("before.kstack").alias("kstack"), F.col("before.time").alias("start"), (F.col("time") - F.col("before.time")).alias("delta"))


def by_stack(found: DataFrame) -> DataFrame:
    return found.groupBy("kstack").agg(F.sum("delta").alias("offcpu"), F.count("*").alias("switches"))
