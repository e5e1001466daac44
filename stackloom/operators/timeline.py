"""Operators that replace a sequential replay: as-of names, first event, deferred chains.

Records of one recording are ordered by (time or 0, unsigned; ord).  `file`
separates recordings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackloom.functions.addresses import order_key


def replay_order():
    return [order_key(F.coalesce("time", F.lit(0).cast("long"))), F.col("ord")]


def _block(time_bits: int, ord_bits: int):
    """A part of a recording's order: rows without time by number, then the others by time."""
    t = F.coalesce("time", F.lit(0).cast("long"))
    timed = F.struct(F.shiftrightunsigned(t, time_bits).alias("t"), F.lit(2**62).alias("o"))
    return F.when(t != 0, timed).otherwise(F.struct(F.lit(0).cast("long").alias("t"), F.shiftright("ord", ord_bits).alias("o")))


def _last_so_far(rows: DataFrame, keys: list[str], values: dict) -> DataFrame:
    """rows with the last value so far of each key, for each name in values, by blocks.

    A running window holds one block of one key; the last values of the blocks
    before come from a table of a row a key and block.  So a key with any share of
    the rows spreads over tasks.
    """
    known = F.col(keys[-1]).isNotNull()
    rows = rows.withColumns({f"v_{k}": v for k, v in values.items()})
    run = Window.partitionBy(*keys, "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max_by(f"v_{k}", F.when(F.col(f"v_{k}").isNotNull(), F.col("at"))).alias(f"before_{k}") for k in values]
    ends = rows.filter(known).groupBy(*keys, "block").agg(*last)
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({f"before_{k}": F.last(f"before_{k}", ignorenulls=True).over(before) for k in values})
    out = rows.withColumns({f"inside_{k}": F.when(known, F.last(f"v_{k}", ignorenulls=True).over(run)) for k in values}).join(ends, [*keys, "block"], "left")
    return out.withColumns({k: F.coalesce(f"inside_{k}", f"before_{k}") for k in values}).drop(*[f"{x}_{k}" for x in ("v", "inside", "before") for k in values])


def comm_as_of(samples: DataFrame, comms: DataFrame, time_bits: int = 32, ord_bits: int = 20) -> DataFrame:
    """samples with `comm`: the last name set before each, of an exec of its pid, else of its thread, else of any thread of its pid.

    Only places and ids go through the windows; the names found are joined to the
    samples by (file, ord), which is one record.
    """
    key, block = F.struct(*replay_order()), _block(time_bits, ord_bits).alias("block")
    s = samples.select("file", "ord", "pid", "tid", key.alias("at"), block, F.lit(None).cast("string").alias("name"), F.lit(False).alias("is_exec"), F.lit(True).alias("asks"))
    c = comms.select("file", "ord", "pid", "tid", key.alias("at"), block, F.col("comm").alias("name"), F.coalesce("is_exec", F.lit(False)).alias("is_exec"), F.lit(False).alias("asks"))
    out = _last_so_far(s.unionByName(c), ["file", "pid"], {"e": F.when(F.col("is_exec"), F.col("name")), "p": F.col("name")})
    out = _last_so_far(out, ["file", "tid"], {"t": F.col("name")}).filter("asks")
    named = out.select("file", "ord", F.coalesce("e", "t", "p").alias("comm"))
    return samples.join(named, ["file", "ord"]).select(*samples.columns, "comm")


def first_event_only(samples: DataFrame) -> DataFrame:
    """The samples of the event that is first in each recording; a row a file is broadcast back only if small."""
    first = samples.groupBy("file").agg(F.min_by("event_index", F.struct(*replay_order())).alias("first"))
    return samples.join(first, "file").filter(F.col("event_index") == F.col("first")).drop("first")


def merge_deferred(samples: DataFrame, deferred: DataFrame) -> DataFrame:
    """Samples with a cookie take the frames of the first deferred chain after them with that cookie; those without any go.

    `seen` is the place in the recording at which a stack is whole.  The running
    minimum from below finds the chain without joining every pair of one cookie.
    """
    key = F.struct(*replay_order())
    plain = samples.filter("cookie is null").withColumn("seen", key)
    wait = samples.filter("cookie is not null")
    s = wait.select(F.struct(*samples.columns).alias("s"), "file", "cookie", key.alias("at"), F.lit(None).cast("array<bigint>").alias("ips"), F.lit(1).alias("side"))
    d = deferred.select(F.lit(None).cast(s.schema["s"].dataType).alias("s"), "file", "cookie", key.alias("at"), F.coalesce("ips", F.array().cast("array<bigint>")).alias("ips"), F.lit(0).alias("side"))
    after = Window.partitionBy("file", "cookie").orderBy("at", "side").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    chain = F.when(F.col("side") == 0, F.struct("ips", "at"))
    found = s.unionByName(d).withColumn("next", F.first(chain, ignorenulls=True).over(after)).filter("s is not null and next is not null")
    out = found.select("s.*", "next").withColumn("callchain", F.concat("callchain", "next.ips")).withColumn("cookie", F.lit(None).cast("long")).withColumn("seen", F.col("next.at"))
    return plain.unionByName(out.drop("next"))
