"""Joins of points with the intervals that contain them.

An interval goes to the buckets that it touches, two or few, on the first level
whose buckets are no smaller than it; a point is looked up once on each level that
intervals of its keys are on.  So the join has an equality beyond the keys, and no
pair of a point and an interval far from it is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.functions.addresses import saturating_end, wrapping_sub

#: Bits of a bucket's size on each level.
LEVELS = (12, 20, 28, 36, 44, 52, 60)


def bucketed(intervals: DataFrame, start: Column, length: Column) -> DataFrame:
    """intervals with `i_level` and `i_bucket`, a row for each bucket; empty ones go."""
    # a column of its own for each step: the expressions repeat what they take
    rows = intervals.withColumn("i_len", length).filter("i_len <> 0")
    size = F.col("i_len")
    level = F.lit(LEVELS[-1])
    for bits in reversed(LEVELS[:-1]):
        level = F.when((size >= 0) & (size <= 1 << bits), F.lit(bits)).otherwise(level)
    rows = rows.withColumn("i_level", level).withColumn("i_stop", saturating_end(start, size)).withColumn("i_last", wrapping_sub(F.col("i_stop"), F.lit(1).cast("long")))
    shifted = lambda x: F.call_function("shiftrightunsigned", x, F.col("i_level"))
    return rows.withColumn("i_bucket", F.explode(F.sequence(shifted(start), shifted(F.col("i_last"))))).drop("i_len", "i_stop", "i_last")


def levels_of(buckets: DataFrame, *keys: str) -> DataFrame:
    """(*keys, levels): the levels in use, a small array for each key."""
    return buckets.select(*keys, "i_level").distinct().groupBy(*keys).agg(F.collect_set("i_level").alias("levels"))


def probed(points: DataFrame, at: Column) -> DataFrame:
    """points (with `levels`) with `p_level` and `p_bucket`, a row for each level."""
    out = points.withColumn("p_level", F.explode("levels")).drop("levels")
    return out.withColumn("p_bucket", F.call_function("shiftrightunsigned", at, F.col("p_level")))
