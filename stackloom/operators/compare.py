"""Summaries and comparison of folded stacks, and of strace calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folded_summary(rows: DataFrame) -> DataFrame:
    """rows of sources.text.folded: lines (malformed ones too), bytes with line ends, and the total count."""
    return rows.agg(F.count("*").alias("folded_lines"), F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0)).alias("folded_bytes"), F.coalesce(F.sum("count"), F.lit(0)).alias("total_count"))


def folded_top(rows: DataFrame) -> DataFrame:
    return rows.filter("count is not null").select("stack", "count").orderBy(F.desc("count"), "stack")


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Stacks whose counts differ or that one side lacks: a full outer join by stack."""
    l, r = left.select("stack", F.col("count").alias("left_count")), right.select("stack", F.col("count").alias("right_count"))
    return l.join(r, "stack", "full_outer").filter(~F.col("left_count").eqNullSafe(F.col("right_count")))


def only_left(left: DataFrame, right: DataFrame) -> DataFrame:
    """left rows that right has not with that count; a missing right stack counts as 0."""
    r = right.select("stack", F.col("count").alias("r"))
    return left.join(r, "stack", "left").filter(F.col("count") != F.coalesce("r", F.lit(0))).select("stack", "count")


def differences(left: DataFrame, right: DataFrame, most: int = 1000) -> DataFrame:
    """The first differences of either side in stack order, `most` a side: a report."""
    side = lambda d, s: d.withColumn("side", F.lit(s)).orderBy("stack").limit(most)
    return side(only_left(left, right), "left").unionByName(side(only_left(right, left), "right"))


def strace_totals(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count("*").alias("total_calls"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("total_seconds"))


def strace_by_syscall(calls: DataFrame) -> DataFrame:
    return calls.filter("syscall is not null").groupBy("syscall").agg(F.count("*").alias("calls"), F.sum("seconds").alias("total_seconds")).orderBy("syscall")


def weight_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_weight"))
