"""Questions to flamegraph entries (doc, pos, name, samples, percent)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackloom.functions.names import category, syscall_name


def _ranked(entries: DataFrame) -> DataFrame:
    """By share, then name; entries alike in both keep their place in the document."""
    return entries.orderBy(F.desc("percent"), "name", "doc", "pos")


def top(entries: DataFrame, limit: int = 30, min_percent: float = 1.0) -> DataFrame:
    return _ranked(entries.filter(F.col("percent") >= min_percent)).limit(limit)


def search(entries: DataFrame, pattern: str) -> DataFrame:
    return _ranked(entries.filter(F.lower("name").contains(pattern.lower())))


def syscalls(entries: DataFrame) -> DataFrame:
    return _ranked(entries.withColumn("name", syscall_name(F.col("name"))).filter("name is not null"))


def categories(entries: DataFrame) -> DataFrame:
    return entries.groupBy(category(F.col("name")).alias("name")).agg(F.sum("percent").alias("percent")).orderBy(F.desc("percent"), "name")


def by_name(entries: DataFrame) -> DataFrame:
    """One entry a name: the last in the order of percent descending, name, document, place."""
    last = Window.partitionBy("name").orderBy("percent", *([F.desc("doc")] if "doc" in entries.columns else []), F.desc("pos"))
    return entries.withColumn("rn", F.row_number().over(last)).filter("rn = 1").select("name", "samples", "percent")


def diff(before: DataFrame, after: DataFrame, min_abs_delta_percent: float = 0.0) -> DataFrame:
    b = by_name(before).select("name", F.col("samples").alias("before_samples"), F.col("percent").alias("before_percent"))
    a = by_name(after).select("name", F.col("samples").alias("after_samples"), F.col("percent").alias("after_percent"))
    both = b.join(a, "name", "full_outer").na.fill(0).withColumn("delta_percent", F.col("after_percent") - F.col("before_percent"))
    return both.filter(F.abs("delta_percent") >= min_abs_delta_percent).orderBy(F.desc(F.abs("delta_percent")), "name")
