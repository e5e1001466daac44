"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm.scratch import Scratch


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, comp): comp is the smallest node reachable over edges (a, b); nodes without an edge to another don't appear.

    Every round is two aggregations and two joins on node keys (a hub's partial
    minimum is taken before the shuffle, its rows are split by AQE), and is
    written to the shared folder, so a lost executor costs one round at most.
    """
    e = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}_0")
    k, seen = 0, None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: a's greater neighbours point at the least of a's neighbourhood
        large = both.join(low.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a's lesser neighbours, and a, point at the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").select(F.col("b").alias("x"), "a", "m")
        nxt = small.select(F.col("x").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        k += 1
        nxt = scratch.write(nxt, f"{tag}_{k}")
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{tag}_{k - 1}")
        e = nxt
        if state == seen:
            break
        seen = state
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(roots.select("node", F.col("node").alias("comp")))
