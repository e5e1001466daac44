"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from stackloom.plans import profile_queries

HEADLINE = ("perf_totals", "threads_topk", "leaf_ips_topk", "call_edges_topk", "comm_asof", "mapping_interval", "raw_stack_agg", "fold_mapped", "fold_symbolized", "kallsyms_asof", "object_symbol_best", "fg_parse", "fg_categories", "fg_diff", "folded_compare", "strace_summary", "bpftrace_blocks", "offcpu_pairs")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    profile_queries.perf_totals(spark, sf_dir).collect()
    took = {}
    for name in HEADLINE:
        began = time.time()
        profile_queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
