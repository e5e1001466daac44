"""The recording report: totals, modes, threads, leaf addresses, call edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.functions.addresses import hex16
from stackloom.operators.fold import code_frames

MOST = 18446744073709551615
#: Names of cpu modes by number.
MODES = {1: "kernel", 2: "user", 3: "hypervisor", 4: "guest-kernel", 5: "guest-user"}


def mode_name(mode: Column) -> Column:
    out = F.when(mode == 1, MODES[1])
    for k in (2, 3, 4, 5):
        out = out.when(mode == k, MODES[k])
    return out.otherwise("unknown")


def saturating_sum(c: Column) -> Column:
    """A sum of unsigned longs, 2**64 - 1 at most, as a decimal."""
    big = lambda x: F.lit(str(x)).cast("decimal(20,0)")
    unsigned = c.cast("decimal(20,0)") + F.when(c < 0, big(2**64)).otherwise(big(0))
    return F.least(F.coalesce(F.sum(unsigned), big(0)).cast("decimal(38,0)"), big(MOST).cast("decimal(38,0)")).cast("decimal(20,0)")


def _counts() -> list[Column]:
    return [F.count("*").alias("samples"), saturating_sum(F.coalesce("period", F.lit(1).cast("long"))).alias("weight")]


def totals(samples: DataFrame) -> DataFrame:
    reg = F.col("user_register_count") > 0
    return samples.agg(
        *_counts(), F.count_if("has_user_stack").alias("user_stack_samples"), F.coalesce(F.sum("user_stack_size"), F.lit(0)).alias("user_stack_bytes"),
        saturating_sum(F.col("user_stack_dynamic_size")).alias("user_stack_dynamic_bytes"), F.count_if(reg).alias("user_register_samples"), F.count_if(F.col("user_register_ip").isNotNull()).alias("user_register_ip_samples"),
    )


def record_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("record_type").agg(F.count("*").alias("records")).orderBy("record_type")


def lost(rows: DataFrame) -> DataFrame:
    return rows.agg(saturating_sum(F.col("lost")).alias("lost"))


def sample_modes(samples: DataFrame) -> DataFrame:
    """A row for each mode number, so several unknown ones stay apart."""
    return samples.groupBy("cpumode").agg(*_counts()).select(mode_name(F.col("cpumode")).alias("mode"), "cpumode", "samples", "weight").orderBy(F.desc("weight"), "mode")


def last_comms(comms: DataFrame, by: str = "tid") -> DataFrame:
    """The last name of each thread (or, by="pid", process) of a recording in file order."""
    return comms.groupBy("file", by).agg(F.max_by("comm", "ord").alias("comm"))


def threads(samples: DataFrame, comms: DataFrame, limit: int = 30) -> DataFrame:
    by = samples.withColumn("tid", F.coalesce("tid", "pid")).filter("tid is not null").groupBy("file", "tid").agg(*_counts()).orderBy(F.desc("weight"), "tid", "file").limit(limit)
    named = by.join(last_comms(comms), ["file", "tid"], "left")
    return named.withColumn("comm", F.coalesce("comm", F.concat(F.lit("tid "), F.col("tid").cast("string")))).orderBy(F.desc("weight"), "tid", "file")


def leaf_ips(samples: DataFrame, limit: int = 30) -> DataFrame:
    leaf = F.get(code_frames(F.col("callchain")), F.lit(0))
    return samples.withColumn("ip", leaf).filter("ip is not null").groupBy("ip").agg(*_counts()).select(hex16(F.col("ip")).alias("ip"), "samples", "weight").orderBy(F.desc("weight"), "ip").limit(limit)


def call_edges(samples: DataFrame, limit: int = 30) -> DataFrame:
    """caller and callee of neighbours in a chain, leaf first: the caller follows."""
    f = F.col("f")
    n = F.size("f")
    pairs = F.when(n > 1, F.zip_with(F.slice(f, 2, F.greatest(n - 1, F.lit(0))), F.slice(f, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("caller"), b.alias("callee"))))
    edges = samples.select("period", code_frames(F.col("callchain")).alias("f")).select("period", F.inline(pairs))
    out = edges.groupBy("caller", "callee").agg(*_counts())
    return out.select(hex16(F.col("caller")).alias("caller"), hex16(F.col("callee")).alias("callee"), "samples", "weight").orderBy(F.desc("weight"), "caller", "callee").limit(limit)


def comm_list(comms: DataFrame) -> DataFrame:
    return comms.select("file", "ord", "comm").orderBy("file", "ord")


def mapping_paths(mappings: DataFrame) -> DataFrame:
    return mappings.select("file", "ord", "path").orderBy("file", "ord")
