"""Profile tables derived from the star-schema tables, the same way in Spark and in SQL.

events stand for samples, thread names, switches and text lines; part for
mappings and object symbols; supplier for kernel symbols.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("foyer_get", "nntp_read", "rustls::read", "zstd_block", "__x64_sys_recvfrom", "vfs_write", "futex_wait", "epoll_wait", "tokio::runtime::park", "__x64_sys_brk", "schedule", "malloc", "main", "all", "do_syscall_64")
_LIST = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"

SAMPLES_SQL = """samples AS (
  SELECT event_id AS ord, user_id % 8 AS pid, user_id AS tid, CAST(round(value * 100) AS BIGINT) AS period, event_id % 6 AS cpumode, event_id % 2 AS event_index,
    list_concat(CASE WHEN event_id % 5 = 0 THEN [CAST(-128 AS BIGINT)] ELSE CAST([] AS BIGINT[]) END, [4096 + (user_id % 16) * 16, 8192 + (event_id % 7) * 32, 12288 + (user_id % 3) * 64]) AS chain
  FROM events WHERE event_id % 97 <> 0)"""
COMMS_SQL = "comms AS (SELECT event_id AS ord, user_id % 8 AS pid, user_id AS tid, event_type AS comm, event_id % 291 = 0 AS is_exec FROM events WHERE event_id % 97 = 0)"
MAPPINGS_SQL = """mappings AS (
  SELECT p_partkey AS ord, CASE WHEN p_partkey % 50 = 0 THEN 4294967295 ELSE p_partkey % 8 END AS pid, 4096 + (p_partkey % 64) * 256 AS start, 512 + p_size * 16 AS len, p_size * 16 AS pgoff,
    CASE WHEN p_partkey % 50 = 0 THEN '[' || p_brand || ']' ELSE '/lib/' || p_brand END AS path, p_partkey % 8 AS prot FROM part)"""
KALLSYMS_SQL = "kallsyms AS (SELECT s_suppkey AS seq, 4096 + s_suppkey * 128 AS addr, s_name AS name FROM supplier)"
SWITCHES_SQL = "switches AS (SELECT user_id % 8 AS pid, event_id AS ord, event_id * 10 + CAST(round(value * 100) AS BIGINT) % 7 AS time, event_id % 3 <> 0 AS is_out, 'main;' || event_type AS kstack FROM events)"
LINES_SQL = "lines AS (SELECT event_id, 'main;f' || (user_id % 50) || ';g' || (event_id % 9) || CASE WHEN event_id % 41 = 0 THEN ' x' ELSE ' ' || CAST(round(value * 100) AS BIGINT) END AS line FROM events)"
ENTRIES_SQL = f"""entries AS (
  SELECT event_id AS doc, {_LIST}[1 + event_id % {len(NAMES)}] || CASE WHEN event_id % 4 = 0 THEN '' ELSE '_' || (event_id % 40) END AS name, 1 + event_id % 5000 AS samples,
    CAST((event_id % 10000) // 100 || '.' || lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') AS DOUBLE) AS percent FROM events WHERE NOT (event_id % {len(NAMES)} = 13 AND event_id % 4 = 0))"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = "concat(if(event_id % 5 = 0, array(-128L), cast(array() as array<bigint>)), array(4096 + (user_id % 16) * 16, 8192 + (event_id % 7) * 32, 12288 + (user_id % 3) * 64))"
    return events(spark, sf_dir).filter("event_id % 97 <> 0").selectExpr(
        "'events' as file", "event_id as ord", "cast(null as bigint) as time", "user_id % 8 as pid", "user_id as tid", "cents as period", "cast(event_id % 6 as int) as cpumode", "cast(event_id % 2 as int) as event_index",
        f"{chain} as callchain", "cast(null as bigint) as cookie", "cast(array() as array<bigint>) as unwound", "event_id % 3 = 0 as has_user_stack", "cast(event_id % 4 as int) as user_register_count",
        "if(event_id % 4 > 1, event_id, null) as user_register_ip", "if(event_id % 3 = 0, 64L, 0L) as user_stack_size", "if(event_id % 3 = 0, event_id % 64, 0L) as user_stack_dynamic_size",
    )


def comms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("event_id % 97 = 0").selectExpr("'events' as file", "event_id as ord", "cast(null as bigint) as time", "user_id % 8 as pid", "user_id as tid", "event_type as comm", "event_id % 291 = 0 as is_exec")


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").selectExpr(
        "'events' as file", "p_partkey as ord", "if(p_partkey % 50 = 0, 4294967295L, p_partkey % 8) as pid", "4096 + (p_partkey % 64) * 256 as start", "cast(512 + p_size * 16 as bigint) as len", "cast(p_size * 16 as bigint) as pgoff",
        "if(p_partkey % 50 = 0, concat('[', p_brand, ']'), concat('/lib/', p_brand)) as path", "p_partkey % 8 as prot", "cast(null as string) as build_id",
    )


def kallsyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").selectExpr("s_suppkey as seq", "4096 + s_suppkey * 128 as addr", "s_name as name")


def switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr("user_id % 8 as pid", "event_id as ord", "event_id * 10 + cents % 7 as time", "event_id % 3 <> 0 as out", "concat('main;', event_type) as kstack")


def folded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr("event_id", "concat('main;f', user_id % 50, ';g', event_id % 9, if(event_id % 41 = 0, ' x', concat(' ', cents))) as line")


def flamegraph_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of one title an event."""
    name = "concat(element_at(array(" + ", ".join(f"'{n}'" for n in NAMES) + f"), cast(1 + event_id % {len(NAMES)} as int)), if(event_id % 4 = 0, '', concat('_', event_id % 40)))"
    count = "if(1 + event_id % 5000 >= 1000, concat(floor((1 + event_id % 5000) / 1000), ',', lpad(cast((1 + event_id % 5000) % 1000 as string), 3, '0')), cast(1 + event_id % 5000 as string))"
    percent = "concat(floor((event_id % 10000) / 100), '.', lpad(cast(event_id % 100 as string), 2, '0'))"
    return events(spark, sf_dir).selectExpr("event_id as doc", f"concat('<svg><title>', {name}, ' (', {count}, ' samples, ', {percent}, '%)</title></svg>') as text")
