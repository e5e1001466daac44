"""Named queries over the derived tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.functions import names as N
from stackloom.operators import compare, flamegraph, fold, inlines, objects, offcpu, report, symbols, timeline
from stackloom.operators import mappings as M
from stackloom.plans import views as V
from stackloom.sources import text as T
from stackloom.sources.recording import decode_recordings

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


_S, _C, _M, _K = V.SAMPLES_SQL, V.COMMS_SQL, V.MAPPINGS_SQL, V.KALLSYMS_SQL
_CODE = "list_filter(chain, lambda x: x NOT BETWEEN -4096 AND -1)"
#: Distinct addresses of samples with their best mapping.
_BEST = f"""want AS (SELECT DISTINCT pid, unnest({_CODE}) AS addr FROM samples),
hits AS (SELECT w.pid, w.addr, m.path, m.pid AS map_pid, m.start, m.pgoff, row_number() OVER (PARTITION BY w.pid, w.addr ORDER BY m.start DESC, m.pid = w.pid DESC, m.ord DESC) AS rn
  FROM want w JOIN mappings m ON (m.pid = w.pid OR m.pid = 4294967295) AND w.addr >= m.start AND w.addr < m.start + m.len),
best AS (SELECT pid, addr, path, CASE WHEN path LIKE '[%' AND map_pid = 4294967295 THEN addr ELSE addr - start + pgoff END AS relative FROM hits WHERE rn = 1)"""
_NAMED = """timeline AS (SELECT ord, pid, tid, NULL AS comm, false AS is_exec, 1 AS side FROM samples UNION ALL SELECT ord, pid, tid, comm, is_exec, 0 FROM comms),
running AS (SELECT *, last_value(CASE WHEN is_exec THEN comm END IGNORE NULLS) OVER (PARTITION BY pid ORDER BY ord) AS e,
  last_value(comm IGNORE NULLS) OVER (PARTITION BY pid ORDER BY ord) AS p, last_value(comm IGNORE NULLS) OVER (PARTITION BY tid ORDER BY ord) AS t FROM timeline),
named AS (SELECT s.*, coalesce(e, t, p) AS comm FROM running r JOIN samples s ON r.ord = s.ord WHERE side = 1)"""
_FIRST = "first_event AS (SELECT arg_min(event_index, ord) AS i FROM samples)"
_RAW = f"raw AS (SELECT pid, comm, list_reverse({_CODE}) AS frames, count(*) AS n FROM named WHERE event_index = (SELECT i FROM first_event) GROUP BY ALL)"


@query(f"WITH {_S} SELECT count(*) AS samples, CAST(sum(period) AS BIGINT) AS weight, count(*) FILTER (ord % 3 = 0) AS user_stack_samples, CAST(sum(CASE WHEN ord % 3 = 0 THEN 64 ELSE 0 END) AS BIGINT) AS user_stack_bytes, CAST(sum(CASE WHEN ord % 3 = 0 THEN ord % 64 ELSE 0 END) AS BIGINT) AS user_stack_dynamic_bytes, count(*) FILTER (ord % 4 > 0) AS user_register_samples, count(*) FILTER (ord % 4 > 1) AS user_register_ip_samples FROM samples")
def perf_totals(spark: SparkSession, d: str) -> DataFrame:
    return _long(report.totals(V.samples(spark, d)), "weight", "user_stack_dynamic_bytes")


@query(f"WITH {_S} SELECT CASE cpumode WHEN 1 THEN 'kernel' WHEN 2 THEN 'user' WHEN 3 THEN 'hypervisor' WHEN 4 THEN 'guest-kernel' WHEN 5 THEN 'guest-user' ELSE 'unknown' END AS mode, CAST(cpumode AS INTEGER) AS cpumode, count(*) AS samples, CAST(sum(period) AS BIGINT) AS weight FROM samples GROUP BY cpumode")
def sample_modes(spark: SparkSession, d: str) -> DataFrame:
    return _long(report.sample_modes(V.samples(spark, d)), "weight")


@query(f"WITH {_S}, {_C}, t AS (SELECT tid, count(*) AS samples, CAST(sum(period) AS BIGINT) AS weight FROM samples GROUP BY tid ORDER BY weight DESC, tid LIMIT 30), c AS (SELECT tid, arg_max(comm, ord) AS comm FROM comms GROUP BY tid) SELECT tid, coalesce(comm, 'tid ' || tid) AS comm, samples, weight FROM t LEFT JOIN c USING (tid)")
def threads_topk(spark: SparkSession, d: str) -> DataFrame:
    return _long(report.threads(V.samples(spark, d), V.comms(spark, d)), "weight").drop("file")


@query(f"WITH {_S} SELECT '0x' || lpad(lower(to_hex(ip)), 16, '0') AS ip, count(*) AS samples, CAST(sum(period) AS BIGINT) AS weight FROM (SELECT {_CODE}[1] AS ip, period FROM samples) GROUP BY 1 ORDER BY weight DESC, ip LIMIT 30")
def leaf_ips_topk(spark: SparkSession, d: str) -> DataFrame:
    return _long(report.leaf_ips(V.samples(spark, d)), "weight")


@query(f"WITH {_S}, f AS (SELECT {_CODE} AS f, period FROM samples), e AS (SELECT unnest(range(1, len(f))) AS i, f, period FROM f) SELECT '0x' || lpad(lower(to_hex(f[i + 1])), 16, '0') AS caller, '0x' || lpad(lower(to_hex(f[i])), 16, '0') AS callee, count(*) AS samples, CAST(sum(period) AS BIGINT) AS weight FROM e GROUP BY ALL ORDER BY weight DESC, caller, callee LIMIT 30")
def call_edges_topk(spark: SparkSession, d: str) -> DataFrame:
    return _long(report.call_edges(V.samples(spark, d)), "weight")


@query("SELECT CAST(event_id % 23 AS INTEGER) AS record_type, count(*) AS records FROM events GROUP BY 1")
def record_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.record_counts(V.events(spark, d).select((F.col("event_id") % 23).cast("int").alias("record_type")))


@query("SELECT CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS lost FROM events WHERE event_id % 23 IN (2, 13)")
def lost_sum(spark: SparkSession, d: str) -> DataFrame:
    return _long(report.lost(V.events(spark, d).filter("event_id % 23 in (2, 13)").select(F.col("cents").alias("lost"))), "lost")


@query(f"WITH {_S}, {_C}, {_NAMED} SELECT coalesce(comm, '[unknown]') AS comm, count(*) AS n, CAST(sum(period) AS BIGINT) AS weight FROM named GROUP BY 1")
def comm_asof(spark: SparkSession, d: str) -> DataFrame:
    return timeline.comm_as_of(V.samples(spark, d), V.comms(spark, d)).groupBy(N.comm_label(F.col("comm")).alias("comm")).agg(F.count("*").alias("n"), F.sum("period").alias("weight"))


@query(f"WITH {_S}, {_FIRST} SELECT CAST(event_index AS INTEGER) AS event_index, count(*) AS n FROM samples WHERE event_index = (SELECT i FROM first_event) GROUP BY 1")
def first_event_only(spark: SparkSession, d: str) -> DataFrame:
    return timeline.first_event_only(V.samples(spark, d)).groupBy("event_index").agg(F.count("*").alias("n"))


def _addresses(spark, d):
    return V.samples(spark, d).select("file", "pid", F.explode(fold.code_frames(F.col("callchain"))).alias("addr"))


@query(f"WITH {_S}, {_M}, {_BEST} SELECT pid, addr, path, CAST(relative AS BIGINT) AS relative FROM best")
def mapping_interval(spark: SparkSession, d: str) -> DataFrame:
    return M.resolve(_addresses(spark, d), V.mappings(spark, d)).select("pid", "addr", F.col("map_path").alias("path"), "relative")


@query(f"WITH {_S}, {_M} SELECT pid, count(*) AS n FROM samples s WHERE EXISTS (SELECT 1 FROM mappings m WHERE (m.pid = s.pid OR m.pid = 4294967295) AND (m.prot & 4) <> 0) GROUP BY pid")
def exec_pid_semi(spark: SparkSession, d: str) -> DataFrame:
    return M.with_executable_maps(V.samples(spark, d), V.mappings(spark, d)).groupBy("pid").agg(F.count("*").alias("n"))


@query(f"WITH {_M} SELECT pid, count(*) AS n, CAST(sum(len) AS BIGINT) AS bytes FROM mappings WHERE path NOT LIKE '[%' AND pid <> 4294967295 GROUP BY pid")
def user_mappings(spark: SparkSession, d: str) -> DataFrame:
    return M.user_mappings(V.mappings(spark, d)).groupBy("pid").agg(F.count("*").alias("n"), F.sum("len").alias("bytes"))


def _raw(spark, d, periods=False):
    return fold.raw_stacks(V.samples(spark, d), V.comms(spark, d), count_periods=periods)


@query(f"WITH {_S}, {_C}, {_NAMED}, {_FIRST}, {_RAW} SELECT pid, comm, array_to_string(frames, ',') AS frames, n FROM raw")
def raw_stack_agg(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("pid", "comm", F.array_join(F.transform("frames", lambda x: x["addr"].cast("string")), ",").alias("frames"), F.col("count").alias("n"))


_LABEL = "replace(coalesce(comm, '[unknown]'), ' ', '_')"


@query(f"WITH {_S}, {_C}, {_NAMED}, {_FIRST}, {_RAW} SELECT {_LABEL} || ';' || array_to_string(list_transform(frames, lambda x: '0x' || lower(to_hex(x))), ';') AS stack, CAST(sum(n) AS BIGINT) AS count FROM raw GROUP BY 1")
def fold_plain(spark: SparkSession, d: str) -> DataFrame:
    return fold.folded(_raw(spark, d), V.mappings(spark, d).limit(0))


@query(f"WITH {_S}, {_C}, {_NAMED}, {_FIRST}, {_RAW.replace('count(*)', 'CAST(sum(period) AS BIGINT)')} SELECT {_LABEL} || ';' || array_to_string(list_transform(frames, lambda x: '0x' || lower(to_hex(x))), ';') AS stack, CAST(sum(n) AS BIGINT) AS count FROM raw GROUP BY 1")
def fold_periods(spark: SparkSession, d: str) -> DataFrame:
    return fold.folded(_raw(spark, d, periods=True), V.mappings(spark, d).limit(0))


_FLAT = "flat AS (SELECT row_number() OVER () AS id, * FROM raw), x AS (SELECT id, comm, n, pid, unnest(frames) AS addr, unnest(range(len(frames))) AS i FROM flat)"


@query(f"WITH {_S}, {_C}, {_M}, {_NAMED}, {_FIRST}, {_RAW}, {_BEST}, {_FLAT}, l AS (SELECT id, comm, n, string_agg(CASE WHEN path IS NULL THEN '0x' || lower(to_hex(x.addr)) ELSE path || '+0x' || lower(to_hex(CAST(relative AS BIGINT))) END, ';' ORDER BY i) AS t FROM x LEFT JOIN best b ON b.pid = x.pid AND b.addr = x.addr GROUP BY ALL) SELECT {_LABEL} || ';' || t AS stack, CAST(sum(n) AS BIGINT) AS count FROM l GROUP BY 1")
def fold_mapped(spark: SparkSession, d: str) -> DataFrame:
    return fold.folded(_raw(spark, d), V.mappings(spark, d))


@query(f"WITH {_S}, {_C}, {_M}, {_K}, {_NAMED}, {_FIRST}, {_RAW}, {_BEST}, {_FLAT}, sym AS (SELECT w.pid, w.addr, (SELECT arg_max(k.name, k.addr) FROM kallsyms k WHERE k.addr <= w.addr) AS name FROM want w), l AS (SELECT id, comm, n, string_agg(CASE WHEN b.path IS NULL THEN '[unknown]' WHEN name IS NOT NULL THEN name WHEN b.path LIKE '[%' THEN b.path || '+0x' || lower(to_hex(CAST(relative AS BIGINT))) ELSE '[' || regexp_extract(b.path, '[^/]*$') || ']' END, ';' ORDER BY i) AS t FROM x LEFT JOIN best b ON b.pid = x.pid AND b.addr = x.addr LEFT JOIN sym ON sym.pid = x.pid AND sym.addr = x.addr GROUP BY ALL) SELECT {_LABEL} || ';' || t AS stack, CAST(sum(n) AS BIGINT) AS count FROM l GROUP BY 1")
def fold_symbolized(spark: SparkSession, d: str) -> DataFrame:
    found = symbols.nearest_below(_addresses(spark, d).select("addr"), V.kallsyms(spark, d))
    wanted = _addresses(spark, d).distinct().join(found, "addr").select("file", "pid", "addr", F.when(F.col("name").isNotNull(), F.array("name")).alias("names"))
    return fold.folded(_raw(spark, d), V.mappings(spark, d), wanted)


@query(f"WITH {_S}, s AS (SELECT *, CASE WHEN ord % 4 = 0 THEN tid END AS cookie FROM samples), dd AS (SELECT event_id AS ord, user_id AS cookie, [event_id * 16] AS ips FROM events WHERE event_id % 11 = 0) SELECT s.ord, array_to_string(CASE WHEN cookie IS NULL THEN chain ELSE list_concat(chain, (SELECT arg_min(ips, dd.ord) FROM dd WHERE dd.cookie = s.cookie AND dd.ord > s.ord)) END, ',') AS chain FROM s WHERE cookie IS NULL OR EXISTS (SELECT 1 FROM dd WHERE dd.cookie = s.cookie AND dd.ord > s.ord)")
def deferred_merge(spark: SparkSession, d: str) -> DataFrame:
    s = V.samples(spark, d).withColumn("cookie", F.expr("if(ord % 4 = 0, tid, null)"))
    late = V.events(spark, d).filter("event_id % 11 = 0").selectExpr("'events' as file", "event_id as ord", "cast(null as bigint) as time", "user_id as cookie", "array(event_id * 16) as ips")
    return timeline.merge_deferred(s, late).select("ord", F.array_join(F.col("callchain").cast("array<string>"), ",").alias("chain"))


@query(f"WITH {_K}, a AS (SELECT DISTINCT 2000 + (event_id % 3000) * 16 AS addr FROM events) SELECT addr, (SELECT arg_max(name, k.addr) FROM kallsyms k WHERE k.addr <= a.addr) AS name FROM a")
def kallsyms_asof(spark: SparkSession, d: str) -> DataFrame:
    return symbols.nearest_below(V.events(spark, d).selectExpr("2000 + (event_id % 3000) * 16 as addr"), V.kallsyms(spark, d))


@query(f"WITH {_K}, a AS (SELECT DISTINCT 9000000 + (event_id % 3000) * 16 AS addr FROM events), r AS (SELECT addr AS ref FROM kallsyms WHERE seq = 3) SELECT addr, (SELECT arg_max(name, k.addr) FROM kallsyms k WHERE k.addr <= a.addr + ref - 9000000) AS name FROM a, r")
def kallsyms_relocated(spark: SparkSession, d: str) -> DataFrame:
    known = V.kallsyms(spark, d)
    asked = V.events(spark, d).selectExpr("9000000 + (event_id % 3000) * 16 as addr", "9000000L as recorded")
    reference = known.filter("seq = 3").select(F.col("name").alias("reference"))
    return symbols.relocated_below(asked.distinct().join(F.broadcast(reference)), known).select("addr", "name")


_OBJ = "obj AS (SELECT p_partkey AS seq, p_brand AS object, CASE WHEN p_partkey % 9 = 0 THEN '_' ELSE '' END || p_name AS name, 4096 + (p_partkey % 200) * 64 AS addr, (p_partkey % 4) * 48 AS size, p_partkey % 3 = 0 AS weak, p_partkey % 7 <> 0 AS defined FROM part)"


@query(f"WITH {_OBJ}, a AS (SELECT DISTINCT 'Brand#' || (1 + user_id % 5) || (1 + event_id % 5) AS object, 4096 + (event_id % 3000) * 8 AS addr FROM events), h AS (SELECT a.object, a.addr, o.name, row_number() OVER (PARTITION BY a.object, a.addr ORDER BY o.addr DESC, (o.size > 0) DESC, (NOT weak) DESC, len(regexp_extract(o.name, '^(_*)', 1)), len(o.name) DESC, seq) AS rn FROM a JOIN obj o ON o.object = a.object AND defined AND (CASE WHEN size = 0 THEN o.addr = a.addr ELSE a.addr >= o.addr AND a.addr < o.addr + size END)) SELECT object, addr, name FROM h WHERE rn = 1")
def object_symbol_best(spark: SparkSession, d: str) -> DataFrame:
    obj = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey as seq", "p_brand as object", "concat(if(p_partkey % 9 = 0, '_', ''), p_name) as name", "4096 + (p_partkey % 200) * 64 as addr", "(p_partkey % 4) * 48 as size", "if(p_partkey % 3 = 0, 'weak', 'global') as binding", "'text' as kind", "p_partkey % 7 <> 0 as defined")
    want = V.events(spark, d).selectExpr("concat('Brand#', 1 + user_id % 5, 1 + event_id % 5) as object", "4096 + (event_id % 3000) * 8 as addr")
    return symbols.best_object_symbol(want, obj)


@query(f"WITH {_M}, b AS (SELECT path, arg_max(id, seq) AS id FROM (SELECT '/lib/' || p_brand AS path, 'id' || p_partkey AS id, p_partkey AS seq FROM part WHERE p_partkey % 5 = 0) GROUP BY path) SELECT ord, m.path, id AS build_id FROM mappings m LEFT JOIN b ON b.path = m.path")
def build_id_enrich(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.read.parquet(f"{d}/part.parquet").filter("p_partkey % 5 = 0").selectExpr("'events' as file", "concat('/lib/', p_brand) as path", "concat('id', p_partkey) as build_id", "p_partkey as seq")
    return M.with_build_ids(V.mappings(spark, d), ids).select("ord", "path", "build_id")


@query("WITH o AS (SELECT DISTINCT 'o' || (event_id % 3) AS object, event_id % 900 AS x FROM events) SELECT object, x AS off, CASE WHEN x < 300 THEN 10000 + x WHEN x >= 400 AND x < 700 THEN 50000 + x - 400 END AS address FROM o")
def file_offset_segments(spark: SparkSession, d: str) -> DataFrame:
    want = V.events(spark, d).selectExpr("concat('o', event_id % 3) as object", "event_id % 900 as offset").distinct()
    seg = spark.range(3).selectExpr("concat('o', id) as object", "explode(array(named_struct('seq', 0L, 'file_offset', 0L, 'file_size', 300L, 'addr', 10000L), named_struct('seq', 1L, 'file_offset', 400L, 'file_size', 300L, 'addr', 50000L))) as s").select("object", "s.*")
    return M.file_offset_to_address(want, seg).select("object", F.col("offset").alias("off"), "address")


def _entries(spark, d):
    return T.flamegraph(V.flamegraph_docs(spark, d))


_E = V.ENTRIES_SQL


@query(f"WITH {_E} SELECT doc, name, samples, percent FROM entries")
def fg_parse(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("doc", "name", "samples", "percent")


@query(f"WITH {_E} SELECT name, samples, percent FROM entries WHERE percent >= 1.0 ORDER BY percent DESC, name, doc LIMIT 30")
def fg_top(spark: SparkSession, d: str) -> DataFrame:
    return flamegraph.top(_entries(spark, d)).select("name", "samples", "percent")


@query(f"WITH {_E} SELECT doc, name, samples, percent FROM entries WHERE lower(name) LIKE '%read%'")
def fg_search(spark: SparkSession, d: str) -> DataFrame:
    return flamegraph.search(_entries(spark, d), "READ").select("doc", "name", "samples", "percent")


@query(f"WITH {_E} SELECT doc, substr(name, 11) AS name, samples, percent FROM entries WHERE name LIKE '\\_\\_x64\\_sys\\_%' ESCAPE '\\'")
def fg_syscalls(spark: SparkSession, d: str) -> DataFrame:
    return flamegraph.syscalls(_entries(spark, d)).select("doc", "name", "samples", "percent")


_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(lower(name), '{'|'.join(words)}') THEN '{label}'" for label, words in N.CATEGORIES) + f" WHEN regexp_matches(name, '^({'|'.join(N.SYSCALL_PREFIXES)})') THEN 'Syscall' ELSE 'Other' END"


@query(f"WITH {_E} SELECT {_CATEGORY} AS name, round(sum(percent), 4) AS percent FROM entries GROUP BY 1")
def fg_categories(spark: SparkSession, d: str) -> DataFrame:
    return flamegraph.categories(_entries(spark, d)).withColumn("percent", F.round("percent", 4))


@query(f"WITH {_E}, b AS (SELECT name, samples, percent, row_number() OVER (PARTITION BY name ORDER BY percent, doc DESC) AS rn FROM entries WHERE doc % 2 = 0), a AS (SELECT name, samples, percent, row_number() OVER (PARTITION BY name ORDER BY percent, doc DESC) AS rn FROM entries WHERE doc % 2 = 1), x AS (SELECT * FROM b WHERE rn = 1), y AS (SELECT * FROM a WHERE rn = 1) SELECT coalesce(x.name, y.name) AS name, coalesce(x.samples, 0) AS before_samples, coalesce(x.percent, 0) AS before_percent, coalesce(y.samples, 0) AS after_samples, coalesce(y.percent, 0) AS after_percent, round(coalesce(y.percent, 0) - coalesce(x.percent, 0), 6) AS delta_percent FROM x FULL JOIN y ON x.name = y.name WHERE abs(coalesce(y.percent, 0) - coalesce(x.percent, 0)) >= 0.1")
def fg_diff(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d).withColumn("pos", F.col("doc"))
    out = flamegraph.diff(e.filter("doc % 2 = 0"), e.filter("doc % 2 = 1"), 0.1)
    return out.withColumn("delta_percent", F.round("delta_percent", 6))


_L = V.LINES_SQL
_F = f"{_L}, f AS (SELECT event_id, regexp_extract(line, '^(.*) [0-9]+$', 1) AS stack, CAST(regexp_extract(line, ' ([0-9]+)$', 1) AS BIGINT) AS count FROM lines WHERE regexp_matches(line, '^.* [0-9]+$'))"


@query(f"WITH {_F} SELECT (SELECT count(*) FROM lines) AS folded_lines, (SELECT CAST(sum(strlen(line) + 1) AS BIGINT) FROM lines) AS folded_bytes, CAST(sum(count) AS BIGINT) AS total_count FROM f")
def folded_summary(spark: SparkSession, d: str) -> DataFrame:
    return compare.folded_summary(T.folded(V.folded_lines(spark, d)))


@query(f"WITH {_F} SELECT stack, count FROM f")
def folded_top(spark: SparkSession, d: str) -> DataFrame:
    return compare.folded_top(T.folded(V.folded_lines(spark, d)))


def _sides(spark, d):
    rows = V.folded_lines(spark, d).filter("event_id % 41 <> 0")
    return T.strict_folded(rows.filter("event_id % 2 = 0")), T.strict_folded(rows.filter("event_id % 3 > 0"))


_SIDES = f"{_F}, l AS (SELECT stack, CAST(sum(count) AS BIGINT) AS c FROM f WHERE event_id % 2 = 0 GROUP BY 1), r AS (SELECT stack, CAST(sum(count) AS BIGINT) AS c FROM f WHERE event_id % 3 > 0 GROUP BY 1)"


@query(f"WITH {_SIDES} SELECT coalesce(l.stack, r.stack) AS stack, l.c AS left_count, r.c AS right_count FROM l FULL JOIN r ON l.stack = r.stack WHERE l.c IS DISTINCT FROM r.c")
def folded_compare(spark: SparkSession, d: str) -> DataFrame:
    return compare.compare(*_sides(spark, d))


@query(f"WITH {_SIDES} SELECT l.stack, l.c AS count FROM l LEFT JOIN r ON l.stack = r.stack WHERE l.c <> coalesce(r.c, 0)")
def folded_only_left(spark: SparkSession, d: str) -> DataFrame:
    return compare.only_left(*_sides(spark, d))


_STRACE = f"strace AS (SELECT {V._LIST}[1 + event_id % 5] AS call, CAST('0.' || lpad(CAST(event_id % 1000 AS VARCHAR), 6, '0') AS DOUBLE) AS sec, event_id FROM events WHERE event_id % 13 <> 0)"


def _strace(spark, d):
    call = "element_at(array(" + ", ".join(f"'{n}'" for n in V.NAMES) + "), cast(1 + event_id % 5 as int))"
    return T.strace(V.events(spark, d).selectExpr(f"concat(event_id, ' 12:00:00 ', {call}, '(3, <x>) = 0 ', if(event_id % 13 = 0, '<unfinished>', concat('<0.', lpad(cast(event_id % 1000 as string), 6, '0'), '>'))) as line"))


@query(f"WITH {_STRACE} SELECT count(*) AS total_calls, round(sum(sec), 4) AS total_seconds FROM strace")
def strace_totals(spark: SparkSession, d: str) -> DataFrame:
    return compare.strace_totals(_strace(spark, d)).withColumn("total_seconds", F.round("total_seconds", 4))


@query(f"WITH {_STRACE} SELECT call AS syscall, count(*) AS calls, round(sum(sec), 4) AS total_seconds FROM strace GROUP BY 1")
def strace_summary(spark: SparkSession, d: str) -> DataFrame:
    return compare.strace_by_syscall(_strace(spark, d)).withColumn("total_seconds", F.round("total_seconds", 4))


@query("SELECT event_id AS doc, event_id + 1 AS total_allocations, CASE WHEN event_id % 3 = 0 THEN event_id * 7 END AS peak_heap_bytes FROM events")
def heaptrack_last(spark: SparkSession, d: str) -> DataFrame:
    return T.heaptrack(V.events(spark, d).selectExpr("event_id as doc", "concat('total allocations: 5\\n total allocations: ', event_id + 1, ' calls\\n', if(event_id % 3 = 0, concat('peak heap memory consumption: ', event_id * 7, ' bytes'), 'peak heap: x')) as text"))


@query("SELECT event_id AS doc, event_type AS symbol, CAST(event_id % 50 AS DOUBLE) AS weight FROM events")
def xctrace_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = V.events(spark, d).selectExpr("event_id as doc", "concat('<t><row><symbol>', event_type, '</symbol><weight> ', event_id % 50, '.0 </weight></row><row><symbol>bad</symbol></row></t>') as text")
    return T.xctrace(docs).select("doc", "symbol", "weight")


@query("SELECT event_id AS doc, 'tokio::runtime::park;' || event_type AS stack, event_id + 5 AS count FROM events WHERE event_id % 6 <> 0")
def bpftrace_blocks(spark: SparkSession, d: str) -> DataFrame:
    close = "if(event_id % 6 = 0, '', concat(']: ', event_id + 5, '\\n'))"
    docs = V.events(spark, d).selectExpr("event_id as doc", f"concat('Attaching\\n@offcpu[\\n    7f00 ', event_type, '+12 (app)\\n    7f01 tokio::runtime::park+7 (app)\\n', {close}) as text")
    return T.bpftrace(docs).select("doc", "stack", "count")


@query(f"WITH {V.SWITCHES_SQL}, x AS (SELECT pid, time, is_out, lag(is_out) OVER w AS was, lag(time) OVER w AS start, lag(kstack) OVER w AS stack FROM switches WINDOW w AS (PARTITION BY pid ORDER BY time, ord)) SELECT stack AS kstack, CAST(sum(time - start) AS BIGINT) AS offcpu, count(*) AS switches FROM x WHERE NOT is_out AND was GROUP BY 1")
def offcpu_pairs(spark: SparkSession, d: str) -> DataFrame:
    return offcpu.by_stack(offcpu.pairs(V.switches(spark, d)))


@query(f"WITH {_S}, {_M}, {_BEST} SELECT DISTINCT path, CAST(relative AS BIGINT) AS relative FROM best")
def symbol_request_distinct(spark: SparkSession, d: str) -> DataFrame:
    return symbols.requests(mapping_interval(spark, d), "path", "relative")


@query(f"WITH {_S}, {_M}, {_BEST} SELECT DISTINCT path, CAST(relative AS BIGINT) AS relative FROM best WHERE relative % 3 <> 0")
def symbol_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    wanted = mapping_interval(spark, d)
    return symbols.misses(wanted, wanted.filter("relative % 3 = 0"), "path", "relative")


@query("SELECT event_id, replace(replace(replace(event_type || ';' || event_id || chr(10) || 'x', ';', '\\;'), chr(10), ' '), chr(13), ' ') AS frame FROM events")
def frame_escape(spark: SparkSession, d: str) -> DataFrame:
    return V.events(spark, d).select("event_id", N.escape_frame(F.expr("concat(event_type, ';', event_id, '\\n', 'x')")).alias("frame"))


@query("SELECT event_id, event_type || ';' || 'f' || ';' || 'g_[i]' AS stack FROM events")
def frame_tidy(spark: SparkSession, d: str) -> DataFrame:
    return V.events(spark, d).select("event_id", N.render_tidy_stack(F.expr("array(event_type, 'f(int, <a>)->g')")).alias("stack"))


@query(f"WITH {_S}, {_C}, {_NAMED}, {_FIRST}, {_RAW} SELECT coalesce(comm, '[unknown]') || ' ' || pid || '/' || pid || ' 0: ' || n || ' cycles:' || chr(10) || array_to_string(list_transform(list_reverse(frames), lambda x: chr(9) || lower(to_hex(x)) || ' 0x' || lower(to_hex(x)) || ' ([unknown])' || chr(10)), '') || chr(10) AS text FROM raw")
def script_export(spark: SparkSession, d: str) -> DataFrame:
    from stackloom import sinks

    return sinks.script_stacks(_raw(spark, d), V.mappings(spark, d).limit(0))


@query(f"WITH {_K}, a AS (SELECT DISTINCT 2000 + (event_id % 900) * 16 AS addr FROM events) SELECT addr, CASE WHEN addr % 3 = 0 THEN 'cached' WHEN addr < 9000 THEN (SELECT arg_max(name, k.addr) FROM kallsyms k WHERE k.addr <= a.addr) END AS name FROM a")
def symbol_precedence(spark: SparkSession, d: str) -> DataFrame:
    want = V.events(spark, d).selectExpr("2000 + (event_id % 900) * 16 as addr").distinct()
    cached = want.filter("addr % 3 = 0").withColumn("name", F.lit("cached"))
    return symbols.first_found(want, ["addr"], cached, symbols.nearest_below(want.filter("addr < 9000"), V.kallsyms(spark, d)))


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    """Events as binary recordings (path, content), one for every 200 ids, however many there are."""
    from stackloom.sources import encode

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("event_id")
        out = []
        for r in t.to_pylist():
            if r["event_id"] % 97 == 0:
                out.append(encode.comm(r["user_id"] % 8, r["user_id"], r["event_type"], r["event_id"] % 291 == 0, r["event_id"]))
            else:
                out.append(encode.sample(r["user_id"] % 8, r["user_id"], r["event_id"], r["cents"], [-512, r["user_id"] * 16, -r["event_id"] - 5000], r["event_id"] % 6))
        yield pa.RecordBatch.from_arrays([pa.array([f"r{key[0].as_py()}"]), pa.array([encode.recording(out)], pa.binary())], ["path", "content"])

    rows = V.events(spark, d).select(F.expr("event_id div 200").alias("r"), "event_id", "user_id", "event_type", "cents")
    return rows.groupBy("r").applyInArrow(pack, "path string, content binary")


_RECORDED = "recorded AS (SELECT 'r' || (event_id // 200) AS file, row_number() OVER (PARTITION BY event_id // 200 ORDER BY event_id) - 1 AS ord, * FROM events)"


@query(f"WITH {_RECORDED} SELECT file, ord, event_id AS time, CAST(event_id % 6 AS INTEGER) AS cpumode, user_id % 8 AS pid, user_id AS tid, CAST(round(value * 100) AS BIGINT) AS period, '-512,' || (user_id * 16) || ',' || (-event_id - 5000) AS chain FROM recorded WHERE event_id % 97 <> 0")
def perfdata_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = decode_recordings(_encoded(spark, d), "samples")
    return rows.select("file", "ord", "time", "cpumode", "pid", "tid", "period", F.array_join(F.col("callchain").cast("array<string>"), ",").alias("chain"))


@query(f"WITH {_RECORDED} SELECT file, ord, event_id AS time, user_id % 8 AS pid, user_id AS tid, event_type AS comm, event_id % 291 = 0 AS is_exec FROM recorded WHERE event_id % 97 = 0")
def perfdata_comm(spark: SparkSession, d: str) -> DataFrame:
    return decode_recordings(_encoded(spark, d), "comm")


@query(f"WITH {_RECORDED} SELECT file, CASE WHEN event_id % 97 = 0 THEN 'COMM' ELSE 'SAMPLE' END AS record_name, count(*) AS n, min(event_id) AS first_time, max(event_id) AS last_time FROM recorded GROUP BY ALL")
def perfdata_records(spark: SparkSession, d: str) -> DataFrame:
    return decode_recordings(_encoded(spark, d), "records").groupBy("file", "record_name").agg(F.count("*").alias("n"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


_LISTED = "CASE WHEN s_suppkey % 10 = 0 THEN 0 ELSE 4096 + (s_suppkey // 3) * 64 END"


def _listing(spark, d):
    line = "concat(lower(hex(if(s_suppkey % 10 = 0, 0, 4096 + (s_suppkey div 3) * 64))), if(s_suppkey % 7 = 0, ' t ', ' T '), if(s_suppkey % 3 = 2, '__pi_', ''), s_name, if(s_suppkey % 5 = 0, ' [module]', ''))"
    return T.kallsyms(spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey as seq", f"{line} as line"))


@query(f"SELECT s_suppkey AS seq, {_LISTED} AS addr, CASE WHEN s_suppkey % 3 = 2 THEN '__pi_' ELSE '' END || s_name AS name FROM supplier WHERE s_suppkey % 10 <> 0")
def kallsyms_text(spark: SparkSession, d: str) -> DataFrame:
    return _listing(spark, d).select("seq", "addr", "name")


@query(f"SELECT addr, name FROM (SELECT {_LISTED} AS addr, CASE WHEN s_suppkey % 3 = 2 THEN '__pi_' ELSE '' END || s_name AS name, row_number() OVER (PARTITION BY {_LISTED} ORDER BY s_suppkey % 3 <> 2, s_suppkey) AS rn FROM supplier WHERE s_suppkey % 10 <> 0) WHERE rn = 1")
def kallsyms_aliases(spark: SparkSession, d: str) -> DataFrame:
    return symbols.kallsyms_table(_listing(spark, d)).select("addr", "name")


@query("SELECT count(*) AS rows, CAST(sum(event_id % 50) AS DOUBLE) AS total_weight FROM events")
def xctrace_total(spark: SparkSession, d: str) -> DataFrame:
    docs = V.events(spark, d).selectExpr("event_id as doc", "concat('<t><row><symbol>', event_type, '</symbol><weight> ', event_id % 50, '.0 </weight></row></t>') as text")
    return compare.weight_totals(T.xctrace(docs))


_KINDS = ("'a::Vec<b::T' || event_id || '>::push'", "'a::Vec<u' || event_id || '>::push'", "'<a::B as c::D>::run' || event_id", "'std::vector<int>::at' || event_id", "'std::io::read' || event_id", "'plain' || event_id", "'a::map<k, v>::get<x' || event_id || '>'")
_SYMBOLS = ("'push<b::T' || event_id || '>'", _KINDS[1], _KINDS[2], _KINDS[3], _KINDS[4], _KINDS[5], "'get<x' || event_id || '><k, v>'")
_DEBUG = ("'push<b::T' || event_id || '>'", "'push'", "'run' || event_id", _KINDS[3], _KINDS[4], _KINDS[5], "'get<x' || event_id || '>'")


def _by_kind(values: tuple[str, ...]) -> str:
    return "CASE event_id % 7 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


@query(f"SELECT event_id, {_by_kind(_SYMBOLS)} AS symbol, {_by_kind(_DEBUG)} AS debug FROM events")
def symbol_names(spark: SparkSession, d: str) -> DataFrame:
    rows = V.events(spark, d).selectExpr("event_id", f"{_by_kind(_KINDS)} as name")
    return rows.select("event_id", N.normal_symbol_name("name").alias("symbol"), N.normal_debug_name("name").alias("debug"))


_MODULES = "CASE user_id % 4 WHEN 0 THEN '[kernel.kallsyms]' WHEN 1 THEN '[module]' WHEN 2 THEN '/bin/app' ELSE '[kernel.kallsyms]' END"
_PLACES = f"p AS (SELECT DISTINCT {_MODULES} AS path, 4096 + (event_id % 3000) * 16 AS addr FROM events)"


@query(f"WITH {_K}, {_PLACES}, o AS (SELECT DISTINCT path, addr, CASE WHEN addr % 9 <> 0 THEN path || addr END AS object FROM p WHERE addr % 3 = 0), c AS (SELECT addr, name FROM kallsyms WHERE seq % 2 = 0), l AS (SELECT addr, name || '_live' AS name FROM kallsyms) SELECT p.path, p.addr, CASE WHEN p.path = '/bin/app' THEN object WHEN p.path = '[module]' AND o.path IS NOT NULL THEN object WHEN p.path = '[module]' THEN coalesce((SELECT arg_max(name, l.addr) FROM l WHERE l.addr <= p.addr), (SELECT arg_max(name, c.addr) FROM c WHERE c.addr <= p.addr)) ELSE coalesce((SELECT arg_max(name, c.addr) FROM c WHERE c.addr <= p.addr), (SELECT arg_max(name, l.addr) FROM l WHERE l.addr <= p.addr)) END AS name FROM p LEFT JOIN o ON o.path = p.path AND o.addr = p.addr")
def symbol_sources(spark: SparkSession, d: str) -> DataFrame:
    asked = V.events(spark, d).selectExpr(f"{_MODULES} as path", "4096 + (event_id % 3000) * 16 as addr", "cast(null as string) as reference", "cast(null as bigint) as recorded").distinct()
    # an object that was found and names nothing ends the search
    objects = asked.filter("addr % 3 = 0").selectExpr("path", "addr", "if(addr % 9 <> 0, concat(path, addr), null) as name")
    known = V.kallsyms(spark, d)
    return symbols.precedence(asked, objects, cached=known.filter("seq % 2 = 0"), live=known.withColumn("name", F.concat("name", F.lit("_live")))).select("path", "addr", "name")


# functions with two nested inlined calls, the first of which has a split range, and a call beside them; each stands for a part
_FUNCTIONS = """fn AS (SELECT '/lib/' || p_brand AS object, p_partkey AS k, p_partkey * 4096 AS base, p_name AS name FROM part)"""
_INLINE_ASKED = "asked AS (SELECT DISTINCT object, base + (event_id * 37) % 1100 AS addr, CASE event_id % 3 WHEN 0 THEN name WHEN 1 THEN 'alias' END AS base_name, k, (event_id * 37) % 1100 AS place, name FROM events JOIN fn ON k = 1 + event_id % 500)"


@query(f"""WITH {_FUNCTIONS}, {_INLINE_ASKED}, chains AS (
  SELECT *, list_concat([name], CASE WHEN place >= 128 AND place < 256 OR place >= 384 AND place < 640 THEN list_concat(['middle' || k % 7], CASE WHEN place >= 400 AND place < 450 THEN ['inner'] ELSE [] END)
    WHEN place >= 640 AND place < 700 THEN ['inner'] ELSE [] END) AS chain FROM asked WHERE place < 1024)
SELECT object, addr, base_name AS base, CASE WHEN len(chain) > 1 OR name <> base_name THEN array_to_string(chain, ';') END AS names, array_to_string(chain, ';') AS linked FROM chains""")  # fmt: skip
def inline_frames(spark: SparkSession, d: str) -> DataFrame:
    fn = V.parts(spark, d).selectExpr("concat('/lib/', p_brand) as object", "p_partkey as k", "p_partkey * 4096 as base", "p_name as name")
    # parts pack so well in their file that they would be broadcast, however many they are
    places = V.events(spark, d).selectExpr("1 + event_id % 500 as of", "(event_id * 37) % 1100 as place", "event_id % 3 as kind").distinct()
    asked = places.join(fn.hint("merge"), F.expr("k = of")).selectExpr("object", "base + place as addr", "case kind when 0 then name when 1 then 'alias' end as base")
    rows = "inline(array(" + ", ".join(
        f"struct(k % 3L as unit, k * 100 + {die}L as die, k * 100 + {until}L as until, {depth} as depth, {inlined} as inlined, base + {low} as low, base + {high} as high, {name} as name)"
        for die, until, depth, inlined, low, high, name in [
            (0, 90, 0, "false", 0, 1024, "name"), (10, 40, 1, "true", 128, 256, "concat('middle', k % 7)"), (10, 40, 1, "true", 384, 640, "concat('middle', k % 7)"), (20, 30, 2, "true", 400, 450, "'inner'"),
            (45, 47, 1, "true", 200, 300, "cast(null as string)"), (50, 60, 1, "true", 640, 700, "'inner'"), (70, 80, 1, "false", 500, 600, "'nested'"),
        ]
    ) + "))"
    functions = fn.select("object", "k", "base", F.col("name")).selectExpr("object", rows).withColumn("linkage", F.lit(None).cast("string"))
    out = inlines.inline_chains(asked, functions)
    return out.select("object", "addr", "base", F.array_join("names", ";").alias("names"), F.array_join("linked", ";").alias("linked"))


@query(f"WITH {_FUNCTIONS}, {_INLINE_ASKED} SELECT DISTINCT object, k % 3 + 3 * (k // 30) AS unit FROM asked WHERE place < 1000")
def debug_units_asked(spark: SparkSession, d: str) -> DataFrame:
    fn = V.parts(spark, d).selectExpr("concat('/lib/', p_brand) as object", "p_partkey as k", "p_partkey * 4096 as base")
    asked = V.events(spark, d).join(fn, F.expr("k = 1 + event_id % 500")).selectExpr("object", "base + (event_id * 37) % 1100 as at")
    return objects.units_asked(asked, fn.selectExpr("object", "k % 3 + 3 * (k div 30) as unit", "base as low", "base + 1000 as high"))


_HASH = "'17h' || lpad(CAST(event_id AS STRING), 16, '0') || 'E'"
_MANGLED = ("'_ZN3app4Pool3runEi'", "'_ZNK3app3BoxIiE3getERKSt6vectorIiSaIiEE'", f"'_ZN3foo3bar' || {_HASH}", "'_RNvNtCs1234_7mycrate3foo3bar'", "'main' || event_id", "'_Z1fPFvicE.cold'", f"'_ZN4core3ptr22drop_in_place$LT$S$GT$' || {_HASH}")
_READABLE = ("'app::Pool::run(int)'", "'app::Box<int>::get(std::vector<int, std::allocator<int> > const&) const'", "'foo::bar'", "'mycrate::foo::bar'", "'main' || event_id", "'f(void (*)(int, char)) [clone .cold]'", "'core::ptr::drop_in_place<S>'")


@query(f"SELECT event_id, {_by_kind(_READABLE)} AS name FROM events")
def demangled_names(spark: SparkSession, d: str) -> DataFrame:
    rows = V.events(spark, d).selectExpr("event_id", f"{_by_kind(_MANGLED)} as name")
    return rows.select("event_id", N.readable_name(F.col("name")).alias("name"))


@query("""WITH s AS (SELECT '/lib/' || p_brand AS object, p_partkey AS k, p_partkey * 64 AS addr, p_name AS name FROM part),
a AS (SELECT DISTINCT object, 100 + (event_id * 31) % 130000 AS addr FROM events JOIN s ON k = 1 + event_id % 500)
SELECT a.object, a.addr, (SELECT arg_max(name, s.addr) FROM s WHERE s.object = a.object AND s.addr <= a.addr AND k % 3 > 0) AS name FROM a""")
def object_symbol_below(spark: SparkSession, d: str) -> DataFrame:
    every = V.parts(spark, d).selectExpr("concat('/lib/', p_brand) as object", "p_partkey as seq", "p_partkey * 64 as addr", "p_name as name", "true as defined", "'text' as kind", "0L as size")
    asked = V.events(spark, d).join(every.select("object", "seq"), F.expr("seq = 1 + event_id % 500")).selectExpr("object", "100 + (event_id * 31) % 130000 as addr")
    return symbols.last_below(asked, every.filter("seq % 3 > 0"))


def _every_type(spark: SparkSession, d: str) -> DataFrame:
    """Events as recordings (path, content) of all record types, one for every 220 ids, with two events and a build id."""
    from stackloom.sources import encode as E

    def record(n: int, u: int, kind: str) -> bytes:
        pid, t = u % 8, n + 5
        o = lambda k, form="", *x, text=None, misc=0: E.other(k, pid, u, t, misc, form, *x, text=text)
        return {
            1: lambda: o(1, "IIQQQ", pid, u, n * 4096, 4096, n, text=f"/lib/{kind}"), 2: lambda: o(2, "QQ", n, n % 7), 3: lambda: E.comm(pid, u, kind, n % 3 == 0, t),
            4: lambda: o(4, "IIIIQ", pid, 1, u, 2, t), 5: lambda: o(5, "QQQ", t, n, 9), 6: lambda: o(6, "QQQ", t, n, 9), 7: lambda: o(7, "IIIIQ", pid, 1, u, 2, t), 8: lambda: o(8, "II", pid, u),
            9: lambda: E.sample(pid, u, t, n, [-512, n]), 10: lambda: o(10, "IIQQQIIQQII", pid, u, n * 4096, 4096, n, 8, 1, n, 3, 5, 2, text=f"/bin/{kind}") if n % 44 < 22 else o(10, "IIQQQBBHQQIII", pid, u, n * 4096, 4096, n, 8, 0, 0, n, 0, 0, 5, 2, text=f"/bin/{kind}", misc=1 << 14),
            11: lambda: o(11, "QQQ", n, 8, 1), 12: lambda: o(12, "II", pid, u), 13: lambda: o(13, "Q", n % 5), 14: lambda: o(14), 15: lambda: o(15, "II", pid, u), 16: lambda: o(16, "IIQQQ", pid, u, 1, 4, n),
            17: lambda: o(17, "QIHH", n, 64, 1, 0, text=kind), 18: lambda: o(18, "HHIQ", 1, 0, n, 0), 19: lambda: o(19, "Q", n, text=f"/{kind}"), 20: lambda: o(20, "QHHBBB", n, 1, 2, 1, 2, 3),
            21: lambda: o(21, "Q", n), 22: lambda: o(22, "QQQQ", n, 2, n + 1, n + 2),
        }[1 + n % 22]()

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["event_id"])
        k = key[0].as_py()
        content = E.recording([record(r["event_id"], r["user_id"], r["event_type"]) for r in rows], ((k, k + 1), (k + 2,)), E.build_id(1, k.to_bytes(20, "little"), f"/lib/{k}"))
        yield pa.RecordBatch.from_arrays([pa.array([f"m{k}"]), pa.array([content], pa.binary())], ["path", "content"])

    rows = V.events(spark, d).select(F.expr("event_id div 220").alias("r"), "event_id", "user_id", "event_type")
    return rows.groupBy("r").applyInArrow(pack, "path string, content binary")


_TYPED = "typed AS (SELECT 'm' || (event_id // 220) AS file, row_number() OVER (PARTITION BY event_id // 220 ORDER BY event_id) - 1 AS ord, event_id AS n, user_id AS u, user_id % 8 AS pid, 1 + event_id % 22 AS kind, event_type, event_id + 5 AS time FROM events)"
_BY_TYPE = {
    1: """'{"pid": ' || pid || ', "tid": ' || u || ', "start": ' || n * 4096 || ', "len": 4096, "pgoff": ' || n || ', "path": "/lib/' || event_type || '"}'""",
    2: """'{"id": ' || n || ', "lost": ' || n % 7 || '}'""",
    3: """'{"pid": ' || pid || ', "tid": ' || u || ', "comm": "' || event_type || '", "is_exec": ' || (n % 3 = 0) || '}'""",
    4: """'{"pid": ' || pid || ', "ppid": 1, "tid": ' || u || ', "ptid": 2, "time": ' || time || '}'""",
    5: """'{"time": ' || time || ', "id": ' || n || ', "stream_id": 9}'""",
    10: """'{"pid": ' || pid || ', "tid": ' || u || ', "start": ' || n * 4096 || ', "len": 4096, "pgoff": ' || n || CASE WHEN n % 44 < 22 THEN ', "major": 8, "minor": 1, "inode": ' || n || ', "generation": 3' ELSE ', "build_id": "' || hex8 || '"' END || ', "prot": 5, "flags": 2, "path": "/bin/' || event_type || '"}'""",
    11: """'{"aux_offset": ' || n || ', "aux_size": 8, "flags": 1}'""",
    12: """'{"pid": ' || pid || ', "tid": ' || u || '}'""",
    13: """'{"lost": ' || n % 5 || '}'""",
    14: "'{}'",
    16: """'{"pid": ' || pid || ', "tid": ' || u || ', "links": [[4, ' || n || ']]}'""",
    17: """'{"addr": ' || n || ', "len": 64, "ksym_type": 1, "flags": 0, "name": "' || event_type || '"}'""",
    18: """'{"bpf_type": 1, "flags": 0, "id": ' || n || ', "tag": "0000000000000000"}'""",
    19: """'{"id": ' || n || ', "path": "/' || event_type || '"}'""",
    20: """'{"addr": ' || n || ', "old_len": 1, "new_len": 2, "old_bytes": "01", "new_bytes": "0203"}'""",
    21: """'{"hw_id": ' || n || '}'""",
    22: """'{"cookie": ' || n || ', "ips": [' || n + 1 || ', ' || n + 2 || ']}'""",
}
_BY_TYPE |= {6: _BY_TYPE[5], 7: _BY_TYPE[4], 15: _BY_TYPE[12]}
#: Eight bytes of a number, the lowest first, as hexadecimal digits.
_HEX8 = "lower(" + " || ".join(f"lpad(to_hex((n >> {8 * k}) & 255), 2, '0')" for k in range(8)) + ") AS hex8"


@query(f"WITH {_TYPED} SELECT file, ord, time, kind::INTEGER AS record_type, CASE kind {' '.join(f'WHEN {k} THEN {v}' for k, v in sorted(_BY_TYPE.items()))} END AS fields FROM (SELECT *, {_HEX8} FROM typed) WHERE kind NOT IN (8, 9)")
def perfdata_details(spark: SparkSession, d: str) -> DataFrame:
    return decode_recordings(_every_type(spark, d), "details").filter("record_type <> 8").select("file", "ord", "time", "record_type", "fields")


@query(f"WITH {_TYPED} SELECT file, ord, time, pid, n * 4096 AS start, 4096::BIGINT AS len, n AS pgoff, CASE kind WHEN 1 THEN '/lib/' ELSE '/bin/' END || event_type AS path, CASE WHEN kind = 10 THEN 5::BIGINT END AS prot, CASE WHEN kind = 10 AND n % 44 >= 22 THEN hex8 END AS build_id, CASE WHEN kind = 10 AND n % 44 < 22 THEN n END AS inode FROM (SELECT *, {_HEX8} FROM typed) WHERE kind IN (1, 10)")
def perfdata_mappings(spark: SparkSession, d: str) -> DataFrame:
    return decode_recordings(_every_type(spark, d), "mappings").select("file", "ord", "time", "pid", "start", "len", "pgoff", "path", "prot", "build_id", "inode")


@query(f"WITH {_TYPED} SELECT file, count(*) AS records, CAST(sum(CASE kind WHEN 2 THEN n % 7 ELSE n % 5 END) AS BIGINT) AS lost FROM typed WHERE kind IN (2, 13) GROUP BY file")
def perfdata_lost(spark: SparkSession, d: str) -> DataFrame:
    return decode_recordings(_every_type(spark, d), "lost").groupBy("file").agg(F.count("*").alias("records"), F.sum("lost").alias("lost"))


@query(f"WITH {_TYPED} SELECT file, ord, time, n AS cookie, (n + 1) || ',' || (n + 2) AS ips FROM typed WHERE kind = 22")
def perfdata_deferred(spark: SparkSession, d: str) -> DataFrame:
    return decode_recordings(_every_type(spark, d), "deferred").select("file", "ord", "time", "cookie", F.array_join(F.col("ips").cast("array<string>"), ",").alias("ips"))


@query("SELECT 'm' || k AS file, 0::BIGINT AS seq, 1::BIGINT AS pid, lower(lpad(to_hex(k & 255), 2, '0') || lpad(to_hex((k >> 8) & 255), 2, '0') || lpad(to_hex((k >> 16) & 255), 2, '0') || repeat('0', 34)) AS build_id, '/lib/' || k AS path FROM (SELECT DISTINCT event_id // 220 AS k FROM events)")
def perfdata_build_ids(spark: SparkSession, d: str) -> DataFrame:
    return decode_recordings(_every_type(spark, d), "build_ids")


@query("SELECT 'm' || k AS file, i::INTEGER AS event_index, 294::BIGINT AS sample_type, true AS sample_id_all, CASE i WHEN 0 THEN k || ',' || (k + 1) ELSE '' || (k + 2) END AS ids FROM (SELECT DISTINCT event_id // 220 AS k FROM events), range(2) t(i)")
def perfdata_attrs(spark: SparkSession, d: str) -> DataFrame:
    return decode_recordings(_every_type(spark, d), "attrs").select("file", "event_index", "sample_type", "sample_id_all", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


_PATH = "CASE event_id % 5 WHEN 0 THEN '[kernel.kallsyms]_text' WHEN 1 THEN '[kernel.kallsyms]' WHEN 2 THEN '[guest.kernel]' WHEN 3 THEN '[vdso]' ELSE '/bin/x' END"
_RELATIVE = "CASE WHEN event_id % 2 = 0 THEN -2130706432 + event_id ELSE event_id END"


@query(f"""WITH r AS (SELECT event_id, {_PATH} AS path, {_RELATIVE} AS relative FROM events)
SELECT event_id, CASE WHEN starts_with(path, '[kernel') AND relative BETWEEN -140737488355328 AND -4097 THEN '[kernel.kallsyms]' ELSE path END AS request, CASE WHEN event_id % 5 = 0 THEN '_text' END AS reference, CASE WHEN event_id % 5 = 0 THEN event_id END AS recorded FROM r""")
def kernel_requests(spark: SparkSession, d: str) -> DataFrame:
    rows = V.events(spark, d).selectExpr("event_id", f"{_PATH} as path", f"cast({_RELATIVE} as long) as relative")
    moved = M.kernel_relocation(F.col("path"), F.col("event_id"))
    return rows.select("event_id", M.request_path(F.col("path"), F.col("relative")).alias("request"), moved["reference"].alias("reference"), moved["recorded"].alias("recorded"))


@query("SELECT DISTINCT p_partkey // 3 AS pid FROM part WHERE p_partkey % 8 IN (4, 5, 6, 7) AND p_partkey % 11 <> 0")
def executable_pids(spark: SparkSession, d: str) -> DataFrame:
    maps = V.mappings(spark, d).selectExpr("file", "ord div 3 as pid", "prot", "if(ord % 11 = 0, '/x/perf.data.old', path) as path")
    return M.executable_pids(maps).select("pid")


@query(f"""WITH {_M}, m AS (SELECT * REPLACE (CASE WHEN ord % 3 = 0 THEN '[heap]' ELSE path END AS path) FROM mappings), e AS (SELECT event_id AS id, user_id % 8 AS pid, 4096 + (event_id % 700) * 32 AS addr FROM events),
best AS (SELECT e.id, e.addr, m.path FROM e JOIN m ON (m.pid = e.pid OR m.pid = 4294967295) AND m.ord < e.id AND e.addr >= m.start AND e.addr < m.start + m.len QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY m.start DESC, m.pid = e.pid DESC, m.ord DESC) = 1)
SELECT id, addr FROM best WHERE path = '[heap]'""")
def unwound_noise(spark: SparkSession, d: str) -> DataFrame:
    maps = V.mappings(spark, d).withColumn("time", F.lit(None).cast("long")).withColumn("path", F.expr("if(ord % 3 = 0, '[heap]', path)"))
    frames = V.events(spark, d).selectExpr("'events' as file", "user_id % 8 as pid", "4096 + (event_id % 700) * 32 as addr", "event_id as id", "cast(null as bigint) as time", "event_id as ord")
    return M.noise_as_of(frames.select("file", "pid", "addr", "id", F.struct(*timeline.replay_order()).alias("at")), maps).select("id", "addr")


@query(f"WITH {V.LINES_SQL}, f AS (SELECT regexp_extract(line, '^(.*) ', 1) AS stack, try_cast(regexp_extract(line, ' ([^ ]*)$', 1) AS BIGINT) AS n FROM lines) SELECT stack || ' ' || CAST(sum(n) AS BIGINT) AS value FROM f WHERE n IS NOT NULL GROUP BY stack")
def folded_file(spark: SparkSession, d: str) -> DataFrame:
    from stackloom import sinks

    rows = T.folded(V.folded_lines(spark, d)).filter("count is not null")
    return sinks.folded_lines(rows.groupBy("stack").agg(F.sum("count").alias("count")))


def _objects(spark: SparkSession, d: str) -> DataFrame:
    """Parts as ELF objects (path, content), one for every 50 of them: a symbol a part, a segment for every tenth."""
    from stackloom.sources import encode as E

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["k"])
        symbols = [(r["name"], (r["k"] % 3) << 4 | r["k"] % 5, r["k"] % 4, r["k"] * 64 if r["k"] % 9 else -r["k"] * 4096, r["size"]) for r in rows]
        loads = [(r["k"] * 4096, 4096 + r["size"], r["k"] * 8192) for r in rows if r["k"] % 10 == 0]
        yield pa.RecordBatch.from_arrays([pa.array([f"o{key[0].as_py()}"]), pa.array([E.elf_object(symbols, loads)], pa.binary())], ["path", "content"])

    rows = V.parts(spark, d).selectExpr("p_partkey div 50 as o", "p_partkey as k", "p_name as name", "cast(p_size as long) as size")
    return rows.groupBy("o").applyInArrow(pack, "path string, content binary")


@query("""SELECT 'o' || (p_partkey // 50) AS object, row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) - 1 AS seq, p_name AS name, CASE p_partkey % 5 WHEN 0 THEN 'label' WHEN 1 THEN 'data' WHEN 2 THEN 'text' WHEN 3 THEN 'section' ELSE 'file' END AS kind,
CASE p_partkey % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'global' ELSE 'weak' END AS binding, p_partkey % 4 <> 0 AS defined, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey * 64 ELSE -p_partkey * 4096 END AS addr, p_size::BIGINT AS size FROM part""")
def elf_symbols(spark: SparkSession, d: str) -> DataFrame:
    from stackloom.sources import elf

    return elf.decode_symbols(_objects(spark, d))


@query("SELECT 'o' || (p_partkey // 50) AS object, row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) - 1 AS seq, p_partkey * 4096 AS file_offset, 4096 + p_size::BIGINT AS file_size, p_partkey * 8192 AS addr FROM part WHERE p_partkey % 10 = 0")
def elf_segments(spark: SparkSession, d: str) -> DataFrame:
    from stackloom.sources import elf

    return elf.decode_segments(_objects(spark, d))
