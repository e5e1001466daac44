"""Command line: `python -m stackloom.cli plumbing ...` over recordings and text profiles."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stackloom import sinks
from stackloom.operators import compare, flamegraph, fold, objects, report, symbols
from stackloom.operators import mappings as M
from stackloom.operators.unwind import unwound_stacks
from stackloom.sources import host
from stackloom.sources import text as T
from stackloom.sources.decode import BIT
from stackloom.sources.recording import SPLIT_BYTES, read_ranges, read_recording, recording_ranges


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stackloom")
    plumbing = p.add_subparsers(dest="area", required=True).add_parser("plumbing").add_subparsers(dest="verb", required=True)
    for verb in ("fold", "flamegraph"):
        f = plumbing.add_parser(verb)
        f.add_argument("recording")
        f.add_argument("--count-periods", action="store_true")
        f.add_argument("--symbols", help="the recorded kernel's symbol listing, asked first")
        f.add_argument("--system-map", help="a system map, asked next")
        f.add_argument("--live-symbols", help="the running kernel's listing, asked last, and first for modules")
        f.add_argument("--host-symbols", action="store_true", help="take this host's system map and live listing where none is given")
        f.add_argument("--objects", action="store_true", help="name frames of objects by their symbol tables")
        f.add_argument("--output", help="a folder to which tasks write the lines, instead of standard output")
        f.add_argument("--debug-dir", default=host.debug_dir(os.environ.get("HOME", "")), help="where objects are kept by build id")
    s = plumbing.add_parser("summarize")
    s.add_argument("folder")
    s.add_argument("--json", action="store_true")
    parse = plumbing.add_parser("parse").add_subparsers(dest="kind", required=True)
    r = parse.add_parser("perf").add_subparsers(dest="mode", required=True).add_parser("summary")
    r.add_argument("recording")
    r.add_argument("--limit", type=int, default=30)
    r.add_argument("--json", action="store_true")
    modes = parse.add_parser("flamegraph").add_subparsers(dest="mode", required=True)
    for mode in ("top", "search", "syscalls", "summary", "diff"):
        m = modes.add_parser(mode)
        m.add_argument("svg")
        if mode == "search":
            m.add_argument("pattern")
        if mode == "diff":
            m.add_argument("after")
        m.add_argument("--limit", type=int, default=30)
        m.add_argument("--min-percent", type=float, default=1.0 if mode != "diff" else 0.0)
        m.add_argument("--json", action="store_true")
    for kind in ("strace", "heaptrack", "xctrace", "offcpu"):
        k = parse.add_parser(kind)
        k.add_argument("path")
        k.add_argument("--json", action="store_true")
    return p


def listing(spark: SparkSession, path: str):
    """A kernel symbol listing (seq, addr, name); ties go by its lines' order.  The path is no pattern, brackets in it stand for themselves."""
    path = re.sub(r"([][*?{}\\])", r"\\\1", path)
    return T.kallsyms(T.read_lines(spark, path).withColumn("seq", F.monotonically_increasing_id()))


def named_addresses(stacks, maps, listings: dict, debug_dir: str | None = None):
    """(file, pid, addr, names) of the frames that a kernel listing or, with a debug_dir, an object names.

    listings: cached, system_map, live.  Where an object's file was found, its table alone is asked.
    """
    flat = stacks.select("file", "pid", F.explode("frames.addr").alias("addr")).distinct()
    found = M.resolve(flat, maps)
    path, relative = F.col("map_path"), F.col("relative")
    moved = M.kernel_relocation(path, F.col("pgoff"))
    asked = found.filter(M.symbolizes(F.col("addr"), path, relative))
    wanted = F.struct(M.request_path(path, relative).alias("path"), relative.alias("addr"), moved["reference"].alias("reference"), moved["recorded"].alias("recorded"), "build_id", *M.IDENTITY)
    asked = asked.select("file", "pid", F.col("addr").alias("frame"), wanted.alias("w")).select("file", "pid", "frame", "w.*")
    if debug_dir is not None:
        # the lookup reads these rows, which are distinct addresses, several times
        asked = cut(asked)
    none = asked.select("path", "addr", F.lit(None).cast("string").alias("name")).limit(0)
    known = symbols.precedence(asked, none, **listings)
    out = _known(asked, known, ["path", "addr", "reference", "recorded"], "name", "listed")
    listed = F.when(F.col("listed").isNotNull(), F.array("listed"))
    if debug_dir is None:
        out = out.withColumn("names", listed)
    else:
        own = objects.names(asked, debug_dir, cut).withColumn("has_object", F.lit(True))
        out = _known(out, own, [*objects.KEYS, "addr"], "names", "own").withColumn("names", F.when(F.col("has_object"), F.col("own")).otherwise(listed))
    return out.filter("names is not null").select("file", "pid", F.col("frame").alias("addr"), "names")


def cut(df):
    """df without its lineage, by the shared checkpoint folder; where none is set, kept by the executors."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def _known(rows, table, keys: list[str], column: str, name: str):
    """rows with table's other columns by keys, of which any may be null (as a struct they compare like values); `column` is called `name` there."""
    others = [c for c in table.columns if c not in (*keys, column)]
    right = table.select(F.struct(*keys).alias("k"), F.col(column).alias(name), *others)
    return rows.join(right, F.struct(*keys) == F.col("k"), "left").drop("k")


def own_listing(build_ids, folder: str | None) -> str | None:
    """The cached listing of the kernel that was recorded, by the build id in the recordings' headers; None if they name several."""
    if folder is None:
        return None
    found = [r["build_id"] for r in M.kernel_build_id(build_ids).select("build_id").distinct().limit(2).collect()]
    return host.first_listing(host.cached_kallsyms(folder, found[0])) if len(found) == 1 else None


def captures_stacks(spark: SparkSession, path: str) -> bool:
    """Whether any event of the recordings has user registers and stacks in its samples; their heads alone are read."""
    wanted = BIT["REGS_USER"] | BIT["STACK_USER"]
    attrs = read_recording(spark, path, "attrs", columns=["sample_type"])
    return bool(attrs.filter(F.col("sample_type").bitwiseAND(wanted) == wanted).limit(1).collect())


#: What a fold needs of a sample; captured stacks are a table of their own.
SAMPLE_COLUMNS = ("file", "ord", "time", "event_index", "pid", "tid", "period", "callchain", "cookie")


def fold_recording(spark, path: str, count_periods: bool = False, kallsyms: str | None = None, system_map: str | None = None, live: str | None = None, debug_dir: str | None = None, split_bytes: int = SPLIT_BYTES, cache: str | None = None):
    """Folded stacks; kernel frames are named by the listings given, those of objects where a debug_dir is given.

    Captured user stacks are unwound by the call frame information of the objects
    that are found, in `cache` (debug_dir where that is unset) or where they were recorded.
    Without kallsyms the listing that the cache has for the recorded kernel is taken.
    """
    ranges = cut(recording_ranges(spark, path, split_bytes))
    tables = {t: read_ranges(ranges, t, SAMPLE_COLUMNS if t == "samples" else None) for t in ("samples", "comm", "mappings", "deferred", "stacks")}
    build_ids = read_recording(spark, path, "build_ids")
    maps = cut(M.with_build_ids(tables["mappings"], build_ids))
    samples = tables["samples"]
    # only events that capture stacks need the samples to meet what is unwound
    if captures_stacks(spark, path):
        samples = samples.join(unwound_stacks(tables["stacks"], maps, cache or debug_dir), ["file", "ord"], "left")
    # both are read several times below, and are small against the samples
    stacks = cut(fold.raw_stacks(samples, tables["comm"], tables["deferred"], count_periods, maps))
    kallsyms = kallsyms or own_listing(build_ids, cache or debug_dir)
    listings = {k: listing(spark, x) for k, x in (("cached", kallsyms), ("system_map", system_map), ("live", live)) if x}
    named = named_addresses(stacks, maps, listings, debug_dir) if listings or debug_dir is not None else None
    return fold.folded(stacks, maps, named)


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _show(rows: list[dict], as_json: bool) -> str:
    if as_json:
        return json.dumps(rows, default=str, indent=2) + "\n"
    return "".join("\t".join(str(v) for v in r.values()) + "\n" for r in rows)


def run(spark: SparkSession, argv: list[str]) -> str:
    a = parser().parse_args(argv)
    if a.verb in ("fold", "flamegraph"):
        # drawing is an external renderer's part: a flamegraph's lines are its input, weighted by period
        periods = a.verb == "flamegraph" or a.count_periods
        system_map = a.system_map or (host.first_listing(host.current_system_maps()) if a.host_symbols else None)
        live = a.live_symbols or (host.first_listing(["/proc/kallsyms"]) if a.host_symbols else None)
        stacks = fold_recording(spark, a.recording, periods, a.symbols, system_map, live, a.debug_dir if a.objects else None, cache=a.debug_dir)
        if a.output:
            sinks.write_folded(stacks, a.output)
            return ""
        lines = sinks.folded_lines(stacks)
        return "".join(r["value"] + "\n" for r in lines.collect())
    if a.verb == "summarize":
        kind, path = sinks.summary_source(a.folder) or sys.exit(f"nothing to summarise in {a.folder}")
        if kind == "summary":
            return "".join(r["value"] + "\n" for r in spark.read.text(path).collect())
        rows = T.folded(T.read_lines(spark, path)) if kind == "folded" else T.folded(sinks.folded_lines(fold_recording(spark, path, True)).withColumnRenamed("value", "line"))
        return _show(_rows(compare.folded_summary(rows)) + ([] if a.json else _rows(compare.folded_top(rows))), a.json)
    if a.kind == "perf":
        s, c = read_recording(spark, a.recording, "samples"), read_recording(spark, a.recording, "comm")
        parts = {"totals": _rows(report.totals(s))[0], "modes": _rows(report.sample_modes(s)), "threads": _rows(report.threads(s, c, a.limit)), "ips": _rows(report.leaf_ips(s, a.limit)), "edges": _rows(report.call_edges(s, a.limit))}
        parts["records"], parts["lost"] = _rows(report.record_counts(read_recording(spark, a.recording, "records"))), _rows(report.lost(read_recording(spark, a.recording, "lost")))[0]["lost"]
        return json.dumps(parts, default=str, indent=2) + "\n" if a.json else sinks.report_text(*(parts[k] for k in ("totals", "modes", "threads", "ips", "edges")))
    if a.kind == "flamegraph":
        e = T.flamegraph(T.read_documents(spark, a.svg))
        found = {
            "top": lambda: flamegraph.top(e, a.limit, a.min_percent), "search": lambda: flamegraph.search(e, a.pattern), "syscalls": lambda: flamegraph.syscalls(e), "summary": lambda: flamegraph.categories(e),
            "diff": lambda: flamegraph.diff(e, T.flamegraph(T.read_documents(spark, a.after)), a.min_percent),
        }[a.mode]()
        return _show(_rows(found.drop("doc", "pos")), a.json)
    if a.kind == "strace":
        calls = T.strace(T.read_lines(spark, a.path))
        return sinks.strace_text(_rows(compare.strace_totals(calls))[0], _rows(compare.strace_by_syscall(calls)))
    docs = T.read_documents(spark, a.path)
    if a.kind == "heaptrack":
        return sinks.heaptrack_text(_rows(T.heaptrack(docs))[0])
    if a.kind == "xctrace":
        rows = T.xctrace(docs)
        return sinks.xctrace_text(_rows(compare.weight_totals(rows))[0], _rows(rows.orderBy("doc", "pos")))
    return "".join(f"{r['stack']} {r['count']}\n" for r in T.bpftrace(docs).orderBy("doc", "block").collect())


def main() -> None:
    spark = SparkSession.builder.appName("stackloom").getOrCreate()
    try:
        sys.stdout.write(run(spark, sys.argv[1:]))
    except BrokenPipeError:
        pass


if __name__ == "__main__":
    main()
