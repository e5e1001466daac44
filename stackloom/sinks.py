"""Folded text, perf-script text, reports, artifact folders, manifests."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.functions.names import UNKNOWN
from stackloom.operators import fold

#: File names of a stored run.
ARTIFACTS = {"manifest": "run.json", "stdout": "stdout.log", "stderr": "stderr.log", "command": "command.txt", "folded": "stacks.folded", "flamegraph": "flamegraph.svg", "summary_text": "summary.txt", "summary_json": "summary.json", "tool_errors": "tool-errors.log"}


def folded_lines(folded: DataFrame) -> DataFrame:
    """One text line a stack, in byte order of stacks (a range partitioning, no single task)."""
    return folded.orderBy("stack").select(F.concat("stack", F.lit(" "), F.col("count").cast("string")).alias("value"))


def write_folded(folded: DataFrame, path: str, single_file: bool = False) -> None:
    lines = folded_lines(folded)
    (lines.coalesce(1) if single_file else lines).write.mode("overwrite").text(path)


def script_line(addr, label):
    """One frame of a stack in perf-script form: a label in the place of the symbol, or of the module that it names."""
    a = F.lower(F.hex(addr))
    line = lambda symbol, module: F.concat(F.lit("\t"), a, F.lit(" "), symbol, F.lit(" ("), module, F.lit(")\n"))
    module = F.regexp_extract(label, "^(?s)\\[(.+)\\]$", 1)
    unknown = F.lit(UNKNOWN)
    plain = (label == UNKNOWN) | label.startswith("0x")
    offset = F.when(label.rlike("(?s)^.*\\+0x[0-9a-fA-F]+$"), F.concat(label, F.lit("+0x0"))).otherwise(label)
    return F.when(plain, line(label, unknown)).when(module != "", line(unknown, module)).otherwise(line(offset, unknown))


def script_stacks(stacks: DataFrame, mappings: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """text: header line, frames leaf to root and a blank line for each raw stack (file, pid, comm, frames, count).

    Frames that drop when stacks are folded drop here too; symbols as in fold.placed_frames.
    """
    flat = fold.placed_frames(stacks, mappings, symbols)
    label = fold.frame_label(F.col("addr"), F.col("path"), F.col("relative"), symbols is not None)
    # the names of one address are written innermost first
    names = F.reverse(F.coalesce("names", F.array(label)))
    text = F.when(F.col("drops"), F.lit("")).otherwise(F.array_join(F.transform(names, lambda x: script_line(F.col("addr"), x)), ""))
    lines = flat.withColumn("line", text)
    own = [F.first(c).alias(c) for c in ("file", "pid", "comm", "count")]
    body = lines.groupBy("id").agg(*own, F.sort_array(F.collect_list(F.struct("pos", "line", "addr", "kind")), asc=False).alias("l"))
    pid = F.coalesce("pid", F.lit(0)).cast("string")
    head = F.concat(F.coalesce("comm", F.lit(UNKNOWN)), F.lit(" "), pid, F.lit("/"), pid, F.lit(" 0: "), F.col("count").cast("string"), F.lit(" cycles:\n"))
    frames = F.reverse(F.transform("l", lambda x: F.struct(x["addr"], x["kind"])))
    ordered = body.orderBy(F.asc_nulls_first("pid"), F.asc_nulls_first("comm"), frames, "file")
    return ordered.select(F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), ""), F.lit("\n")).alias("text"))


def report_text(totals: dict, modes: list, threads: list, ips: list, edges: list) -> str:
    """The recording report as text, of collected rows (each table has a limit)."""
    out = [f"samples: {totals['samples']}", f"weighted samples: {totals['weight']}"]
    out += [f"mode {r['mode']}: samples={r['samples']} weight={r['weight']}" for r in modes]
    out += [f"thread {r['tid']} {r['comm']}: samples={r['samples']} weight={r['weight']}" for r in threads]
    out += [f"ip {r['ip']}: samples={r['samples']} weight={r['weight']}" for r in ips]
    out += [f"edge {r['caller']} -> {r['callee']}: samples={r['samples']} weight={r['weight']}" for r in edges]
    return "\n".join(out) + "\n"


def strace_text(totals: dict, rows: list) -> str:
    out = [f"syscall calls: {totals['total_calls']}", f"syscall seconds: {totals['total_seconds']:.6f}"]
    return "\n".join([*out, *(f"{r['syscall']}: calls={r['calls']} seconds={r['total_seconds']:.6f}" for r in rows)]) + "\n"


def heaptrack_text(row: dict) -> str:
    show = lambda x: "unknown" if x is None else str(x)
    return f"total allocations: {show(row['total_allocations'])}\npeak heap bytes: {show(row['peak_heap_bytes'])}\n"


def xctrace_text(totals: dict, rows: list) -> str:
    return "\n".join([f"xctrace rows: {totals['rows']}", f"xctrace total weight: {totals['total_weight']:.6f}", *(f"{r['symbol']}: {r['weight']:.6f}" for r in rows)]) + "\n"


#: Fields of a run's manifest.
MANIFEST_FIELDS = (
    "command", "cwd", "profile_kind", "requested_backend", "actual_backend", "fallback_reason", "platform", "started_at_unix_ms", "ended_at_unix_ms", "exit_status",
    "sample_frequency", "sample_event", "call_graph", "record_target", "duration_secs", "symbols", "tool_versions", "artifacts", "diagnostics",
)


def artifact(folder: str, kind: str, extension: str | None = None) -> Path:
    """A file of a stored run; kind "raw" is the recorder's own output and takes its extension."""
    return Path(folder) / (f"profile.raw.{extension}" if kind == "raw" else ARTIFACTS[kind])


def run_manifest(**fields) -> dict:
    """All fields of a manifest in order, null where not given."""
    if unknown := set(fields) - set(MANIFEST_FIELDS):
        raise ValueError(f"a manifest has no {', '.join(sorted(unknown))}")
    lists = {"command", "tool_versions", "artifacts", "diagnostics"}
    return {k: fields.get(k, [] if k in lists else None) for k in MANIFEST_FIELDS}


def write_manifest(folder: str, manifest: dict) -> None:
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    (root / ARTIFACTS["manifest"]).write_text(json.dumps(manifest, indent=2) + "\n")


def summary_source(folder: str, has_recording: str = "profile.raw.perf.data") -> tuple[str, str] | None:
    """What a stored run is summarised from: its summary, else its folded stacks, else its recording."""
    for kind, name in (("summary", ARTIFACTS["summary_text"]), ("folded", ARTIFACTS["folded"]), ("recording", has_recording)):
        if (Path(folder) / name).exists():
            return kind, str(Path(folder) / name)
    return None
