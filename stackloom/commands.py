"""Command lines of external recorders: pure functions, but for `run`."""

from __future__ import annotations

import subprocess

# fixed values throughout: the tools prescribe their options

def perf_record(output: str, target: dict, event: str | None = None, frequency: int = 997, call_graph: str = "dwarf,64000", seconds: int = 10) -> list[str]:
    """target: {"command": [...]}, {"pid": n} or {"tids": [...]}."""
    out = ["perf", "record", *(["-e", event] if event else []), "-F", str(frequency), "-g", "--call-graph", call_graph]
    if "pid" in target:
        out += ["-p", str(target["pid"])]
    elif "tids" in target:
        out += ["-t", ",".join(map(str, target["tids"]))]
    return [*out, "-o", output, "--", *(target["command"] if "command" in target else ["sleep", str(seconds)])]


def strace(output: str, command: list[str]) -> list[str]:
    return ["strace", "-f", "-ttt", "-T", "-o", output, "--", *command]


def heaptrack(prefix: str, command: list[str]) -> list[str]:
    return ["heaptrack", "-o", prefix, *command]


def heaptrack_print(output: str) -> list[str]:
    return ["heaptrack_print", output]


def addr2line(path: str) -> list[str]:
    return ["addr2line", "-f", "-C", "-e", path]


def flamegraph(title: str) -> list[str]:
    return ["inferno-flamegraph", "--title", title, "-"]


def off_cpu(method: str, command: list[str], output: str, frequency: int = 997, call_graph: str = "dwarf,64000", **target) -> list[list[str]]:
    """The commands of one off-CPU run, in order; method: perf-sched or perf-cpu-clock.  Only a command can be followed, no running process."""
    if not command or any(target.values()):
        raise ValueError("off-CPU profiles need a command to run")
    if method == "perf-sched":
        return [["perf", "sched", "record", "-o", output, "--", *command], ["perf", "sched", "timehist", "-i", output]]
    if method == "perf-cpu-clock":
        return [perf_record(output, {"command": command}, "cpu-clock", frequency, call_graph)]
    raise ValueError(f"no off-CPU method {method}")


def xctrace_export(trace: str, output: str) -> list[str]:
    return ["xctrace", "export", "--input", trace, "--output", output, "--xpath", "//table"]


def run(command: list[str], stdin: bytes | None = None, env: dict | None = None) -> tuple[int, bytes, bytes]:
    """(status, stdout, stderr) of a command on the driver; 127 where there is no such program."""
    try:
        done = subprocess.run(command, input=stdin, capture_output=True, env=env, check=False)
    except FileNotFoundError as e:
        return 127, b"", str(e).encode()
    return done.returncode, done.stdout, done.stderr
