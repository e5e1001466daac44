import struct

import pytest

from stackloom import cli, commands, sinks
from stackloom.functions.addresses import signed
from stackloom.operators import mappings, symbols
from stackloom.sources import elf, host


def test_paths(tmp_path):
    assert host.build_id_object("/h/.debug", "abcdef") == "/h/.debug/.build-id/ab/cdef/elf"
    assert host.cached_kallsyms("/d", "x") == ["/d/[kernel.kallsyms]/x/kallsyms", "/d/[kernel.kallsyms]/x"]
    found = host.system_maps("6.1", ["/k/a/bzImage", "/k/b/bzImage"])
    assert found[0] == "/k/a/System.map" and found[1] == "/boot/System.map-6.1" and found[-1] == "/k/b/System.map" and len(found) == 6
    (tmp_path / "7" / "task" / "12").mkdir(parents=True)
    (tmp_path / "7" / "task" / "9").mkdir()
    assert host.thread_ids(7, str(tmp_path)) == [9, 12]
    (tmp_path / "8" / "task").mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        host.thread_ids(8, str(tmp_path))
    assert host.object_file("[kernel.kallsyms]", "ab") is None and host.object_file("[mod]") is None
    assert host.same_file(str(tmp_path), tmp_path.stat().st_ino) and not host.same_file(str(tmp_path / "no"), 1)


def test_commands():
    assert commands.strace("o", ["a"]) == ["strace", "-f", "-ttt", "-T", "-o", "o", "--", "a"]
    assert commands.heaptrack("p", ["a"]) == ["heaptrack", "-o", "p", "a"]
    assert commands.xctrace_export("t", "x") == ["xctrace", "export", "--input", "t", "--output", "x", "--xpath", "//table"]


def test_off_cpu_commands():
    assert commands.off_cpu("perf-sched", ["a"], "o") == [["perf", "sched", "record", "-o", "o", "--", "a"], ["perf", "sched", "timehist", "-i", "o"]]
    assert commands.off_cpu("perf-cpu-clock", ["a"], "o", frequency=99)[0][:6] == ["perf", "record", "-e", "cpu-clock", "-F", "99"]
    for bad in ({"command": []}, {"command": ["a"], "pid": 4}, {"command": ["a"], "tids": [1]}, {"command": ["a"], "method": "other"}):
        with pytest.raises(ValueError):
            commands.off_cpu(**{"method": "perf-sched", "output": "o", **bad})


def test_run():
    assert commands.run(["sh", "-c", "cat; echo e >&2; exit 3"], b"in") == (3, b"in", b"e\n")
    assert commands.run(["/no/such/tool"])[0] == 127


def test_stored_runs(spark, tmp_path):
    assert sinks.summary_source(str(tmp_path)) is None
    (tmp_path / "stacks.folded").write_text("main;work 2\nmain;idle 3\n")
    out = cli.run(spark, ["plumbing", "summarize", str(tmp_path), "--json"])
    assert '"folded_bytes": 24' in out and '"total_count": 5' in out
    (tmp_path / "summary.txt").write_text("done\n")
    assert cli.run(spark, ["plumbing", "summarize", str(tmp_path)]) == "done\n"
    sinks.write_manifest(str(tmp_path), {"command": ["a"]})
    assert (tmp_path / "run.json").exists()


def test_command_line_over_text(spark, tmp_path):
    (tmp_path / "a.svg").write_text("<title>all (9 samples, 100%)</title><title>__x64_sys_read (4 samples, 40.0%)</title><title>zfs (1 samples, 0.5%)</title>")
    run = lambda *a: cli.run(spark, ["plumbing", "parse", *a])
    assert run("flamegraph", "top", str(tmp_path / "a.svg")) == "__x64_sys_read\t4\t40.0\n"
    assert run("flamegraph", "syscalls", str(tmp_path / "a.svg")) == "read\t4\t40.0\n"
    assert run("flamegraph", "search", str(tmp_path / "a.svg"), "ZFS") == "zfs\t1\t0.5\n"
    (tmp_path / "s").write_text("1 2 read(3) = 1 <0.5>\n")
    assert run("strace", str(tmp_path / "s")) == "syscall calls: 1\nsyscall seconds: 0.500000\nread: calls=1 seconds=0.500000\n"
    (tmp_path / "h").write_text("total allocations: 4\n")
    assert run("heaptrack", str(tmp_path / "h")) == "total allocations: 4\npeak heap bytes: unknown\n"


def an_object():
    """An ELF object with a load segment and three symbols."""
    names = b"\0run\0_weak\0gone\0"
    sym = lambda name, info, shndx, value, size: struct.pack("<IBBHQQ", name, info, 0, shndx, value, size)
    table = b"\0" * 24 + sym(1, 0x12, 1, 0x1000, 32) + sym(5, 0x22, 1, 0x1000, 32) + sym(11, 0x12, 0, 0x2000, 8)
    ph = struct.pack("<IIQQQQQQ", 1, 5, 0x100, 0x1000, 0x1000, 0x200, 0x200, 0)
    at = 64 + len(ph)
    sections = [struct.pack("<IIQQQQIIQQ", 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), struct.pack("<IIQQQQIIQQ", 0, 2, 0, 0, at, len(table), 2, 0, 8, 24), struct.pack("<IIQQQQIIQQ", 0, 3, 0, 0, at + len(table), len(names), 0, 0, 1, 0)]
    head = b"\x7fELF\2\1\1" + b"\0" * 9 + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, 0, 64, at + len(table) + len(names), 0, 64, 56, 1, 64, len(sections), 0)
    return head + ph + table + names + b"".join(sections) + b"\0Vec<a::B>::push<c>\0x<y>\0"


def test_objects(spark, tmp_path):
    (tmp_path / "o").write_bytes(an_object())
    sym = elf.read_symbols(spark, str(tmp_path / "o"))
    object_name = sym.first().object
    want = spark.createDataFrame([(object_name, 0x1008), (object_name, 0x2000), (object_name, 0x1020)], "object string, addr long")
    assert [tuple(r) for r in symbols.best_object_symbol(want, sym).collect()] == [(object_name, 0x1008, "run")]
    offsets = spark.createDataFrame([(object_name, 0x180), (object_name, 0x400)], "object string, offset long")
    got = mappings.file_offset_to_address(offsets, elf.read_segments(spark, str(tmp_path / "o"))).collect()
    assert {r.offset: r.address for r in got} == {0x180: 0x1080, 0x400: None}
    objects = spark.createDataFrame([(str(tmp_path / "o"),)], "object string")
    for size in (64 << 20, 7, 100):
        assert {(r.leaf, r.name) for r in elf.debug_strings(objects, size).collect()} == {("push", "push<c>"), ("x", "x<y>")}
    assert signed(2**64 - 1) == -1


def test_first_listing(tmp_path):
    for name, content in (("zero", "0000000000000000 T _text\n0 t x\n"), ("other", "hello\n\n"), ("good", "x\n0000000000000000 T a\nffffffff81000000 T _text\n"), ("later", "f T b\n")):
        (tmp_path / name).write_text(content)
    path = lambda *names: [str(tmp_path / n) for n in names]
    assert host.first_listing(path("none", "zero", "other", "good", "later")) == str(tmp_path / "good")
    assert host.first_listing(path("none", "zero")) is None and host.first_listing([str(tmp_path)]) is None
