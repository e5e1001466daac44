import random

import pytest
from conftest import rows_equal_sql
from pyspark.sql import functions as F

from stackloom import commands, sinks
from stackloom.functions import addresses as A
from stackloom.functions import names as N
from stackloom.operators import compare, flamegraph, fold, mappings, offcpu, symbols, timeline
from stackloom.plans.profile_queries import ORACLE_SQL, QUERIES
from stackloom.sources import text as T
from stackloom.streaming.offcpu import pair_stream


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_sql(spark, sf_dir, name):
    rows_equal_sql(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


def lines(spark, *some):
    return spark.createDataFrame([(x,) for x in some], "line string")


def docs(spark, *some):
    return spark.createDataFrame(list(enumerate(some)), "doc long, text string")


def test_folded_lines(spark):
    got = compare.folded_summary(T.folded(lines(spark, "main;work 2", "main;idle 3"))).first()
    assert tuple(got) == (2, 24, 5)
    got = compare.folded_summary(T.folded(lines(spark, "main 2", "main x", "a b +4", "c 5 "))).first()
    assert (got.folded_lines, got.total_count) == (4, 6)
    with pytest.raises(Exception, match="malformed"):
        T.strict_folded(lines(spark, "main x")).collect()


def test_flamegraph_titles(spark):
    e = T.flamegraph(docs(spark, "<title>all (1,000 samples, 100%)</title><title>read (250 samples, 25.00%)</title><title>tokio::runtime::park (1,125 samples, 12.50%)</title><title>bad</title><title>f(x) (3 samples, 1%)</title>"))
    assert [(r.name, r.samples, r.percent) for r in e.orderBy("pos").collect()] == [("read", 250, 25.0), ("tokio::runtime::park", 1125, 12.5), ("f(x)", 3, 1.0)]
    before = T.flamegraph(docs(spark, "<title>parse (8 samples, 80%)</title><title>read (2 samples, 20%)</title>"))
    after = T.flamegraph(docs(spark, "<title>parse (5 samples, 50%)</title><title>write (5 samples, 50%)</title>"))
    assert [(r.name, r.delta_percent) for r in flamegraph.diff(before, after).collect()] == [("write", 50.0), ("parse", -30.0), ("read", -20.0)]


def test_strace(spark):
    calls = T.strace(lines(spark, "1 12:0 read(3, <x>) = 5 <0.002>", "1 12:0 read(3) = 5 <0.003>", "2 12:0 write(1) = 1 <0.0025>", "no duration", "x <0.5>", "y(1) <unfinished>"))
    assert [(r.syscall, r.calls, round(r.total_seconds, 6)) for r in compare.strace_by_syscall(calls).collect()] == [("read", 2, 0.005), ("write", 1, 0.0025)]
    assert compare.strace_totals(calls).first().total_calls == 4


def test_heaptrack_xctrace_bpftrace(spark):
    r = T.heaptrack(docs(spark, "total allocations: 1\n total allocations: 42 x\npeak heap memory consumption: 1024 bytes\n")).first()
    assert (r.total_allocations, r.peak_heap_bytes) == (42, 1024)
    x = T.xctrace(docs(spark, "<row><symbol>S</symbol><weight>12.5</weight></row><row><symbol>T</symbol><weight>3</weight></row><row><symbol>U</symbol></row>"))
    assert tuple(compare.weight_totals(x).first()) == (2, 15.5)
    b = T.bpftrace(docs(spark, "Attaching\n@offcpu[\n    7f00 tokio::runtime::park+12 (app)\n    7f01 app::serve+0 (app)\n]: 1500\n@offcpu[\n]: 3\n@offcpu[\n  1 lost\n@offcpu[\n  2 a::b (x)\n]: 4\n"))
    assert [(r.stack, r["count"]) for r in b.orderBy("block").collect()] == [("app::serve;tokio::runtime::park", 1500), ("a::b", 4)]


def test_names(spark):
    assert N.tidy_stack(["method(arg)", "java;semi", "a->b", "main.(*T).f(x)", "(anonymous namespace)::g(y)", "v<(x)>(z)"]) == "method;java:semi;a;b_[i];main.(*T).f;(anonymous namespace)::g;v<(x)>"
    d = spark.createDataFrame([(["c", "java;semi"],), (["x(y)", "a->b"],), (["", "q"],)], "f array<string>")
    assert [r[0] for r in d.select(N.render_tidy_stack(F.col("f"))).collect()] == [N.tidy_stack(x) for x in (["c", "java;semi"], ["x(y)", "a->b"], ["", "q"])]
    e = spark.createDataFrame([("foo;bar\nbaz",)], "f string").select(N.escape_frame(F.col("f"))).first()[0]
    assert e == "foo\\;bar baz"
    assert N.symbol_name("alloc::vec::Vec<a::B>::push") == "push<a::B>"
    assert N.symbol_name("alloc::vec::Vec<u8>::push") == "alloc::vec::Vec<u8>::push"
    assert N.debug_function_name("alloc::vec::Vec<u8>::push") == "push"
    assert N.debug_function_name("std::io::read") == "std::io::read"
    cats = {"__x64_sys_recvfrom": "Network I/O", "__x64_sys_brk": "Syscall", "SYSCALL_x": "Other", "zfs_read": "Disk I/O"}
    got = spark.createDataFrame([(k,) for k in cats], "n string").select("n", N.category(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in got} == cats


def test_unsigned_arithmetic(spark):
    rng = random.Random(1)
    pairs = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(200)] + [(2**64 - 1, 1), (0, 0)]
    d = spark.createDataFrame([(A.signed(a), A.signed(b)) for a, b in pairs], "a long, b long")
    got = d.select(A.wrapping_add(F.col("a"), F.col("b")), A.wrapping_sub(F.col("a"), F.col("b")), A.saturating_end(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(A.signed((a + b) % 2**64), A.signed((a - b) % 2**64), A.signed(min(a + b, 2**64 - 1))) for a, b in pairs]


def test_mappings_by_brute_force(spark):
    rng = random.Random(2)
    maps = [("f", rng.choice([1, 2, A.ALL_PIDS]), rng.randrange(0, 400) * 8, rng.randrange(1, 60) * 8, 16, f"/m{k}", 5, None, k) for k in range(60)]
    want = [("f", rng.choice([1, 2, 3, None]), rng.randrange(0, 4000)) for _ in range(300)]
    m = spark.createDataFrame(maps, "file string, pid long, start long, len long, pgoff long, path string, prot long, build_id string, ord long")
    got = {(r.pid, r.addr): (r.map_path, r.relative) for r in mappings.resolve(spark.createDataFrame(want, "file string, pid long, addr long"), m).collect()}
    brute = {}
    for _, pid, at in want:
        hits = [(x[2], x[1] == pid, x[8], x) for x in maps if pid is not None and x[1] in (pid, A.ALL_PIDS) and x[2] <= at < x[2] + x[3]]
        if hits:
            x = max(hits)[3]
            brute[pid, at] = (x[5], at - x[2] + 16)
    assert got == brute


def test_nearest_below_by_brute_force(spark):
    rng = random.Random(3)
    sym = {rng.getrandbits(64): f"s{k}" for k in range(200)}
    want = [rng.getrandbits(64) for _ in range(300)] + [0, min(sym) - 1, max(sym)]
    s = spark.createDataFrame([(A.signed(a), n) for a, n in sym.items()], "addr long, name string")
    got = {r.addr: r.name for r in symbols.nearest_below(spark.createDataFrame([(A.signed(a),) for a in want], "addr long"), s).collect()}
    assert got == {A.signed(a): sym[max(below)] if (below := [x for x in sym if x <= a]) else None for a in want}


def test_kallsyms(spark):
    d = lines(spark, "ffffffff8800008f T asm_exc_page_fault", "0 T zero", "bad", "ffffffff88000000 t __pi_x", "ffffffff88000000 t x", "ffffffff88000000 t __pi_y").withColumn("seq", F.monotonically_increasing_id())
    table = {r.addr: r.name for r in symbols.kallsyms_table(T.kallsyms(d)).collect()}
    assert table == {A.signed(0xFFFFFFFF8800008F): "asm_exc_page_fault", A.signed(0xFFFFFFFF88000000): "__pi_x"}
    known = T.kallsyms(lines(spark, "ffffffff81000000 T _text", "ffffffff81001270 T asm_exc_page_fault").withColumn("seq", F.monotonically_increasing_id()))
    at = spark.createDataFrame([(A.signed(0xFFFFFFFF88001280),)], "addr long")
    assert symbols.relocated(at, known, "_text", A.signed(0xFFFFFFFF88000000)).first().name == "asm_exc_page_fault"


def test_symbol_labels(spark):
    stacks = spark.createDataFrame([("f", 11, None, [(0x10, 0)], 1), ("f", 11, None, [(0x900, 0)], 1)], "file string, pid long, comm string, frames array<struct<addr:long,kind:int>>, count long")
    maps = spark.createDataFrame([("f", 11, 0, 0x100, 0, "/usr/bin/app", 5, None, 0)], "file string, pid long, start long, len long, pgoff long, path string, prot long, build_id string, ord long")
    none = spark.createDataFrame([], "file string, pid long, addr long, names array<string>")
    assert sorted(r.stack for r in fold.folded(stacks, maps, none).collect()) == ["[unknown];[app]", "[unknown];[unknown]"]
    inlined = spark.createDataFrame([("f", 11, 0x10, ["app::outer", "app::inner"])], none.schema)
    assert "[unknown];app::outer;app::inner" in {r.stack for r in fold.folded(stacks, maps, inlined).collect()}


def test_comm_as_of_by_brute_force(spark):
    rng = random.Random(4)
    s = [("f", k, rng.choice([None, rng.randrange(50)]), rng.randrange(3), rng.randrange(6)) for k in range(0, 200, 2)]
    c = [("f", k, rng.choice([None, rng.randrange(50)]), rng.randrange(3), rng.randrange(6), f"c{k}", rng.random() < 0.1) for k in range(1, 80, 2)]
    samples = spark.createDataFrame(s, "file string, ord long, time long, pid long, tid long")
    comms = spark.createDataFrame(c, "file string, ord long, time long, pid long, tid long, comm string, is_exec boolean")
    got = {r.ord: r.comm for r in timeline.comm_as_of(samples, comms).collect()}
    assert {r.ord: r.comm for r in timeline.comm_as_of(samples, comms, time_bits=3, ord_bits=4).collect()} == got
    execs, threads, process, want = {}, {}, {}, {}
    for r in sorted([*s, *c], key=lambda r: (r[2] or 0, r[1])):
        if len(r) == 7:
            threads[r[4]] = r[5]
            process[r[3]] = r[5]
            if r[6]:
                execs[r[3]] = r[5]
        else:
            want[r[1]] = execs.get(r[3]) or threads.get(r[4]) or process.get(r[3])
    assert got == want


def test_script_text(spark):
    stacks = spark.createDataFrame([("f", 1, None, [(0x2000, 0)], 1)], "file string, pid long, comm string, frames array<struct<addr:long,kind:int>>, count long")
    maps = spark.createDataFrame([], "file string, pid long, start long, len long, pgoff long, path string, prot long, build_id string, ord long")
    assert sinks.script_stacks(stacks, maps).first().text == "[unknown] 1/1 0: 1 cycles:\n\t2000 0x2000 ([unknown])\n\n"


SWITCHES = "file string, pid long, cpu long, time long, ord long, out boolean, kstack string"


def switch_rows(seed, n=400):
    """Two recordings, idle tasks of two cpus, a pid whose blocks are far apart, ties in time."""
    rng = random.Random(seed)
    rows = []
    for file in "ab":
        t = 0
        for k in range(n):
            t += rng.choice([0, 1, 5, 40]) * 1_000_000
            rows.append((file, rng.choice([0, 0, 1, 2]), rng.randrange(2), t, k, rng.random() < 0.5, rng.choice(["s", "t;u", None])))
    return rows


def paired(rows):
    last, out = {}, []
    for file, pid, cpu, time, _, is_out, stack in sorted(rows, key=lambda r: (r[0], r[3], r[4])):
        key = file, pid, cpu if pid == 0 else None
        if not is_out and key in last and last[key][0]:
            out.append((file, pid, last[key][2], last[key][1], time - last[key][1]))
        last[key] = is_out, time, stack
    return out


@pytest.mark.parametrize("bits", [0, 22, 27, 40])
def test_offcpu_pairs_by_blocks(spark, bits):
    rows = switch_rows(bits)
    got = offcpu.pairs(spark.createDataFrame(rows, SWITCHES), bits)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, paired(rows)))


def test_offcpu_stream_equals_batch(spark, tmp_path):
    """Micro-batches in any order within the delay, two files; state goes when nothing is open."""
    rng = random.Random(7)
    rows = sorted(switch_rows(7, 120), key=lambda r: r[3])
    # each row is moved by less than the delay of two seconds
    shuffled = sorted(rows, key=lambda r: r[3] + rng.randrange(1_500_000_000))
    last = max(r[3] for r in rows)
    batches = [shuffled[k : k + 60] for k in range(0, len(shuffled), 60)] + [[("end", 9, 0, last + 10**11, 0, False, None)], [("end", 9, 0, last + 10**11 + 1, 1, False, None)]]
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, b in enumerate(batches):
            spark.createDataFrame(b, SWITCHES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(SWITCHES).parquet(str(tmp_path / "in"))
            query = pair_stream(stream, "2 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out")).select("file", "pid", "kstack", "start", "delta").collect()
    finally:
        spark.conf.set(provider, before)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, paired(rows)))


def test_command_lines():
    assert commands.perf_record("o", {"tids": [1, 2]}, seconds=3) == ["perf", "record", "-F", "997", "-g", "--call-graph", "dwarf,64000", "-t", "1,2", "-o", "o", "--", "sleep", "3"]
    assert commands.perf_record("o", {"command": ["app"]}, event="cycles")[-2:] == ["--", "app"]


def test_blocks_of_crowded_addresses(spark, monkeypatch):
    """Symbols in the block of an address, in an earlier one of its block of blocks, in an earlier block of blocks, or nowhere below."""
    base = 0xFFFFFFFF81000000
    sym = [(A.signed(base + 4096 * k), f"s{k}") for k in range(1000)] + [(5, "low"), (2**40, "mid"), (2**40 + 2**30, "mid2"), (2**62, "half")]
    asked = [base + 4096 * k + 3 for k in range(0, 1000, 7)] + [0, 5, 7, 2**21, 2**39, 2**40 - 1, 2**40 + 2**22, 2**40 + 2**31, 2**50, 2**61, 2**63 + 9, base - 1, 2**64 - 1]
    at = spark.createDataFrame([(A.signed(x),) for x in asked], "addr long")
    known = spark.createDataFrame(sym, "addr long, name string")
    table = sorted((a % 2**64, n) for a, n in sym)
    want = {A.signed(x): next((n for a, n in reversed(table) if a <= x), None) for x in asked}
    for bits in (20, 12, 4):
        monkeypatch.setattr(symbols, "BLOCK_BITS", bits)
        assert {r.addr: r.name for r in symbols.nearest_below(at, known).collect()} == want
    assert symbols.nearest_below(at, known.limit(0)).filter("name is not null").count() == 0


def test_kernel_requests(spark):
    at = A.signed(0xFFFFFFFF81000010)
    d = spark.createDataFrame([("[kernel.kallsyms]_text", at, 7), ("[kernel.kallsyms]", at, 7), ("[guest.kernel]", at, 7), ("[vdso]", 16, 7), ("/bin/x", 16, 7)], "path string, relative long, pgoff long")
    path, relative = F.col("path"), F.col("relative")
    got = d.select(mappings.request_path(path, relative).alias("p"), mappings.kernel_relocation(path, F.col("pgoff")).alias("r"), mappings.is_kernel_mapping(path, relative).alias("k")).collect()
    assert [(r.p, tuple(r.r) if r.r else None, r.k) for r in got] == [("[kernel.kallsyms]", ("_text", 7), True), ("[kernel.kallsyms]", None, True), ("[guest.kernel]", None, True), ("[vdso]", None, False), ("/bin/x", None, False)]
    ids = spark.createDataFrame([("f", 0, "/bin/x", "aa"), ("f", 1, "[kernel]", "bb"), ("f", 2, "[kernel.kallsyms]", "cc")], "file string, seq long, path string, build_id string")
    assert [tuple(r) for r in mappings.kernel_build_id(ids).collect()] == [("f", "bb")]


def test_script_text_with_symbols(spark):
    stacks = spark.createDataFrame([("f", 1, "c d", [(0x900, 0), (0x10, 0), (0x20, 0), (0x205, 0), (0x306, 1)], 3)], "file string, pid long, comm string, frames array<struct<addr:long,kind:int>>, count long")
    maps = spark.createDataFrame([("f", 1, 0, 0x100, 0, "/usr/bin/app", 5, None, 0), ("f", 1, 0x200, 0x100, 0, "[vdso]", 5, None, 1), ("f", 1, 0x300, 0x100, 0, "/x/perf.data.old", None, None, 2)], "file string, pid long, start long, len long, pgoff long, path string, prot long, build_id string, ord long")
    names = spark.createDataFrame([("f", 1, 0x10, ["outer", "inner"])], "file string, pid long, addr long, names array<string>")
    want = "c d 1/1 0: 3 cycles:\n\t205 [vdso]+0x5+0x0 ([unknown])\n\t20 [unknown] (app)\n\t10 inner ([unknown])\n\t10 outer ([unknown])\n\t900 [unknown] ([unknown])\n\n"
    assert sinks.script_stacks(stacks, maps, names).first().text == want
    # without symbols, an unwound frame outside the maps of a process that has some goes too
    lone = spark.createDataFrame([("f", 1, None, [(0x5000, 1), (0x5001, 0)], 1)], stacks.schema)
    assert sinks.script_stacks(lone, maps).first().text == "[unknown] 1/1 0: 1 cycles:\n\t5001 0x5001 ([unknown])\n\n"


def test_ties_of_entries_keep_their_place(spark):
    e = T.flamegraph(docs(spark, "<title>b (9 samples, 5%)</title><title>a (7 samples, 5%)</title><title>a (3 samples, 5%)</title>"))
    assert [(r.name, r.samples) for r in flamegraph.top(e).collect()] == [("a", 7), ("a", 3), ("b", 9)]


def test_threads_of_several_recordings(spark):
    s = spark.createDataFrame([("x", 1, 1, 2), ("y", 1, 1, 5)], "file string, pid long, tid long, period long")
    c = spark.createDataFrame([("x", 0, 1, 1, "a"), ("y", 0, 1, 1, "b")], "file string, ord long, pid long, tid long, comm string")
    from stackloom.operators import offcpu, report

    assert [(r.file, r.comm, r.weight) for r in report.threads(s, c).collect()] == [("y", "b", 5), ("x", "a", 2)]
    assert [r.comm for r in report.last_comms(c, "pid").orderBy("file").collect()] == ["a", "b"]
    switches = spark.createDataFrame([("x", 0, 0, 1, 0, True, "s"), ("y", 0, 0, 2, 0, False, "t"), ("x", 0, 1, 3, 1, False, "u"), ("x", 0, 0, 9, 2, False, "v")], "file string, pid long, cpu long, time long, ord long, out boolean, kstack string")
    assert [tuple(r) for r in offcpu.pairs(switches).collect()] == [("x", 0, "s", 1, 8)]


def test_manifest(tmp_path):
    m = sinks.run_manifest(command=["app"], exit_status=0)
    assert tuple(m) == sinks.MANIFEST_FIELDS and m["artifacts"] == [] and m["cwd"] is None
    sinks.write_manifest(str(tmp_path), m)
    assert sinks.artifact(str(tmp_path), "manifest").exists() and sinks.artifact("r", "raw", "perf.data").name == "profile.raw.perf.data"
    with pytest.raises(ValueError, match="no colour"):
        sinks.run_manifest(colour=1)


def _rows_joined(spark, run) -> int:
    """The most rows that a join made while run() ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    made, ran = [0], store.executionsList()
    for k in range(before, ran.size()):
        ident = ran.apply(k).executionId()
        values, nodes = store.executionMetrics(ident), store.planGraph(ident).allNodes()
        for n in (nodes.apply(i) for i in range(nodes.size())):
            for m in (n.metrics().apply(i) for i in range(n.metrics().size())) if "Join" in n.name() else ():
                if m.name() == "number of output rows" and values.get(m.accumulatorId()).isDefined():
                    made.append(int(values.get(m.accumulatorId()).get().replace(",", "")))
    return max(made)


def test_noise_as_of_is_brute_force_and_pairs_no_frames_with_mappings(spark):
    rng = random.Random(5)
    time = lambda: rng.choice([None, 0, rng.randrange(1, 2**34), -rng.randrange(1, 2**34)])
    paths = ["[heap]", "/lib/a", "//anon", "/x/perf.data"]
    maps = [(rng.choice("fg"), o, rng.choice([1, 2, 4294967295]), 4096 * rng.randrange(1, 4), rng.choice([64, 4096, 9000]), rng.choice(paths), time()) for o in range(300)]
    frames = [(rng.choice("fg"), rng.choice([1, 2, 3, None]), 4096 + rng.choice([0, 60, 70, 4096, 9000, 40000]), 1000 + k // 2, time(), rng.randrange(400)) for k in range(1200)]
    unsigned = lambda x: (x or 0) % 2**64
    want = set()
    for file, pid, addr, ident, t, o in frames:
        best = max(((m[3], m[2] == pid, m[1], m[5]) for m in maps if m[0] == file and pid is not None and m[2] in (pid, 4294967295) and m[3] <= addr < m[3] + m[4] and (unsigned(m[6]), m[1]) < (unsigned(t), o)), default=None)
        if best and best[3] != "/lib/a":
            want.add((file, ident, addr))
    m = spark.createDataFrame(maps, "file string, ord long, pid long, start long, len long, path string, time long").selectExpr("*", "0L as pgoff", "5L as prot", "cast(null as string) as build_id")
    f = spark.createDataFrame(frames, "file string, pid long, addr long, id long, time long, ord long").withColumn("at", F.struct(*timeline.replay_order()))
    for bits in ({}, {"ord_bits": 4, "time_bits": 30}):
        got = [tuple(r) for r in mappings.noise_as_of(f, m, **bits).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    # 2,000 frames at one address in 200 mappings
    m = spark.range(200).selectExpr("'f' as file", "id as ord", "1L as pid", "4096L as start", "64L as len", "if(id % 2 = 0, '[heap]', '/lib/a') as path", "cast(null as long) as time", "0L as pgoff", "5L as prot", "cast(null as string) as build_id")
    f = spark.range(2000).selectExpr("'f' as file", "1L as pid", "4100L as addr", "id", "cast(null as long) as time", "id as ord").withColumn("at", F.struct(*timeline.replay_order()))
    assert _rows_joined(spark, lambda: mappings.noise_as_of(f, m).collect()) <= 2 * 2200
