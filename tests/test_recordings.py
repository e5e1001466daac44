import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import recordings as R
from objects import debug_object, elf, frame_section
from stackloom import cli
from stackloom.sources import decode as D
from stackloom.sources.recording import Asked, RecordingSource, landings, range_rows, read_ranges, read_recording, recording_ranges, rows
from test_host import an_object

MARK, DEFERRED = 2**64 - 512, 2**64 - 640
KERNEL = 0xFFFFFFFF88000010


def folded(spark, tmp_path, data, **options):
    path = tmp_path / "perf.data"
    path.write_bytes(data)
    out = cli.fold_recording(spark, str(path), **options).collect()
    return sorted(f"{r['stack']} {r['count']}" for r in out)


CASES = {
    "counts": (R.recording([R.sample([0x2000, 0x3000]), R.sample([0x2000, 0x3000]), R.sample([0x4000])]), ["[unknown];0x3000;0x2000 2", "[unknown];0x4000 1"]),
    "marker goes": (R.recording([R.sample([MARK, 0x2000])]), ["[unknown];0x2000 1"]),
    "only a marker": (R.recording([R.sample([MARK])]), []),
    "comm with a space": (R.recording([R.comm(11, 11, "V8 WorkerThread"), R.sample([0x2000])]), ["V8_WorkerThread;0x2000 1"]),
    "comm before and after": (R.recording([R.comm(11, 12, "a"), R.sample([0x2000]), R.comm(11, 12, "b"), R.sample([0x2000])]), ["a;0x2000 1", "b;0x2000 1"]),
    "exec comm wins": (R.recording([R.comm(11, 11, "app", execs=True), R.comm(11, 12, "thread"), R.sample([0x2000])]), ["app;0x2000 1"]),
    "deferred": (R.recording([R.comm(11, 12, "c"), R.sample([0x2000, 0x3000, DEFERRED, 0x4444]), R.deferred(0x4444, [0x5000, 0x6000])]), ["c;0x6000;0x5000;0x3000;0x2000 1"]),
    "deferred without a chain": (R.recording([R.sample([0x2000, DEFERRED, 0x4444])]), []),
    "mapped": (R.recording([R.mmap(11, 0x1000, 0x100, 0, "/bin/app"), R.sample([0x1010])]), ["[unknown];/bin/app+0x10 1"]),
    "mapped later": (R.recording([R.sample([0x1010]), R.mmap(11, 0x1000, 0x100, 0, "/bin/app")]), ["[unknown];/bin/app+0x10 1"]),
    "page offset": (R.recording([R.mmap2_build_id(11, 0x4000, 0x100, 0x20, "/bin/b"), R.sample([0x4010])]), ["[unknown];/bin/b+0x30 1"]),
    "kernel unmapped": (R.recording([R.sample([KERNEL])]), ["[unknown];[unknown] 1"]),
    "comm of another thread": (R.recording([R.comm(11, 12, "a"), R.sample([0x2000], tid=13)]), ["a;0x2000 1"]),
    "an unknown mapping": (R.recording([R.mmap(11, 0x1000, 0x100, 0, "[unknown]"), R.sample([0x1010])]), ["[unknown];[unknown]+0x10 1"]),
    "a kernel map of one process": (R.recording([R.mmap(11, KERNEL - 16, 0x1000, 0, "[mod]"), R.sample([KERNEL])]), [f"[unknown];0x{KERNEL:x} 1"]),
    "a kernel map of all": (R.recording([R.mmap(2**32 - 1, KERNEL - 16, 0x1000, 0, "[mod]"), R.sample([KERNEL])]), ["[unknown];[unknown] 1"]),
    "kernel under a user map": (R.recording([R.mmap(11, KERNEL - 16, 0x1000, 0, "/bin/app"), R.sample([KERNEL])]), [f"[unknown];0x{KERNEL:x} 1"]),
}


@pytest.mark.parametrize("name", CASES)
def test_folds(spark, tmp_path, name):
    data, want = CASES[name]
    assert folded(spark, tmp_path, data) == want


def test_periods(spark, tmp_path):
    data = R.recording([R.sample([0x2000], period=7), R.sample([0x2000], period=3)], R.BASE | R.PERIOD)
    assert folded(spark, tmp_path, data, count_periods=True) == ["[unknown];0x2000 10"]


def test_records_without_time_come_first(spark, tmp_path):
    tail = lambda t: b"\0" * 8 + R.q(t)
    data = R.recording([R.sample([0x2000], time=30), R.comm(11, 11, "app", execs=True, tail=tail(20))], R.BASE | R.TIME, flags=1 << 18)
    assert folded(spark, tmp_path, data) == ["app;0x2000 1"]


def test_first_event_only(spark, tmp_path):
    data = R.recording([R.sample([0x2222], ident=222), R.sample([0x1111], ident=111), R.sample([0x2222], ident=222)], R.BASE | R.IDENT, ids=[(111,), (222,)], attrs=2)
    assert folded(spark, tmp_path, data) == ["[unknown];0x2222 2"]


@pytest.mark.parametrize(("chain", "want"), [([], ["[unknown];0x1233;0x4000 1"]), ([0x9000, 0xA000], ["[unknown];0x1233;0x4000;0xa000;0x9000 1"])])
def test_frame_pointer_unwinding(spark, tmp_path, chain, want):
    # saved bp 0 ends the chain; its return address is one past the call
    stack = R.q(0, 0, 0x1234, 0)[: 24]
    data = R.recording([R.sample(chain, regs=(0x7FFF0008, 0x7FFF0000, 0x4000), stack=stack, dynamic=24)], R.BASE | R.REGS | R.STACK, regs_user=0b111000000)
    assert folded(spark, tmp_path, data) == want
    none = R.recording([R.sample(chain or [0x9000], regs=(0x7FFF0008, 0x7FFF0000, 0x4000), stack=stack, dynamic=0)], R.BASE | R.REGS | R.STACK, regs_user=0b111000000)
    assert folded(spark, tmp_path, none) == (["[unknown];0xa000;0x9000 1"] if chain else ["[unknown];0x9000 1"])


def test_build_ids_and_report(spark, tmp_path):
    event = R.struct.pack("<IHHI", 67, 0, 36 + 16, 0) + b"\xab" * 20 + b"\0" * 4 + b"/bin/app".ljust(16, b"\0")
    data = R.recording([R.comm(1, 11, "reader"), R.comm(2, 22, "writer"), R.sample([0x1000, 0x2000], tid=11, period=7), R.sample([0x3000, 0x4000], pid=2, tid=22, period=5), R.sample([0x1000, 0x2000], tid=11, period=3)], R.BASE | R.PERIOD, build_ids=event)
    path = tmp_path / "p.data"
    path.write_bytes(data)
    assert [(r.path, r.build_id) for r in read_recording(spark, str(path), "build_ids").collect()] == [("/bin/app", "ab" * 20)]
    out = cli.run(spark, ["plumbing", "parse", "perf", "summary", str(path)])
    assert "samples: 3\nweighted samples: 15\n" in out
    assert "thread 11 reader: samples=2 weight=10\n" in out
    assert "ip 0x0000000000001000: samples=2 weight=10\nip 0x0000000000003000" in out
    assert "edge 0x0000000000002000 -> 0x0000000000001000: samples=2 weight=10\n" in out


def test_range_source_equals_whole_file(spark, tmp_path):
    path = tmp_path / "p.data"
    path.write_bytes(R.recording([R.sample([0x2000 + k]) for k in range(50)]))
    spark.dataSource.register(RecordingSource)
    some = spark.read.format("recording").option("path", str(path)).option("table", "samples").option("split_bytes", "100").load()
    assert some.rdd.getNumPartitions() > 5
    key = lambda r: (r.ord, r.callchain)
    assert sorted(map(key, some.collect())) == sorted(map(key, read_recording(spark, str(path)).collect()))


def test_errors_name_the_record():
    bad = R.recording([R.record(3, b"\1\0\0\0")])
    with pytest.raises(D.FormatError, match="record type 3 at offset"):
        list(rows("comm", "f", bad))
    with pytest.raises(D.FormatError):
        D.header(b"PERFILE1" + b"\0" * 200)
    with pytest.raises(D.FormatError):
        list(rows("records", "f", R.recording([b"\1\0\0\0\0\0\4\0"])))


U64, U32 = st.integers(0, 2**64 - 1), st.integers(0, 2**32 - 1)


@settings(max_examples=60, deadline=None)
@given(U32, U32, U64, U64, U64, st.text(alphabet="abc/[].", max_size=20))
def test_mappings_round_trip(pid, tid, start, size, pgoff, path):
    c = D.Cursor(R.struct.pack("<II", pid, tid) + R.q(start, size, pgoff) + R.text(path))
    assert D.fields(1, 0, c) == {"pid": pid, "tid": tid, "start": start, "len": size, "pgoff": pgoff, "path": path}


@settings(max_examples=60, deadline=None)
@given(st.lists(U64, max_size=8), U64, st.binary(max_size=40))
def test_samples_round_trip(chain, period, raw):
    a = D.Attr(0, R.BASE | R.PERIOD | 1 << 10)
    body = R.q(1) + R.struct.pack("<II", 2, 3) + R.q(period, len(chain), *chain) + R.struct.pack("<I", len(raw)) + raw
    got = D.sample(D.Cursor(body), a, strict=True)
    assert (got["callchain"], got["period"], got["raw"], got["pid"]) == (chain, period, raw, 2)
    with pytest.raises(D.FormatError):
        D.sample(D.Cursor(body + b"x"), a, strict=True)
    if body:
        with pytest.raises(D.FormatError):
            D.sample(D.Cursor(body[:-1]) if raw else D.Cursor(body[:-5]), a, strict=True)


@pytest.mark.parametrize(
    ("kind", "payload", "want"),
    [
        (2, R.q(1, 5), {"id": 1, "lost": 5}), (13, R.q(9), {"lost": 9}), (5, R.q(1, 2, 3), {"time": 1, "id": 2, "stream_id": 3}), (7, R.struct.pack("<IIII", 1, 2, 3, 4) + R.q(9), {"pid": 1, "ppid": 2, "tid": 3, "ptid": 4, "time": 9}),
        (11, R.q(1, 2, 3), {"aux_offset": 1, "aux_size": 2, "flags": 3}), (12, R.struct.pack("<II", 1, 2), {"pid": 1, "tid": 2}), (14, b"", {}), (15, R.struct.pack("<II", 1, 2), {"pid": 1, "tid": 2}),
        (16, R.struct.pack("<II", 1, 2) + R.q(1, 7, 8), {"pid": 1, "tid": 2, "links": [(7, 8)]}), (17, R.q(5) + R.struct.pack("<IHH", 6, 1, 0) + b"f\0", {"addr": 5, "len": 6, "ksym_type": 1, "flags": 0, "name": "f"}),
        (18, R.struct.pack("<HHI", 1, 2, 3) + b"12345678", {"bpf_type": 1, "flags": 2, "id": 3, "tag": b"12345678".hex()}), (19, R.q(4) + b"/c\0", {"id": 4, "path": "/c"}),
        (20, R.q(4) + R.struct.pack("<HH", 1, 2) + b"abc", {"addr": 4, "old_len": 1, "new_len": 2, "old_bytes": "61", "new_bytes": "6263"}), (21, R.q(6), {"hw_id": 6}), (22, R.q(3, 2, 8, 9), {"cookie": 3, "ips": [8, 9]}),
        (99, b"zz", {"payload": "7a7a"}), (8, R.struct.pack("<II", 1, 2) + b"r", {"pid": 1, "tid": 2, "payload": "72"}),
    ],
)
def test_record_types(kind, payload, want):
    assert D.fields(kind, 0, D.Cursor(payload)) == want


def test_unwound_frames_in_no_code(spark, tmp_path):
    """Dropped by the mapping when the stack was recorded, or by the last one."""
    stack = R.q(0, 0, 0x1234, 0)[:24]

    def unwound(*others):
        s = R.sample([0x9000], regs=(0x7FFF0008, 0x7FFF0000, 0x4000), stack=stack, dynamic=24)
        return R.recording([*(x or s for x in others)], R.BASE | R.REGS | R.STACK, regs_user=0b111000000)

    heap, code = (R.mmap(11, 0x4000, 0x100, 0, x) for x in ("[heap]", "/bin/app"))
    # a recording's own buffer is no sign of code, so frames outside all maps stay beside it
    for old, rest in (("//anon", ""), ("/x/perf.data.old", "0x1233;"), ("perf.data", "0x1233;")):
        assert folded(spark, tmp_path, unwound(R.mmap(11, 0x4000, 0x100, 0, old), None)) == [f"[unknown];{rest}0x9000 1"]
    assert folded(spark, tmp_path, unwound(heap, None, code)) == ["[unknown];0x9000 1"]
    assert folded(spark, tmp_path, unwound(code, None, heap)) == ["[unknown];0x9000 1"]
    assert folded(spark, tmp_path, unwound(heap, code, None)) == ["[unknown];/bin/app+0x0;0x9000 1"]


def test_kernel_names_from_listings(spark, tmp_path):
    data = R.recording([R.mmap(2**32 - 1, KERNEL - 16, 0x1000, KERNEL - 16, "[kernel.kallsyms]_text"), R.sample([KERNEL])])
    (tmp_path / "k").write_text(f"{KERNEL + 0x1000 - 16:x} T _text\n{KERNEL + 0x1000:x} T moved\n")
    (tmp_path / "m").write_text(f"{KERNEL - 16:x} T _text\n{KERNEL:x} T mapped\n")
    (tmp_path / "l").write_text(f"{KERNEL:x} T live\n")
    assert folded(spark, tmp_path, data, kallsyms=str(tmp_path / "k")) == ["[unknown];moved 1"]
    assert folded(spark, tmp_path, data, kallsyms=str(tmp_path / "l"), system_map=str(tmp_path / "m")) == ["[unknown];mapped 1"]
    assert folded(spark, tmp_path, data, live=str(tmp_path / "l")) == ["[unknown];[unknown] 1"]


def test_object_names(spark, tmp_path):
    """User frames take the name that their object's table has at the segment's address: the cached copy first, and no file that was replaced."""
    own, folder, ident = tmp_path / "o", tmp_path / "debug", b"\x11" * 20
    own.write_bytes(an_object())
    frames = R.sample([0x4008, 0x4028])
    live = R.recording([R.mmap(11, 0x4000, 0x200, 0x100, str(own)), frames])
    # 0x4028 lies behind the last symbol, which is nearest below it
    assert folded(spark, tmp_path, live, debug_dir=str(folder)) == ["[unknown];run;run 1"]
    gone = R.recording([R.mmap2_build_id(11, 0x4000, 0x200, 0x100, "/no/such/app", ident), frames])
    assert folded(spark, tmp_path, gone, debug_dir=str(folder)) == ["[unknown];[app];[app] 1"]
    cached = folder / ".build-id" / ident.hex()[:2] / ident.hex()[2:] / "elf"
    cached.parent.mkdir(parents=True)
    cached.write_bytes(an_object())
    assert folded(spark, tmp_path, gone, debug_dir=str(folder)) == ["[unknown];run;run 1"]
    stat = own.stat()
    device = os.major(stat.st_dev), os.minor(stat.st_dev)
    for inode, want in ((stat.st_ino, "run"), (stat.st_ino + 1, "[o]")):
        place = R.struct.pack("<II", 11, 11) + R.q(0x4000, 0x200, 0x100) + R.struct.pack("<IIQQII", *device, inode, 0, 5, 0) + R.text(str(own))
        assert folded(spark, tmp_path, R.recording([R.record(10, place), R.sample([0x4008])]), debug_dir=str(folder)) == [f"[unknown];{want} 1"]


def test_objects_beside_listings(spark, tmp_path):
    own = tmp_path / "o"
    own.write_bytes(an_object())
    (tmp_path / "l").write_text(f"{KERNEL:x} T live\n")
    data = R.recording([R.mmap(11, 0x4000, 0x200, 0x100, str(own)), R.mmap(2**32 - 1, KERNEL - 16, 0x1000, KERNEL - 16, "[kernel.kallsyms]"), R.sample([KERNEL, 0x4008])])
    assert folded(spark, tmp_path, data, live=str(tmp_path / "l"), debug_dir=str(tmp_path)) == ["[unknown];run;live 1"]
    assert folded(spark, tmp_path, data, live=str(tmp_path / "l")) == ["[unknown];[o];live 1"]


@pytest.mark.parametrize("version", [4, 5])
def test_inlined_frames_of_a_fold(spark, tmp_path, version):
    """Names of nested inlined calls in the order of the stack, mangled names made readable, names of debug strings."""
    own = tmp_path / "app"
    own.write_bytes(debug_object(version) + b"\0plain<u8>\0Vec<a::B>::plain<u8>\0")
    chain = [0x401044, 0x401015, 0x401000, 0x403008, 0x403100, 0x402004, 0x403050]
    maps = [R.mmap(11, 0x401000, 0x4000, 0x1000, str(own))]
    data = R.recording([*maps, R.sample(chain)])
    # 0x3050 has no symbol around it, so the last one below; 0x3100 too.  Debug information names 0x3008 otherwise than its symbol does
    want = "[unknown];other;plain<u8>;other;other;outer;outer;declared;outer;declared;inner 1"
    assert folded(spark, tmp_path, data, debug_dir=str(tmp_path)) == [want]
    bare = tmp_path / "bare"
    bare.write_bytes(debug_object(version, symbols=()))
    data = R.recording([R.mmap(11, 0x401000, 0x4000, 0x1000, str(bare)), R.sample([0x401044, 0x403104, 0x402004])])
    # without symbols the names are those of debug information
    assert folded(spark, tmp_path, data, debug_dir=str(tmp_path)) == ["[unknown];plain;unlisted;outer;declared;inner 1"]


def imitating(n=120, seed=4):
    """Records whose payloads hold what looks like records, of all sizes."""
    rng = random.Random(seed)
    fake = lambda: R.struct.pack("<IHH", rng.choice([1, 3, 9, 10, 70]), 2, rng.choice([8, 16, 40, 100, 3000]))
    out = []
    for k in range(n):
        out.append(rng.choice([
            lambda: R.sample([0x2000 + k, *(int.from_bytes(fake(), "little") for _ in range(rng.randrange(30)))], tid=k, time=1000 + k),
            lambda: R.comm(k % 7, k, "x" * rng.randrange(60), tail=R.q(1000 + k)),
            lambda: R.record(77, b"".join(fake() for _ in range(rng.randrange(40)))),
            lambda: R.deferred(k, [int.from_bytes(fake(), "little")] * rng.randrange(9)),
        ])())
    out.insert(n // 2, R.record(78, fake() * 8190))
    return R.recording(out, R.BASE | R.TIME)


@pytest.mark.parametrize("split", [100, 1000, 40_000, 1 << 30])
def test_ranges_equal_the_whole_file(spark, tmp_path, split):
    for k in range(2):
        (tmp_path / f"p{k}").write_bytes(imitating(seed=k))
    (tmp_path / "p2").write_bytes(R.recording([]))
    ranges = recording_ranges(spark, str(tmp_path), split).cache()
    assert (ranges.count() > 20) == (split < 40_000)
    for table in ("records", "samples", "comm", "deferred"):
        key = lambda r: str(r.asDict())
        assert sorted(map(key, read_ranges(ranges, table).collect())) == sorted(map(key, read_recording(spark, str(tmp_path), table, whole=True).collect()))
    assert len(folded(spark, tmp_path / "..", imitating(), split_bytes=split)) > 5 if split == 1000 else True


def test_a_broken_chain_is_an_error(spark, tmp_path):
    data = bytearray(imitating())
    at = data.find(R.struct.pack("<I", 78) + b"\0\0")
    data[at + 6 : at + 8] = b"\4\0"
    (tmp_path / "p").write_bytes(bytes(data))
    with pytest.raises(Exception, match="no chain of records goes on from offset"):
        recording_ranges(spark, str(tmp_path), 1000).collect()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=12), st.integers(1, 60))
def test_chains_of_any_bytes(payloads, split):
    data = b"".join(R.record(5, p) for p in payloads)
    at, first, seen = 0, 0, []
    while at < len(data):
        k = at // split
        found = {e: (x, n) for e, x, n in landings(data, k * split, min((k + 1) * split, len(data)), len(data), k == 0)}
        seen.append(at)
        at, n = found[at]
        first += n
    assert at == len(data) and first == len(payloads)


def test_columns_and_filters_bound_what_is_decoded(spark, tmp_path, monkeypatch):
    stack = R.q(0, 0, 0x1234)
    data = R.recording([R.sample([0x9000 + k], pid=k % 3, time=100 + k, period=k, regs=(0x7FFF0008, 0x7FFF0000, 0x4000), stack=stack, dynamic=24) for k in range(30)], R.BASE | R.TIME | R.PERIOD | R.REGS | R.STACK, regs_user=0b111000000)
    layouts = D.Layouts(data, D.header(data))
    r = next(D.records(data, D.header(data)))

    def decoded(*columns, **how):
        ends, real = [], D.sample

        def counted(c, a, **k):
            start = c.at
            out = real(c, a, **k)
            ends.append(c.at - start)
            return out

        monkeypatch.setattr(D, "sample", counted)
        h = D.header(data)
        asked = Asked("samples", columns or None, **how)
        got = list(range_rows(asked, "f", data, h.data_offset, h.data_offset + h.data_size, 0))
        monkeypatch.setattr(D, "sample", real)
        return len(got), sum(ends), [asked.columns_of(x) for x in got]

    n, every, _ = decoded()
    assert n == 30 and every == 30 * (r[4] - r[3])
    assert decoded("pid", "time")[:2] == (30, 30 * 16) and decoded("pid", "period")[:2] == (30, 30 * 32) and decoded("callchain")[:2] == (30, 30 * 48)
    n, some, rows_ = decoded("pid", "callchain", since=110, until=119, pids=frozenset({1}))
    assert (n, some) == (4, 4 * 48) and rows_ == [(1, [0x9000 + k]) for k in (10, 13, 16, 19)]
    assert layouts.attrs[0].sample_regs_user == 0b111000000
    path = tmp_path / "p.data"
    path.write_bytes(data)
    got = read_recording(spark, str(path), columns=["time", "pid"], since=120, pids=[0, 2])
    assert got.columns == ["time", "pid"] and sorted(map(tuple, got.collect())) == [(100 + k, k % 3) for k in range(20, 30) if k % 3 != 1]
    with pytest.raises(ValueError, match="no columns nothing"):
        read_recording(spark, str(path), columns=["nothing"])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        spark.dataSource.register(RecordingSource)
        some = spark.read.format("recording").option("path", str(path)).option("columns", "ord,time,pid").option("filters", "true").load()
        got = some.filter("pid = 1 and time >= 110 and time < 120")
        assert sorted(r.ord for r in got.collect()) == [10, 13, 16, 19]
        reader = RecordingSource({"path": str(path), "filters": "true"}).reader(None)
        from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

        left = list(reader.pushFilters([EqualTo(("pid",), 1), GreaterThan(("time",), 109), In(("pid",), (1, 2)), StringContains(("file",), "x")]))
        assert len(left) == 2 and reader.asked.pids == {1} and reader.asked.since == 110
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_a_fold_without_frame_pointers(spark, tmp_path):
    """Frames found by call frame information; an object that cannot be loaded leaves frame pointers."""
    own = tmp_path / "framed"
    own.write_bytes(elf([(".eh_frame", 0x9000, frame_section([(0x4000, 0x4040, b"\x0e\x18"), (0x5000, 0x5040, b"\x0e\x08\x07\x10")], 0x9000))], loads=((0, 0x10000, 0),)))
    stack = R.q(7, 8, 0x5011, 0)

    def recorded(path, chain=()):
        return R.recording([R.mmap(11, 0, 0x10000000, 0, str(path)), R.sample(chain, regs=(0x7FFF0008, 0x7FFF0000, 0x4004), stack=stack, dynamic=32)], R.BASE | R.REGS | R.STACK, regs_user=0b111000000)

    assert folded(spark, tmp_path, recorded(own)) == [f"[unknown];{own}+0x5010;{own}+0x4004 1"]
    # the word at the frame pointer is no return address of this stack
    assert folded(spark, tmp_path, recorded(tmp_path / "gone")) == [f"[unknown];{tmp_path / 'gone'}+0x5010;{tmp_path / 'gone'}+0x4004 1"]
    zero = R.recording([R.mmap(11, 0, 0x10000000, 0, str(own)), R.sample([], regs=(0x7FFF0008, 0x7FFF0000, 0x5004), stack=R.q(0, 0x40, 0x1234), dynamic=24)], R.BASE | R.REGS | R.STACK, regs_user=0b111000000)
    assert folded(spark, tmp_path, zero) == [f"[unknown];{own}+0x5004 1"]


def test_the_listing_of_the_recorded_kernel(spark, tmp_path):
    """Without options kernel frames take names from the cache folder, by the kernel's build id; the first layout that can be read wins."""
    event = lambda ident: R.struct.pack("<IHHI", 67, 0, 36 + 24, 2**32 - 1) + ident * 20 + b"\0" * 4 + b"[kernel.kallsyms]".ljust(24, b"\0")
    maps = [R.mmap(2**32 - 1, KERNEL - 16, 0x1000, KERNEL - 16, "[kernel.kallsyms]"), R.sample([KERNEL])]
    data, other = (R.recording(maps, build_ids=event(b)) for b in (b"\xab", b"\xcd"))
    cache = tmp_path / "cache"
    folder = cache / "[kernel.kallsyms]" / ("ab" * 20)
    folder.mkdir(parents=True)
    assert folded(spark, tmp_path, data, cache=str(cache)) == ["[unknown];[unknown] 1"]
    (folder / "kallsyms").write_text(f"{KERNEL:x} T own_kernel\n")
    assert folded(spark, tmp_path, data, cache=str(cache)) == ["[unknown];own_kernel 1"]
    assert folded(spark, tmp_path, other, cache=str(cache)) == ["[unknown];[unknown] 1"]
    args = ["plumbing", "fold", str(tmp_path / "perf.data"), "--debug-dir", str(cache)]
    assert cli.run(spark, args) == "[unknown];[unknown] 1\n"
    assert cli.run(spark, [*args, "--output", str(tmp_path / "lines")]) == ""
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["[unknown];[unknown] 1"]
