"""Tables of binary recordings.

A recording is read in byte ranges, by as many tasks (`recording_ranges`,
`read_ranges`); files of any store that pyarrow opens will do.  With `whole`, files
come through Spark's binary reader, each decoded where it is read, from any store
that Spark opens, up to the 2 GB of a value.

Samples are decoded as far as the columns asked for need; records outside the times
and pids asked for are not decoded.
"""

from __future__ import annotations

import json
import mmap
import re
import struct
from contextlib import contextmanager
from dataclasses import dataclass, replace
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from stackloom.functions.addresses import signed
from stackloom.sources import decode as D

SPLIT_BYTES = 64 << 20
#: Tables that need no records.
HEAD_TABLES = ("attrs", "features", "build_ids")
_L, _I, _S, _B = pa.int64(), pa.int32(), pa.string(), pa.bool_()
_PLACE = [("file", _S), ("ord", _L), ("time", _L)]
#: Columns of each table; ord is a record's number in its file.
TABLES = {
    "records": [*_PLACE, ("offset", _L), ("record_type", _I), ("record_name", _S), ("misc", _I), ("size", _I)],
    "comm": [*_PLACE, ("pid", _L), ("tid", _L), ("comm", _S), ("is_exec", _B)],
    "mappings": [*_PLACE, ("pid", _L), ("start", _L), ("len", _L), ("pgoff", _L), ("path", _S), ("prot", _L), ("build_id", _S), ("major", _L), ("minor", _L), ("inode", _L), ("generation", _L)],
    "samples": [*_PLACE, ("misc", _I), ("cpumode", _I), ("event_index", _I), ("pid", _L), ("tid", _L), ("period", _L), ("callchain", pa.list_(_L)), ("cookie", _L), ("unwound", pa.list_(_L)), ("has_user_stack", _B), ("user_register_count", _I), ("user_register_ip", _L), ("user_stack_size", _L), ("user_stack_dynamic_size", _L)],
    "stacks": [*_PLACE, ("pid", _L), ("tid", _L), ("ip", _L), ("sp", _L), ("bp", _L), ("stack", pa.binary())],
    "lost": [*_PLACE, ("lost", _L)],
    "deferred": [*_PLACE, ("cookie", _L), ("ips", pa.list_(_L))],
    "details": [*_PLACE, ("record_type", _I), ("record_name", _S), ("fields", _S)],
    "attrs": [("file", _S), ("event_index", _I), ("sample_type", _L), ("read_format", _L), ("branch_sample_type", _L), ("sample_regs_user", _L), ("sample_regs_intr", _L), ("sample_id_all", _B), ("ids", pa.list_(_L))],
    "build_ids": [("file", _S), ("seq", _L), ("pid", _L), ("build_id", _S), ("path", _S)],
    "features": [("file", _S), ("feature", _I), ("offset", _L), ("size", _L)],
}
_SQL = {_L: "long", _I: "int", _S: "string", _B: "boolean", pa.list_(_L): "array<long>", pa.binary(): "binary"}
#: Behind which field a sample's decoding may end for a column; the others need the user stack.
_NEEDS = dict.fromkeys(("file", "ord", "time", "misc", "cpumode", "event_index", "pid", "tid"), "TID") | {"period": "PERIOD", "callchain": "CALLCHAIN", "cookie": "CALLCHAIN"}
_DEPTH = ("TID", "PERIOD", "CALLCHAIN", "STACK_USER")


def schema(table: str, columns: list[str] | None = None) -> str:
    return ", ".join(f"`{n}` {_SQL[t]}" for n, t in TABLES[table] if columns is None or n in columns)


@dataclass(frozen=True)
class Asked:
    """What is read of a table: columns (None: all), first and last time (unsigned), pids, record types."""

    table: str
    columns: tuple[str, ...] | None = None
    since: int | None = None
    until: int | None = None
    pids: frozenset[int] | None = None
    kinds: frozenset[int] | None = None

    @property
    def depth(self) -> str:
        return max((_NEEDS.get(c, "STACK_USER") for c in self.columns), key=_DEPTH.index, default="TID") if self.columns is not None else "STACK_USER"

    def passes(self, kind: int, c: D.Cursor, layouts: D.Layouts) -> bool:
        """Whether a record is decoded at all."""
        if self.kinds is not None and kind not in self.kinds:
            return False
        if self.since is not None or self.until is not None:
            t = D.record_time(kind, c, layouts) or 0
            if t < (self.since or 0) or self.until is not None and t > self.until:
                return False
        return not (self.pids is not None and kind == 9 and D.record_pid(kind, c, layouts) not in self.pids)

    def columns_of(self, row: tuple) -> tuple | None:
        """The columns asked for, of a row that is asked for."""
        names = [n for n, _ in TABLES[self.table]]
        if self.pids is not None and "pid" in names and row[names.index("pid")] not in self.pids:
            return None
        return row if self.columns is None else tuple(v for n, v in zip(names, row, strict=True) if n in self.columns)


class Remote:
    """Bytes of a file that cannot be mapped: slices are read when asked for, single bytes in pages."""

    PAGE = 1 << 20

    def __init__(self, f):
        self.f, self.size, self.at, self.page = f, f.size(), 0, b""

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, k):
        if isinstance(k, slice):
            start, stop, _ = k.indices(self.size)
            return self.f.read_at(max(0, stop - start), start)
        if not self.at <= k < self.at + len(self.page):
            self.at, self.page = k, self.f.read_at(self.PAGE, k)
        return self.page[k - self.at]


@contextmanager
def opened(name: str):
    """The bytes of a file: mapped where it is local, read when asked for elsewhere."""
    from pyarrow import fs

    if name.startswith("file:") or "://" not in name:
        path = re.sub("^file:/*", "/", name)
        if not Path(path).stat().st_size:
            yield b""
            return
        with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            yield data
        return
    store, path = fs.FileSystem.from_uri(name)
    with store.open_input_file(path) as f:
        yield Remote(f)


def _opt(x: int | None) -> int | None:
    return None if x is None else signed(x)


def stack_row(payload: D.Cursor, layouts: D.Layouts) -> tuple | None:
    """Columns of a captured user stack behind its place: pid, tid, registers, and its bytes as far as they are stack."""
    a = layouts.of(payload)
    if a is None or not (a.has("CALLCHAIN") and a.has("REGS_USER") and a.has("STACK_USER")):
        return None
    s = D.sample(payload, a)
    stack, regs, size = s.get("stack_user"), s["regs_user"], s.get("stack_dynamic_size")
    if not stack or not size or len(regs["values"]) != a.sample_regs_user.bit_count():
        return None
    bp, sp, ip = (D.masked_register(a.sample_regs_user, regs["values"], r) for r in (6, 7, 8))
    if None in (bp, sp, ip):
        return None
    return s.get("pid"), s.get("tid"), signed(ip), signed(sp), signed(bp), bytes(stack[:size])


def sample_row(payload: D.Cursor, misc: int, layouts: D.Layouts, until: str = "STACK_USER") -> tuple | None:
    """Columns of a sample behind its place; None without a layout or a call chain.  until: the last field that is decoded."""
    a = layouts.of(payload)
    if a is None or not a.has("CALLCHAIN"):
        return None
    s = D.sample(payload, a, until=until)
    chain, cookie = s.get("callchain", []), None
    if len(chain) >= 2 and chain[-2] == 2**64 - 640:
        chain, cookie = chain[:-1], chain[-1]
    stack, regs = s.get("stack_user"), s.get("regs_user")
    unwound = []
    if stack and s["stack_dynamic_size"] and regs and len(regs["values"]) == a.sample_regs_user.bit_count():
        bp, sp, ip = (D.masked_register(a.sample_regs_user, regs["values"], r) for r in (6, 7, 8))
        if None not in (bp, sp, ip):
            unwound = D.frame_pointer_unwind(ip, sp, bp, stack)
    return (
        misc, misc & 7, a.index, s.get("pid"), s.get("tid"), _opt(s.get("period")), [signed(x) for x in chain], _opt(cookie), [signed(x) for x in unwound],
        stack is not None, len(regs["values"]) if regs else 0, _opt(D.masked_register(a.sample_regs_user, regs["values"], 8)) if regs else None, len(stack or b""), _opt(s.get("stack_dynamic_size", 0)),
    )


def _json(x):
    return [_json(y) for y in x] if isinstance(x, (list, tuple)) else x


def record_row(table: str, data: bytes, r: tuple, layouts: D.Layouts, place: tuple, base: int = 0, asked: Asked | None = None) -> tuple | None:
    """A record's row of table; None if it has none.  base: where data begins in the file."""
    offset, kind, misc, a, b = r
    offset += base
    try:
        c = D.Cursor(data, a, b)
        if asked is not None and not asked.passes(kind, c, layouts):
            return None
        place = (*place, _opt(D.record_time(kind, c, layouts)))
        if table == "records":
            return (*place, offset, kind, D.RECORD_NAMES.get(kind, "UNSUPPORTED"), misc, b - a + 8)
        if table == "samples":
            row = sample_row(c, misc, layouts, asked.depth if asked is not None else "STACK_USER") if kind == 9 else None
            return row and (*place, *row)
        if table == "stacks":
            row = stack_row(c, layouts) if kind == 9 else None
            return row and (*place, *row)
        if kind == 9:
            return None
        wanted = {"comm": (3,), "mappings": (1, 10), "lost": (2, 13), "deferred": (22,), "details": None}[table]
        if wanted is not None and kind not in wanted:
            return None
        f = D.fields(kind, misc, c)
    except D.FormatError as e:
        raise D.FormatError(f"record type {kind} at offset {offset}: {e}") from e
    if table == "comm":
        return (*place, f["pid"], f["tid"], f["comm"], f["is_exec"])
    if table == "mappings":
        return (*place, f["pid"], signed(f["start"]), signed(f["len"]), signed(f["pgoff"]), f["path"], f.get("prot"), f.get("build_id"), f.get("major"), f.get("minor"), _opt(f.get("inode")), _opt(f.get("generation")))
    if table == "lost":
        return (*place, signed(f["lost"]))
    if table == "deferred":
        return (*place, signed(f["cookie"]), [signed(x) for x in f["ips"]])
    return (*place, kind, D.RECORD_NAMES.get(kind, "UNSUPPORTED"), json.dumps({k: _json(v) for k, v in f.items()}))


def rows(table: str, name: str, data: bytes):
    h = D.header(data)
    if table == "attrs":
        for a in D.attrs(data, h):
            yield (name, a.index, *(signed(x) for x in (a.sample_type, a.read_format, a.branch_sample_type, a.sample_regs_user, a.sample_regs_intr)), a.sample_id_all, [signed(x) for x in D.attr_ids(data, a)])
    elif table == "features":
        for f in D.feature_sections(data, h):
            yield (name, *f)
    elif table == "build_ids":
        for k, (pid, build, path) in enumerate(D.build_ids(data, h)):
            yield (name, k, pid, build, path)
    else:
        layouts = D.Layouts(data, h)
        for k, r in enumerate(D.records(data, h)):
            row = record_row(table, data, r, layouts, (name, k))
            if row is not None:
                yield row


def _batches(asked: Asked, some, most_bytes: int = 16 << 20):
    """Batches of rows of the table, in the columns asked for; few rows make one where they are large."""
    fields = [(n, t) for n, t in TABLES[asked.table] if asked.columns is None or n in asked.columns]
    heavy = next((k for k, (n, _) in enumerate(TABLES[asked.table]) if n == "stack"), None)

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], [n for n, _ in fields])

    held, size = [], 0
    for row in some:
        size += len(row[heavy]) if heavy is not None else 0
        row = asked.columns_of(row)
        if row is not None:
            held.append(row)
        if len(held) == 4096 or size >= most_bytes:
            if held:
                yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def _checked(asked: Asked) -> Asked:
    if asked.table not in TABLES:
        raise ValueError(f"no table {asked.table}; there are {', '.join(TABLES)}")
    unknown = set(asked.columns or ()) - {n for n, _ in TABLES[asked.table]}
    if unknown:
        raise ValueError(f"no columns {', '.join(sorted(unknown))} in {asked.table}")
    return asked


def read_recording(spark: SparkSession, path: str, table: str = "samples", columns=None, since: int | None = None, until: int | None = None, pids=None, split_bytes: int = SPLIT_BYTES, whole: bool = False) -> DataFrame:
    """A table of all recordings under path, a row for each record of its kind.

    columns, first and last time, and pids bound what is decoded.  Several tables of
    one path are better read from one `recording_ranges`.
    """
    asked = _checked(Asked(table, None if columns is None else tuple(columns), since, until, None if pids is None else frozenset(pids)))
    if whole:
        return decode_recordings(spark.read.format("binaryFile").load(path).select("path", "content"), table)
    if table in HEAD_TABLES:
        return _read_heads(spark, path, asked)
    return read_ranges(recording_ranges(spark, path, split_bytes), table, columns, since, until, pids)


def _binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path")


def _read_heads(spark: SparkSession, path: str, asked: Asked) -> DataFrame:
    """Tables of what stands around the records, of which none are read."""

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with opened(name) as data:
                    yield from _batches(asked, rows(asked.table, name, data))

    return _binary_files(spark, path).mapInArrow(run, schema(asked.table, asked.columns))


_HEAD = "path string, data_offset long, data_end long"


def _heads(batches):
    for batch in batches:
        names = batch.column(0).to_pylist()
        found = []
        for name in names:
            with opened(name) as data:
                h = D.header(data)
                if h.data_offset + h.data_size > len(data):
                    raise D.FormatError("data section is truncated")
                found.append((name, h.data_offset, h.data_offset + h.data_size))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((_S, _L, _L))], ["path", "data_offset", "data_end"])


MOST_RECORD = 65535


def landings(data, start: int, stop: int, end: int, first: bool) -> list[tuple[int, int, int]]:
    """(entry, landing, records) of every chain of records that begins in [start, stop) and leaves it: where it leaves, after how many records.

    A record has 65,535 bytes at most, so the first record of a range begins among
    as many of its first bytes; each of them is followed by the sizes that stand
    there, until it meets a chain that was followed before.  first: the range is the
    first of its file, and begins with a record.
    """
    land: dict[int, int] = {}
    count: dict[int, int] = {}
    for entry in (start,) if first else range(start, min(stop, start + MOST_RECORD)):
        path, at = [], entry
        while at < stop and at not in land:
            path.append(at)
            size = data[at + 6] | data[at + 7] << 8 if at + 8 <= end else 0
            if size < 8 or at + size > end:
                at = -1
                break
            at += size
        landing, n = (land[at], count[at]) if at in land else (at, 0)
        for p in reversed(path):
            n += 1
            land[p], count[p] = landing, n
    return [(p, land[p], count[p]) for p in ((start,) if first else range(start, min(stop, start + MOST_RECORD))) if land[p] >= 0]


def _scan(batches):
    for batch in batches:
        for name, k, start, stop, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with opened(name) as data:
                found = landings(data, start, stop, end, k == 0)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), _S), pa.array([k] * len(found), _L), *(pa.array([x[i] for x in found], _L) for i in range(3))], ["path", "k", "entry", "landing", "records"])


def _walk(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Chains of a file put together: (path, entry, stop, first), first being the number of the first record."""
    split, at, end = (table.column(c)[0].as_py() for c in ("split", "data_offset", "data_end"))
    steps = {e: (x, n) for e, x, n in zip(*(table.column(c).to_pylist() for c in ("entry", "landing", "records")), strict=True)}
    out, first = [], 0
    while at < end:
        if at not in steps:
            raise D.FormatError(f"no chain of records goes on from offset {at} of {key[0].as_py()}")
        landing, n = steps[at]
        out.append((at, landing, first))
        at, first = landing, first + n
    return pa.table({"path": pa.array([key[0].as_py()] * len(out), _S), **{c: pa.array([x[i] for x in out], _L) for i, c in enumerate(("entry", "stop", "first"))}})


def recording_ranges(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, entry, stop, first): runs of whole records of all recordings under path, and the number of each run's first record.

    A range of bytes is scanned by one task, which tells for each place where a
    record may begin where its chain leaves the range.  Of those places the ones
    stay at which a chain of a range before arrives; the chain from the first record
    through them is the recording, so nothing is guessed.  Files of one range need
    no scan.
    """
    heads = _binary_files(spark, path).mapInArrow(_heads, _HEAD)
    size = F.col("data_end") - F.col("data_offset")
    short = heads.filter((size <= split_bytes) & (size > 0)).select("path", F.col("data_offset").alias("entry"), F.col("data_end").alias("stop"), F.lit(0).cast("long").alias("first"))
    long = heads.filter(size > split_bytes)
    parts = long.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(data_end - data_offset - 1) div {split_bytes}"))))
    start = F.col("data_offset") + F.col("k") * split_bytes
    parts = parts.select("path", "k", start.alias("start"), F.least(start + split_bytes, F.col("data_end")).alias("stop"), "data_end").repartition("path", "k")
    chains = parts.mapInArrow(_scan, "path string, k long, entry long, landing long, records long")
    ends = long.select(F.col("path").alias("f"), "data_offset", "data_end")
    arrive = chains.select("path", F.col("landing").alias("entry")).unionByName(long.select("path", F.col("data_offset").alias("entry"))).distinct()
    met = chains.join(arrive, ["path", "entry"]).join(ends, F.col("path") == F.col("f")).select("path", "entry", "landing", "records", "data_offset", "data_end", F.lit(split_bytes).alias("split"))
    # a row or few a range
    walked = met.groupBy("path").applyInArrow(_walk, "path string, entry long, stop long, first long")
    return short.unionByName(walked)


def read_ranges(ranges: DataFrame, table: str = "samples", columns=None, since: int | None = None, until: int | None = None, pids=None) -> DataFrame:
    """A table of what `recording_ranges` found, a range a task at least; see read_recording."""
    asked = _checked(Asked(table, None if columns is None else tuple(columns), since, until, None if pids is None else frozenset(pids)))

    def run(batches):
        for batch in batches:
            for name, entry, stop, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opened(name) as data:
                    yield from _batches(asked, range_rows(asked, name, data, entry, stop, first))

    return ranges.select("path", "entry", "stop", "first").repartition("path", "entry").mapInArrow(run, schema(table, asked.columns))


def range_rows(asked: Asked, name: str, data, entry: int, stop: int, first: int):
    layouts = D.Layouts(data, D.header(data))
    own = data[entry:stop]
    for k, r in enumerate(D.records(own, D.Header(0, 0, 0, 0, len(own), 0))):
        row = record_row(asked.table, own, r, layouts, (name, first + k), entry, asked)
        if row is not None:
            yield row


def decode_recordings(files: DataFrame, table: str = "samples") -> DataFrame:
    """A table of recordings that are rows (path, content)."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                yield from _batches(Asked(table), rows(table, name.as_py(), content.as_py()))

    return files.select("path", "content").mapInArrow(run, schema(table))


class RecordingSource(DataSource):
    """format("recording"): options path, table, columns, split_bytes, filters; for files that the driver and tasks can open.

    filters=true takes filters over from Spark, which must allow it (spark.sql.python.filterPushdown.enabled).
    """

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        columns = self.options.get("columns")
        return schema(self.options.get("table", "samples"), columns.split(",") if columns else None)

    def reader(self, schema):
        return (_FilteringReader if self.options.get("filters") == "true" else _RangeReader)(self.options)


class _Range(InputPartition):
    def __init__(self, start: int, stop: int, first: int):
        self.start, self.stop, self.first = start, stop, first


class _RangeReader(DataSourceReader):
    """Ranges are cut by the driver, which reads record headers alone; recording_ranges does it by tasks."""

    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))
        columns = options.get("columns")
        self.asked = _checked(Asked(options.get("table", "samples"), tuple(columns.split(",")) if columns else None))
        self.table = self.asked.table

    def partitions(self):
        """Cuts at record boundaries: sizes are read header by header."""
        if self.table in HEAD_TABLES:
            return [_Range(0, 0, 0)]
        out = []
        with open(self.path, "rb") as f:
            h = D.header(f.read(104))
            at, end, start, first, n = h.data_offset, h.data_offset + h.data_size, h.data_offset, 0, 0
            while at < end:
                f.seek(at)
                size = struct.unpack("<IHH", f.read(8))[2]
                if size < 8:
                    raise D.FormatError(f"record at offset {at} has size {size}")
                at += size
                n += 1
                if at - start >= self.split:
                    out.append(_Range(start, at, first))
                    start, first = at, n
        return [*out, _Range(start, end, first)]

    def read(self, part):
        with opened(self.path) as data:
            if part.stop == 0:
                yield from _batches(self.asked, rows(self.table, self.path, data[:]))
            else:
                yield from _batches(self.asked, range_rows(self.asked, self.path, data, part.start, part.stop, part.first))


class _FilteringReader(_RangeReader):
    """Takes over filters on time, pid and record type where they compare with a value, so what fails them is not decoded."""

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if name == "pid" and values is not None and self.table in ("samples", "stacks", "comm", "mappings"):
                self._take("pids", values)
            elif name == "record_type" and values is not None and self.table in ("records", "details"):
                self._take("kinds", values)
            elif name == "time" and isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.value >= 0:
                # times are unsigned; rows with the highest bit would fail the signed comparison, which is left to Spark
                self.asked = replace(self.asked, since=max(self.asked.since or 0, f.value + isinstance(f, GreaterThan)))
                yield f
            elif name == "time" and isinstance(f, (LessThan, LessThanOrEqual)) and f.value >= 0:
                yield f
            else:
                yield f

    def _take(self, what: str, values: set) -> None:
        now = getattr(self.asked, what)
        self.asked = replace(self.asked, **{what: frozenset(values) if now is None else now & values})
