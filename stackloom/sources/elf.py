"""64-bit little-endian ELF objects: symbols, load segments, debug strings.

Objects come through Spark's binary reader, or as paths that the executors can
open, and are decoded where they are read.
"""

from __future__ import annotations

import mmap
import re
import struct
import zlib
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.functions.addresses import signed
from stackloom.functions.names import normal_debug_name

_TEXT = re.compile(rb"[^\0]+")
_KINDS = {0: "label", 1: "data", 2: "text", 3: "section", 4: "file", 6: "tls"}


def _sections(data: bytes):
    if data[:4] != b"\x7fELF" or data[4:6] != b"\x02\x01":
        return
    offset, = struct.unpack_from("<Q", data, 40)
    size, count = struct.unpack_from("<HH", data, 58)
    for k in range(count):
        yield struct.unpack_from("<IIQQQQIIQQ", data, offset + k * size)


def named_sections(data: bytes, *names: str) -> dict[str, tuple[int, bytes]]:
    """(address, content) of the sections with these names, unpacked where they are compressed; others are left out."""
    sections = list(_sections(data))
    if not sections:
        return {}
    texts, = struct.unpack_from("<H", data, 62)
    start, out = sections[texts][4], {}
    for s in sections:
        at = start + s[0]
        name = bytes(data[at : data.find(b"\0", at)]).decode("utf-8", "replace")
        if name not in names or name in out or s[1] == 8:
            continue
        content = bytes(data[s[4] : s[4] + s[5]])
        if s[2] & 0x800:
            kind, _, size = struct.unpack_from("<IIQ", content)
            content = _unpacked(kind, content[24:], size)
        out[name] = s[3], content
    return out


def _unpacked(kind: int, content: bytes, size: int) -> bytes:
    if kind == 1:
        return zlib.decompress(content)
    if kind == 2:
        return pa.decompress(content, size, "zstd", asbytes=True)
    raise ValueError(f"compression {kind} of a section is unknown")


def symbols(data: bytes):
    """(seq, name, kind, binding, defined, address, size) of the symbol table; the dynamic one stands in where there is none."""
    sections = list(_sections(data))
    tables = [s for s in sections if s[1] == 2] or [s for s in sections if s[1] == 11]
    seq = 0
    for s in tables:
        names = sections[s[6]]
        for at in range(s[4] + 24, s[4] + s[5], 24):
            name, info, _, section, value, size = struct.unpack_from("<IBBHQQ", data, at)
            start = names[4] + name
            text = data[start : data.find(b"\0", start)].decode("utf-8", "replace")
            kind = "text" if info & 15 == 10 else _KINDS.get(info & 15, "unknown")
            yield seq, text, kind, {0: "local", 1: "global", 2: "weak"}.get(info >> 4, "other"), section != 0, value, size
            seq += 1


def segments(data: bytes):
    """(seq, file offset, file size, address) of the load segments."""
    if data[:4] != b"\x7fELF" or data[4:6] != b"\x02\x01":
        return
    offset, = struct.unpack_from("<Q", data, 32)
    size, count = struct.unpack_from("<HH", data, 54)
    seq = 0
    for k in range(count):
        kind, _, at, address, _, length, _, _ = struct.unpack_from("<IIQQQQQQ", data, offset + k * size)
        if kind == 1:
            yield seq, at, length, address
            seq += 1


_SYMBOLS = {"object": pa.string(), "seq": pa.int64(), "name": pa.string(), "kind": pa.string(), "binding": pa.string(), "defined": pa.bool_(), "addr": pa.int64(), "size": pa.int64()}
_SEGMENTS = {"object": pa.string(), "seq": pa.int64(), "file_offset": pa.int64(), "file_size": pa.int64(), "addr": pa.int64()}
_SQL = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean"}


def _symbol_rows(data):
    return ((*x[:5], signed(x[5]), signed(x[6])) for x in symbols(data))


def _segment_rows(data):
    return ((s, signed(a), signed(n), signed(v)) for s, a, n, v in segments(data))


def _batches(name: str, rows, columns: dict, most: int = 8192):
    """Batches of a bounded number of rows, each with the object's name in front."""
    held = []
    for row in rows:
        held.append((name, *row))
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), columns.values(), strict=True)], list(columns))
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), columns.values(), strict=True)], list(columns))


def _schema(columns: dict) -> str:
    return ", ".join(f"{k} {_SQL[t]}" for k, t in columns.items())


def _table(files: DataFrame, columns: dict, some) -> DataFrame:
    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                yield from _batches(name.as_py(), some(content.as_py()), columns)

    return files.select("path", "content").mapInArrow(run, _schema(columns))


def decode_symbols(files: DataFrame) -> DataFrame:
    """Symbols of objects that are rows (path, content)."""
    return _table(files, _SYMBOLS, _symbol_rows)


def decode_segments(files: DataFrame) -> DataFrame:
    return _table(files, _SEGMENTS, _segment_rows)


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    return decode_symbols(spark.read.format("binaryFile").load(path))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return decode_segments(spark.read.format("binaryFile").load(path))


def _opened(objects: DataFrame, columns: dict, some) -> DataFrame:
    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                if Path(name).stat().st_size:
                    with open(name, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
                        yield from _batches(name, some(data), columns)

    return objects.select("object").filter("object is not null").distinct().mapInArrow(run, _schema(columns))


def symbols_of(objects: DataFrame) -> DataFrame:
    """read_symbols for the files that the column `object` names, mapped into memory where they are."""
    return _opened(objects, _SYMBOLS, _symbol_rows)


def segments_of(objects: DataFrame) -> DataFrame:
    return _opened(objects, _SEGMENTS, _segment_rows)


def _strings(name: str, start: int, stop: int):
    """Texts between zero bytes that begin in a range and may name a specialised function."""
    with open(name, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
        if start and data[start - 1]:
            start = data.find(b"\0", start)
            start = len(data) if start < 0 else start
        for m in _TEXT.finditer(data, start):
            if m.start() >= stop:
                return
            raw = m[0]
            if 4 <= len(raw) <= 4096 and b"<" in raw:
                try:
                    yield (raw.decode(),)
                except UnicodeDecodeError:
                    continue


def debug_strings(objects: DataFrame, range_bytes: int = 64 << 20) -> DataFrame:
    """object, leaf, name: the one specialised name of each function leaf in the files that the column `object` names; leaves with several names are left out.

    A task searches a range of a file, mapped into memory; a text belongs to the range in which it begins.
    """
    columns = {"object": pa.string(), "raw": pa.string()}

    def cut(batches):
        for batch in batches:
            rows = [(n, at) for n in batch.column(0).to_pylist() for at in range(0, Path(n).stat().st_size, range_bytes)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.string()), pa.array([at for _, at in rows], pa.int64())], ["object", "at"])

    def run(batches):
        for batch in batches:
            for name, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _batches(name, _strings(name, at, at + range_bytes), columns)

    ranges = objects.select("object").filter("object is not null").distinct().mapInArrow(cut, "object string, at long").repartition("object", "at")
    raw = ranges.mapInArrow(run, "object string, raw string").distinct().withColumn("name", normal_debug_name("raw"))
    leaf = F.regexp_extract("name", "(?s)^([^< (]+)<", 1)
    named = raw.withColumn("leaf", leaf).filter("leaf <> ''")
    return named.groupBy("object", "leaf").agg(F.min("name").alias("name"), F.max("name").alias("other")).filter("name = other").drop("other")
