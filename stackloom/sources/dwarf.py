"""Functions and inlined calls of debug information (DWARF 2 to 5) as tables of address intervals.

Debug information is a list of units.  A table of the units' ranges comes first
(`units_of`), read from the units' headers and first entries alone; units that hold
an address asked for are then decoded, each where a task takes it (`functions_of`),
so one large object spreads over tasks and what no sample touches is never read.

Names follow abstract origins and specifications inside a unit, 16 steps at most.
"""

from __future__ import annotations

import mmap
import struct
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.functions.addresses import signed
from stackloom.sources.elf import named_sections

SECTIONS = (".debug_info", ".debug_abbrev", ".debug_str", ".debug_line_str", ".debug_str_offsets", ".debug_addr", ".debug_ranges", ".debug_rnglists")

# fixed values: tags and attributes of the format
SUBPROGRAM, INLINED = 0x2E, 0x1D
NAME, LOW_PC, HIGH_PC, ORIGIN, SPECIFICATION, RANGES, LINKAGE, OLD_LINKAGE = 0x03, 0x11, 0x12, 0x31, 0x47, 0x55, 0x6E, 0x2007
STR_OFFSETS_BASE, ADDR_BASE, RNGLISTS_BASE = 0x72, 0x73, 0x74
#: Bytes of forms of one size; -1: an offset of the unit's format, -2: an address.
SIZES = {
    0x01: -2, 0x05: 2, 0x06: 4, 0x07: 8, 0x0B: 1, 0x0C: 1, 0x0E: -1, 0x11: 1, 0x12: 2, 0x13: 4, 0x14: 8, 0x17: -1, 0x19: 0, 0x1C: 4, 0x1D: -1, 0x1E: 16,
    0x1F: -1, 0x20: 8, 0x21: 0, 0x24: 8, 0x25: 1, 0x26: 2, 0x27: 3, 0x28: 4, 0x29: 1, 0x2A: 2, 0x2B: 3, 0x2C: 4, 0x1F20: -1, 0x1F21: -1,
}
ULEB = (0x0F, 0x15, 0x1A, 0x1B, 0x22, 0x23, 0x1F01, 0x1F02)
INDEXED_STRINGS, INDEXED_ADDRESSES = (0x1A, 0x25, 0x26, 0x27, 0x28, 0x1F02), (0x1B, 0x29, 0x2A, 0x2B, 0x2C, 0x1F01)
UNIT_REFERENCES = (0x11, 0x12, 0x13, 0x14, 0x15)
#: Kinds of range list entries.
END, BASE_X, START_X_END_X, START_X_LENGTH, OFFSET_PAIR, BASE, START_END, START_LENGTH = range(8)


def uleb(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def sleb(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value - (1 << shift) if byte & 64 else value, at


def _text(data: bytes, at: int) -> bytes:
    return data[at : data.index(b"\0", at)]


def abbreviations(data: bytes, at: int) -> dict[int, tuple[int, bool, list[tuple[int, int, int | None]]]]:
    """(tag, has children, [(attribute, form, implicit value)]) of each code of a table."""
    out = {}
    while True:
        code, at = uleb(data, at)
        if not code:
            return out
        tag, at = uleb(data, at)
        children, at, fields = data[at] == 1, at + 1, []
        while True:
            attribute, at = uleb(data, at)
            form, at = uleb(data, at)
            value = None
            if form == 0x21:
                value, at = sleb(data, at)
            if not attribute and not form:
                break
            fields.append((attribute, form, value))
        out[code] = tag, children, fields


def unit_starts(info: bytes):
    """Offsets of the units."""
    at = 0
    while at + 4 <= len(info):
        yield at
        size, = struct.unpack_from("<I", info, at)
        at += 12 + struct.unpack_from("<Q", info, at + 4)[0] if size == 0xFFFFFFFF else 4 + size


class Unit:
    """One unit of a set of sections; values of attributes are read by its own sizes and bases."""

    def __init__(self, sections: dict[str, bytes], start: int):
        self.sections, self.start = sections, start
        info = self.info = sections[".debug_info"]
        size, = struct.unpack_from("<I", info, start)
        self.wide = size == 0xFFFFFFFF
        at = start + (12 if self.wide else 4)
        self.end = at + (struct.unpack_from("<Q", info, start + 4)[0] if self.wide else size)
        self.offset_size = 8 if self.wide else 4
        self.version, = struct.unpack_from("<H", info, at)
        at += 2
        kind = 1
        if self.version >= 5:
            kind, self.address_size = info[at], info[at + 1]
            table, at = self._offset(at + 2), at + 2 + self.offset_size
            at += 8 if kind in (4, 5) else 8 + self.offset_size if kind in (2, 6) else 0
        else:
            table, at = self._offset(at), at + self.offset_size
            self.address_size, at = info[at], at + 1
        if not 2 <= self.version <= 5 or self.address_size not in (4, 8):
            raise ValueError(f"unit at {start} has version {self.version}")
        self.first = at
        self.abbreviations = abbreviations(sections[".debug_abbrev"], table)
        self.sizes = {k: self.address_size if v == -2 else self.offset_size if v == -1 else v for k, v in SIZES.items()}
        # a reference to an entry of another unit had an address's size once
        self.sizes[0x10] = self.address_size if self.version == 2 else self.offset_size
        self.plain = {}
        for code, (_, _, fields) in self.abbreviations.items():
            known = [self.sizes.get(f) for _, f, _ in fields]
            self.plain[code] = None if None in known else sum(known)
        # entries that follow are looked up by these, which the first entry has
        self.bases = {STR_OFFSETS_BASE: 8 if not self.wide else 16, ADDR_BASE: 8 if not self.wide else 16, RNGLISTS_BASE: None}
        self.base = 0
        head, _ = self.entry(at)
        self.bases |= {k: head[k][1] for k in self.bases if k in head}
        self.head = head
        low = self.address(head.get(LOW_PC))
        self.base = low or 0

    def _offset(self, at: int) -> int:
        return struct.unpack_from("<Q" if self.wide else "<I", self.info, at)[0]

    def skip(self, form: int, at: int) -> int:
        size = self.sizes.get(form)
        info = self.info
        if size is not None:
            return at + size
        if form in ULEB or form == 0x0D:
            while info[at] > 127:
                at += 1
            return at + 1
        if form == 0x08:
            return info.index(b"\0", at) + 1
        if form in (0x09, 0x18):
            n, at = uleb(info, at)
            return at + n
        if form == 0x0A:
            return at + 1 + info[at]
        if form == 0x03:
            return at + 2 + struct.unpack_from("<H", info, at)[0]
        if form == 0x04:
            return at + 4 + struct.unpack_from("<I", info, at)[0]
        if form == 0x16:
            inner, at = uleb(info, at)
            return self.skip(inner, at)
        raise ValueError(f"form {form:#x} in unit at {self.start} is unknown")

    def value(self, form: int, at: int) -> int:
        """A number, or the place of what is no number."""
        if form == 0x16:
            form, at = uleb(self.info, at)
        if form in ULEB:
            return uleb(self.info, at)[0]
        if form == 0x0D:
            return sleb(self.info, at)[0]
        size = self.sizes.get(form, 0)
        return int.from_bytes(self.info[at : at + size], "little") if 0 < size <= 8 else at

    def entry(self, at: int) -> tuple[dict[int, tuple[int, int]], int]:
        """{attribute: (form, value)} of the entry at `at`, and where it ends."""
        code, at = uleb(self.info, at)
        out = {}
        for attribute, form, implicit in self.abbreviations[code][2] if code else ():
            if form == 0x16:
                inner, body = uleb(self.info, at)
                out[attribute] = inner, self.value(inner, body)
            else:
                out[attribute] = form, implicit if implicit is not None else self.value(form, at)
            at = self.skip(form, at)
        return out, at

    def text(self, field: tuple[int, int] | None) -> str | None:
        if field is None:
            return None
        form, value = field
        s, none = self.sections, b""
        try:
            if form == 0x08:
                raw = _text(self.info, value)
            elif form == 0x0E:
                raw = _text(s.get(".debug_str", none), value)
            elif form == 0x1F:
                raw = _text(s.get(".debug_line_str", none), value)
            elif form in INDEXED_STRINGS:
                at = self.bases[STR_OFFSETS_BASE] + value * self.offset_size
                raw = _text(s.get(".debug_str", none), int.from_bytes(s[".debug_str_offsets"][at : at + self.offset_size], "little"))
            else:
                return None
        except (ValueError, KeyError):
            return None
        return raw.decode("utf-8", "replace")

    def indexed_address(self, value: int) -> int:
        at = self.bases[ADDR_BASE] + value * self.address_size
        return int.from_bytes(self.sections.get(".debug_addr", b"")[at : at + self.address_size], "little")

    def address(self, field: tuple[int, int] | None) -> int | None:
        if field is None:
            return None
        form, value = field
        return value if form == 0x01 else self.indexed_address(value) if form in INDEXED_ADDRESSES else None

    def ranges(self, e: dict[int, tuple[int, int]]) -> list[tuple[int, int]]:
        """Address ranges [low, high) of an entry."""
        if RANGES in e:
            form, value = e[RANGES]
            found = self._old_list(value) if self.version < 5 else self._list(form, value)
            return [(a, b) for a, b in found if a < b]
        low = self.address(e.get(LOW_PC))
        if low is None or HIGH_PC not in e:
            return []
        high = self.address(e[HIGH_PC])
        # a number there is a size
        high = low + e[HIGH_PC][1] if high is None else high
        return [(low, high)] if low < high else []

    def _old_list(self, at: int):
        data, n, base = self.sections.get(".debug_ranges", b""), self.address_size, self.base
        highest = (1 << 8 * n) - 1
        while at + 2 * n <= len(data):
            a, b = (int.from_bytes(data[at + k : at + k + n], "little") for k in (0, n))
            at += 2 * n
            if a == highest:
                base = b
            elif a or b:
                yield a + base & highest, b + base & highest
            else:
                return

    def _list(self, form: int, value: int):
        data, n, base = self.sections.get(".debug_rnglists", b""), self.address_size, self.base
        at = value
        if form == 0x23:
            start = self.bases[RNGLISTS_BASE]
            start = (20 if self.wide else 12) if start is None else start
            place = start + value * self.offset_size
            at = start + int.from_bytes(data[place : place + self.offset_size], "little")
        address = lambda p: int.from_bytes(data[p : p + n], "little")
        while at < len(data):
            kind, at = data[at], at + 1
            if kind == END:
                return
            if kind == BASE_X:
                x, at = uleb(data, at)
                base = self.indexed_address(x)
            elif kind == BASE:
                base, at = address(at), at + n
            elif kind == START_END:
                yield address(at), address(at + n)
                at += 2 * n
            elif kind == START_LENGTH:
                low, at = address(at), at + n
                size, at = uleb(data, at)
                yield low, low + size
            else:
                a, at = uleb(data, at)
                b, at = uleb(data, at)
                if kind == OFFSET_PAIR:
                    yield base + a, base + b
                elif kind == START_X_END_X:
                    yield self.indexed_address(a), self.indexed_address(b)
                elif kind == START_X_LENGTH:
                    yield self.indexed_address(a), self.indexed_address(a) + b
                else:
                    return

    def name(self, e: dict[int, tuple[int, int]], attributes=(NAME,), steps: int = 16) -> str | None:
        """An entry's name, or that of the entries that it stands for."""
        for k in attributes:
            if (own := self.text(e.get(k))) is not None:
                return own
        if not steps:
            return None
        for k in (ORIGIN, SPECIFICATION):
            form, value = e.get(k, (0, 0))
            if form in UNIT_REFERENCES and self.first <= self.start + value < self.end:
                found = self.name(self.entry(self.start + value)[0], attributes, steps - 1)
                if found is not None:
                    return found
        return None

    def functions(self):
        """(entry, end of what it holds, depth, inlined, low, high, name, linkage name) of every range of a function or inlined call.

        Entries are numbered by their offsets, which go up in the order of the
        tree; depth counts the functions and inlined calls around one.
        """
        info, table, plain = self.info, self.abbreviations, self.plain
        at, open_, held, depth = self.first, [], {}, 0
        while at < self.end:
            start = at
            code = info[at]
            if code > 127:
                code, at = uleb(info, at)
            else:
                at += 1
            if not code:
                if not open_:
                    break
                row = open_.pop()
                if row is not None:
                    depth -= 1
                    yield from ((row[0], at, *row[1:3], a, b, *row[3:]) for a, b in held.pop(row[0]))
                continue
            tag, children, fields = table[code]
            row = None
            if tag == SUBPROGRAM or tag == INLINED:
                e, at = self.entry(start)
                ranges = self.ranges(e)
                if ranges:
                    row = start, depth, tag == INLINED, self.name(e), self.name(e, (LINKAGE, OLD_LINKAGE))
                    held[start] = ranges
            elif plain[code] is not None:
                at += plain[code]
            else:
                for _, form, _ in fields:
                    at = self.skip(form, at)
            if children:
                open_.append(row)
                depth += row is not None
            elif row is not None:
                yield from ((row[0], at, *row[1:3], a, b, *row[3:]) for a, b in held.pop(start))


def sections_of(data: bytes) -> dict[str, bytes]:
    return {k: v for k, (_, v) in named_sections(data, *SECTIONS).items()}


def _open(name: str) -> dict[str, bytes]:
    if not Path(name).stat().st_size:
        return {}
    with open(name, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
        return sections_of(data)


_UNITS = pa.schema([("object", pa.string()), ("unit", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
_FUNCTIONS = pa.schema([("object", pa.string()), ("unit", pa.int64()), ("die", pa.int64()), ("until", pa.int64()), ("depth", pa.int32()), ("inlined", pa.bool_()), ("low", pa.int64()), ("high", pa.int64()), ("name", pa.string()), ("linkage", pa.string())])
_SQL = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def _batches(rows, schema: pa.Schema, most: int = 8192):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def unit_ranges(name: str, sections: dict[str, bytes]):
    """(object, unit, low, high) of the ranges that units state; a unit that cannot be read has none."""
    if {".debug_info", ".debug_abbrev"} - sections.keys():
        return
    for start in unit_starts(sections[".debug_info"]):
        try:
            u = Unit(sections, start)
            found = u.ranges(u.head)
        except (ValueError, KeyError, IndexError, struct.error):
            continue
        for low, high in found:
            yield name, start, signed(low), signed(high)


def unit_functions(name: str, sections: dict[str, bytes], start: int):
    """Rows of functions_of for one unit, as far as it can be read."""
    try:
        for die, until, depth, inlined, low, high, own, linkage in Unit(sections, start).functions():
            yield name, start, die, until, depth, inlined, signed(low), signed(high), own, linkage
    except (ValueError, KeyError, IndexError, struct.error):
        return


def units_of(objects: DataFrame) -> DataFrame:
    """(object, unit, low, high): address ranges of the units of the files that the column `object` names."""

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                yield from _batches(unit_ranges(name, _open(name)), _UNITS)

    return objects.select("object").filter("object is not null").distinct().mapInArrow(run, _ddl(_UNITS))


def functions_of(units: DataFrame) -> DataFrame:
    """(object, unit, die, until, depth, inlined, low, high, name, linkage) of distinct units (object, unit).

    die and until: the span of entries in a unit that a function holds, which says what lies within what.
    """

    def run(batches):
        now, sections = None, {}
        for batch in batches:
            for name, start in sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if name != now:
                    now, sections = name, _open(name)
                yield from _batches(unit_functions(name, sections, start), _FUNCTIONS)

    # units of one object go to many tasks
    return units.select("object", "unit").distinct().repartition(F.col("object"), F.col("unit")).sortWithinPartitions("object").mapInArrow(run, _ddl(_FUNCTIONS))
