"""Call frame information of 64-bit x86 objects: how to step from a frame to its caller.

Entries for functions are listed once for an object, by address; the instructions
of an entry are followed once, when a stack first meets it, and give rows of the
object's table: from an address on, where the caller's frame begins (a register and
an offset), and where the return address and the saved frame pointer are.
"""

from __future__ import annotations

import mmap
import struct
from pathlib import Path

import numpy as np

from stackloom.sources.dwarf import sleb, uleb
from stackloom.sources.elf import named_sections, segments

BP, SP, RETURN = 6, 7, 16
#: Registers that a row's frame may be counted from, beside SP and BP: none known, and that of a stub of the linkage table.
UNKNOWN, STUB = -1, -2
#: Fixed value: the expression by which linkers describe stubs of the linkage table.
STUB_EXPRESSION = bytes.fromhex("77088000 3f1a3b2a332422")
#: A row: first address, register and offset of the frame, is there a return address and where, is the frame pointer saved and where.
ROW = np.dtype([("low", "<u8"), ("register", "i4"), ("offset", "i8"), ("returns", "?"), ("return_at", "i8"), ("saved", "i1"), ("saved_at", "i8")])
_SIZES = {2: "<H", 3: "<I", 4: "<Q", 10: "<h", 11: "<i", 12: "<q"}
_BIG = 1 << 64


def _pointer(data: bytes, at: int, encoding: int, address: int) -> tuple[int, int]:
    """A pointer as its encoding says, and the place behind it; address: where `data` begins when loaded."""
    here, form = address + at, encoding & 15
    if form == 0:
        value, at = struct.unpack_from("<Q", data, at)[0], at + 8
    elif form == 1:
        value, at = uleb(data, at)
    elif form == 9:
        value, at = sleb(data, at)
    else:
        kind = _SIZES[form]
        value, at = struct.unpack_from(kind, data, at)[0], at + struct.calcsize(kind)
    base = {0: 0, 0x10: here}.get(encoding & 0x70)
    if base is None or encoding & 0x80:
        raise ValueError(f"pointer encoding {encoding:#x} is not read")
    return (value + base) % _BIG, at


class _Common:
    """What the entries of many functions share."""

    def __init__(self, data: bytes, at: int, end: int, address: int):
        version = data[at]
        self.end, self.encoding = end, 0
        stop = data.index(b"\0", at + 1)
        extra = data[at + 1 : stop].decode("latin-1")
        at = stop + 1
        if version >= 4:
            at += 2
        self.code, at = uleb(data, at)
        self.data, at = sleb(data, at)
        self.register, at = (data[at], at + 1) if version == 1 else uleb(data, at)
        self.sized = extra.startswith("z")
        if self.sized:
            size, at = uleb(data, at)
            self.first, place = at + size, at
            for c in extra[1:]:
                if c == "R":
                    self.encoding, place = data[place], place + 1
                elif c == "L":
                    place += 1
                elif c == "P":
                    form = data[place]
                    place = _pointer(data, place + 1, form & 15, address)[1]
                elif c not in "SBG":
                    break
        else:
            self.first = at


class _State:
    def __init__(self):
        self.frame: tuple[int, int] = (UNKNOWN, 0)
        self.rules: dict[int, tuple[str, int]] = {}

    def copy(self) -> _State:
        out = _State()
        out.frame, out.rules = self.frame, dict(self.rules)
        return out


class Entries:
    """The functions of a section, ascending: low and high address; their rows are made when asked for."""

    def __init__(self, data: bytes, address: int, debug: bool = False):
        self.data, self.address = data, address
        common: dict[int, _Common] = {}
        found = []
        at = 0
        while at + 4 <= len(data):
            start = at
            size, = struct.unpack_from("<I", data, at)
            at += 4
            wide = size == 0xFFFFFFFF
            if wide:
                size, = struct.unpack_from("<Q", data, at)
                at += 8
            if not size:
                if debug:
                    continue
                break
            end = at + size
            kind = "<Q" if wide else "<I"
            owner, = struct.unpack_from(kind, data, at)
            body = at + struct.calcsize(kind)
            try:
                if owner == ((_BIG - 1 if wide else 0xFFFFFFFF) if debug else 0):
                    common[start] = _Common(data, body, end, address)
                else:
                    c = common[owner if debug else at - owner]
                    low, p = _pointer(data, body, c.encoding, address)
                    n, p = _pointer(data, p, c.encoding & 15, address)
                    if c.sized:
                        extra, p = uleb(data, p)
                        p += extra
                    if n:
                        found.append((low, low + n, p, end, c))
            except (KeyError, ValueError, IndexError, struct.error):
                pass
            at = end
        found.sort(key=lambda f: f[0])
        self.found = found
        self.low, self.high = (np.array([f[k] for f in found], np.uint64) for k in (0, 1))
        self.rows = np.zeros(0, ROW)
        self.made: dict[int, np.ndarray] = {}

    def rows_at(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, known): the row for each address, and whether there is one."""
        k = np.searchsorted(self.low, at, "right") - 1
        known = k >= 0
        known[known] = at[known] < self.high[k[known]]
        new = [i for i in np.unique(k[known]).tolist() if i not in self.made]
        if new:
            for i in new:
                self.made[i] = self._rows(i)
            self.rows = np.concatenate([self.made[i] for i in sorted(self.made)])
        out = np.zeros(len(at), ROW)
        if known.any():
            out[known] = self.rows[np.searchsorted(self.rows["low"], at[known], "right") - 1]
        return out, known & (out["register"] != UNKNOWN)

    def _rows(self, i: int) -> np.ndarray:
        low, high, at, end, c = self.found[i]
        state, out = _State(), []
        try:
            self._follow(c.first, c.end, c, state, None, low, [])
            for place, now in self._follow(at, end, c, state, state.copy(), low, []):
                out.append(self._row(place, now, c))
        except (ValueError, IndexError, KeyError, struct.error):
            out = [(low, UNKNOWN, 0, False, 0, 0, 0)]
        rows = np.array(out, ROW)
        # of rows for one address the last holds
        last = np.append(rows["low"][1:] != rows["low"][:-1], True)
        return rows[last & (rows["low"] < high)]

    @staticmethod
    def _row(place: int, s: _State, c: _Common) -> tuple:
        register, offset = s.frame
        how, value = s.rules.get(c.register, ("none", 0))
        saved, saved_at = s.rules.get(BP, ("same", 0))
        if register not in (SP, BP, STUB) or how not in ("at", "none") or saved not in ("at", "same", "none"):
            return place, UNKNOWN, 0, False, 0, 0, 0
        return place, register, offset, how == "at", value, int(saved == "at"), saved_at

    def _follow(self, at: int, end: int, c: _Common, s: _State, first: _State | None, place: int, stack: list):
        """Follows instructions; a list of (address, state) where first is given."""
        data, out = self.data, []
        while at < end:
            op = data[at]
            at += 1
            high, low = op >> 6, op & 63
            if high == 1:
                out.append((place, s.copy()))
                place += low * c.code
            elif high == 2:
                n, at = uleb(data, at)
                s.rules[low] = "at", n * c.data
            elif high == 3:
                self._restore(s, first, low)
            elif op in (1, 2, 3, 4):
                out.append((place, s.copy()))
                if op == 1:
                    place, at = _pointer(data, at, c.encoding, self.address)
                else:
                    kind = {2: "<B", 3: "<H", 4: "<I"}[op]
                    place += struct.unpack_from(kind, data, at)[0] * c.code
                    at += struct.calcsize(kind)
            elif op in (5, 0x11, 0x2F):
                r, at = uleb(data, at)
                n, at = sleb(data, at) if op == 0x11 else uleb(data, at)
                s.rules[r] = "at", -n * c.data if op == 0x2F else n * c.data
            elif op == 6:
                r, at = uleb(data, at)
                self._restore(s, first, r)
            elif op in (7, 8):
                r, at = uleb(data, at)
                s.rules[r] = ("none" if op == 7 else "same"), 0
            elif op == 9:
                r, at = uleb(data, at)
                _, at = uleb(data, at)
                s.rules[r] = "register", 0
            elif op == 10:
                stack.append(s.copy())
            elif op == 11:
                kept = stack.pop()
                s.frame, s.rules = kept.frame, kept.rules
            elif op in (12, 0x12):
                r, at = uleb(data, at)
                n, at = uleb(data, at) if op == 12 else sleb(data, at)
                s.frame = r, n if op == 12 else n * c.data
            elif op == 13:
                r, at = uleb(data, at)
                s.frame = r, s.frame[1]
            elif op in (14, 0x13):
                n, at = uleb(data, at) if op == 14 else sleb(data, at)
                s.frame = s.frame[0], n if op == 14 else n * c.data
            elif op == 15:
                n, at = uleb(data, at)
                s.frame = (STUB if data[at : at + n] == STUB_EXPRESSION else UNKNOWN), 0
                at += n
            elif op in (16, 22):
                r, at = uleb(data, at)
                n, at = uleb(data, at)
                s.rules[r], at = ("expression", 0), at + n
            elif op in (0x14, 0x15):
                r, at = uleb(data, at)
                n, at = uleb(data, at) if op == 0x14 else sleb(data, at)
                s.rules[r] = "value", n
            elif op == 0x2E:
                _, at = uleb(data, at)
            elif op not in (0, 0x2D):
                raise ValueError(f"frame instruction {op:#x} is unknown")
        out.append((place, s.copy()))
        return out if first is not None else []

    @staticmethod
    def _restore(s: _State, first: _State | None, r: int) -> None:
        s.rules.pop(r, None)
        if first is not None and r in first.rules:
            s.rules[r] = first.rules[r]


class Frames:
    """The frame table of an object, by file offset."""

    def __init__(self, data: bytes):
        found = named_sections(data, ".eh_frame", ".debug_frame")
        self.parts = [Entries(found[k][1], found[k][0], k == ".debug_frame") for k in (".eh_frame", ".debug_frame") if k in found]
        loads = sorted((at, size, address) for _, at, size, address in segments(data))
        self.offsets, self.sizes, self.addresses = (np.array([x[k] for x in loads], np.uint64) for k in range(3))

    def rows_at(self, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, known) for offsets in the file; an offset in no load segment is an address itself."""
        at = offsets.copy()
        if len(self.offsets):
            k = np.searchsorted(self.offsets, offsets, "right") - 1
            inside = k >= 0
            inside[inside] = offsets[inside] - self.offsets[k[inside]] < self.sizes[k[inside]]
            at[inside] = offsets[inside] - self.offsets[k[inside]] + self.addresses[k[inside]]
        rows, known = np.zeros(len(at), ROW), np.zeros(len(at), bool)
        for part in self.parts:
            rest = np.flatnonzero(~known)
            if len(rest) and len(part.low):
                r, k = part.rows_at(at[rest])
                rows[rest[k]], known[rest[k]] = r[k], True
        return rows, known


_OPEN: dict[tuple, Frames | None] = {}


def frames_of(name: str) -> Frames | None:
    """The table of a file, kept by the process while the file is the same; None if it cannot be read."""
    try:
        stat = Path(name).stat()
        key = name, stat.st_ino, stat.st_size, stat.st_mtime_ns
        if key not in _OPEN:
            if len(_OPEN) >= 64:
                _OPEN.pop(next(iter(_OPEN)))
            with open(name, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
                _OPEN[key] = Frames(data) if data[:4] == b"\x7fELF" else None
        return _OPEN[key]
    except (OSError, ValueError, IndexError, struct.error):
        return None
