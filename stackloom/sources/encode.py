"""Writing binary recordings: the layout that decode reads, for all record types, several events and build ids."""

from __future__ import annotations

import struct

from stackloom.sources import decode as D

#: What the samples written here hold, in the order of the format.
SAMPLE_FIELDS = ("TID", "TIME", "PERIOD", "CALLCHAIN")
_ATTR = 128


def _unsigned(x: int) -> int:
    return x & 0xFFFFFFFFFFFFFFFF


def _record(kind: int, payload: bytes, misc: int = 0) -> bytes:
    payload += b"\0" * (-len(payload) % 8)
    return struct.pack("<IHH", kind, misc, 8 + len(payload)) + payload


def sample(pid: int, tid: int, time: int, period: int, chain: list[int], cpumode: int = 2) -> bytes:
    body = struct.pack("<IIQQQ", pid, tid, _unsigned(time), _unsigned(period), len(chain))
    return _record(9, body + struct.pack(f"<{len(chain)}Q", *map(_unsigned, chain)), cpumode)


def comm(pid: int, tid: int, name: str, is_exec: bool, time: int) -> bytes:
    """A thread name, with the id fields that tell its time behind it."""
    text = name.encode() + b"\0"
    text += b"\0" * (-(len(text)) % 8)
    return _record(3, struct.pack("<II", pid, tid) + text + struct.pack("<IIQ", pid, tid, _unsigned(time)), D.EXEC_MISC if is_exec else 0)


def _text(x: str) -> bytes:
    raw = x.encode() + b"\0"
    return raw + b"\0" * (-len(raw) % 8)


def other(kind: int, pid: int, tid: int, time: int, misc: int = 0, form: str = "", *numbers: int, text: str | None = None) -> bytes:
    """A record of any other type: numbers as `form` has them, a text, and the id fields that tell its time behind it."""
    body = struct.pack("<" + form, *numbers) + (b"" if text is None else _text(text))
    return struct.pack("<IHH", kind, misc, 8 + len(body) + 16) + body + struct.pack("<IIQ", pid, tid, _unsigned(time))


def build_id(pid: int, ident: bytes, path: str) -> bytes:
    """An entry of the build-id feature."""
    name = _text(path)
    return struct.pack("<IHHI", 67, 0, 36 + len(name), pid) + ident[:20].ljust(20, b"\0") + b"\0" * 4 + name


def recording(records: list[bytes], ids: tuple[tuple[int, ...], ...] = ((),), build_ids: bytes = b"") -> bytes:
    """A file of one event for each tuple of ids."""
    place = 104 + len(ids) * (_ATTR + 16)
    head, listed = b"", b""
    for own in ids:
        attr = bytearray(_ATTR)
        struct.pack_into("<I", attr, 4, _ATTR)
        struct.pack_into("<Q", attr, 24, sum(D.BIT[x] for x in SAMPLE_FIELDS))
        struct.pack_into("<Q", attr, 40, D.SAMPLE_ID_ALL)
        head += bytes(attr) + struct.pack("<QQ", place + len(listed), 8 * len(own))
        listed += struct.pack(f"<{len(own)}Q", *own)
    data = b"".join(records)
    start = place + len(listed)
    feature = 4 if build_ids else 0
    tail = struct.pack("<QQ", start + len(data) + 16, len(build_ids)) + build_ids if build_ids else b""
    front = D.MAGIC + struct.pack("<QQQQQQQ", 104, 0, 104, len(head), start, len(data), feature)
    return front.ljust(104, b"\0") + head + listed + data + tail


def elf_object(symbols: list[tuple[str, int, int, int, int]], loads: list[tuple[int, int, int]]) -> bytes:
    """A 64-bit ELF object: symbols (name, type and binding, section, address, size) and load segments (offset, size, address)."""
    names, table = b"\0", b"\0" * 24
    for name, info, section, address, size in symbols:
        table += struct.pack("<IBBHQQ", len(names), info, 0, section, _unsigned(address), size)
        names += name.encode() + b"\0"
    head = b"".join(struct.pack("<IIQQQQQQ", 1, 5, offset, _unsigned(address), _unsigned(address), size, size, 0) for offset, size, address in loads)
    place = 64 + len(head)
    # an empty section, the symbols, their names
    rows = b"\0" * 64 + struct.pack("<IIQQQQIIQQ", 0, 2, 0, 0, place, len(table), 2, 0, 8, 24) + struct.pack("<IIQQQQIIQQ", 0, 3, 0, 0, place + len(table), len(names), 0, 0, 1, 0)
    front = b"\x7fELF\2\1\1".ljust(16, b"\0") + struct.pack("<HHIQQQIHHHHHH", 3, 62, 1, 0, 64, place + len(table) + len(names), 0, 64, 56, len(loads), 64, 3, 0)
    return front + head + table + names + rows
