"""An encoder of small ELF objects: symbols, debug information and call frame information, from the layouts of the formats."""

import struct


def uleb(x):
    out = b""
    while True:
        out += bytes([x & 127 | (128 if x > 127 else 0)])
        x >>= 7
        if not x:
            return out


def sleb(x):
    out = b""
    while True:
        byte, x = x & 127, x >> 7
        done = x in (0, -1) and (byte & 64 > 0) == (x == -1)
        out += bytes([byte if done else byte | 128])
        if done:
            return out


def elf(sections=(), symbols=(), loads=((0, 0x10000, 0),)):
    """sections: (name, address, content); symbols: (name, address, size[, info]); loads: (offset, size, address)."""
    names, table = b"\0", b"\0" * 24
    for name, address, size, *info in symbols:
        table += struct.pack("<IBBHQQ", len(names), info[0] if info else 0x12, 0, 1, address, size)
        names += name.encode() + b"\0"
    parts = [("", 0, 0, b"", 0, 0), (".symtab", 2, 0, table, 2, 24), (".strtab", 3, 0, names, 0, 0)]
    parts += [(n, 1, a, c, 0, 0) for n, a, c in sections]
    texts, at = b"", []
    for p in [*parts, (".shstrtab",)]:
        at.append(len(texts))
        texts += p[0].encode() + b"\0"
    parts.append((".shstrtab", 3, 0, texts, 0, 0))
    head = b"".join(struct.pack("<IIQQQQQQ", 1, 5, o, a, a, n, n, 0) for o, n, a in loads)
    body, place, rows = b"", 64 + len(head), []
    for (_, kind, address, content, link, entry), name in zip(parts, at, strict=True):
        rows.append(struct.pack("<IIQQQQIIQQ", name, kind, 0, address, place + len(body), len(content), link, 0, 1, entry))
        body += content
    start = b"\x7fELF\2\1\1" + b"\0" * 9 + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, 0, 64, place + len(body), 0, 64, 56, len(loads), 64, len(rows), len(rows) - 1)
    return start + head + body + b"".join(rows)


# entries of debug information: (tag, [(attribute, form, bytes)], children)
COMPILE_UNIT, SUBPROGRAM, INLINED, BLOCK, NAMESPACE = 0x11, 0x2E, 0x1D, 0x0B, 0x39


def name(text):
    return 0x03, 0x08, text.encode() + b"\0"


def linkage(text):
    return 0x6E, 0x08, text.encode() + b"\0"


def at(low, high):
    return (0x11, 0x01, struct.pack("<Q", low)), (0x12, 0x06, struct.pack("<I", high - low))


def ranges(place):
    return 0x55, 0x17, struct.pack("<I", place)


class Ref:
    """A reference to an entry, by the key that it was given."""

    def __init__(self, key, attribute=0x31):
        self.key, self.attribute = key, attribute


def debug_info(units, version=5):
    """(info, abbreviations) of units, each an entry (tag, fields, children[, key])."""
    table, codes, info = b"", {}, b""

    def code(tag, children, shape):
        nonlocal table
        k = (tag, children, shape)
        if k not in codes:
            codes[k] = len(codes) + 1
            table += uleb(codes[k]) + uleb(tag) + bytes([children]) + b"".join(uleb(a) + uleb(f) for a, f in shape) + b"\0\0"
        return codes[k]

    for unit in units:
        start = 12 if version >= 5 else 11
        places, holes, out = {}, [], b""

        def put(entry):
            nonlocal out
            tag, fields, children, *key = entry
            if key:
                places[key[0]] = start + len(out)
            shape = tuple((f.attribute, 0x13) if isinstance(f, Ref) else f[:2] for f in fields)
            out += uleb(code(tag, bool(children), shape))
            for f in fields:
                if isinstance(f, Ref):
                    holes.append((len(out), f.key))
                    out += b"\0" * 4
                else:
                    out += f[2]
            for c in children:
                put(c)
            if children:
                out += b"\0"

        put(unit)
        for place, key in holes:
            out = out[:place] + struct.pack("<I", places[key]) + out[place + 4 :]
        head = struct.pack("<HBBI", 5, 1, 8, 0) if version >= 5 else struct.pack("<HIB", version, 0, 8)
        info += struct.pack("<I", len(head) + len(out)) + head + out
    return info, table + b"\0"


def range_list(*spans):
    """An entry list of .debug_rnglists."""
    return b"".join(b"\x06" + struct.pack("<QQ", a, b) for a, b in spans) + b"\0"


def old_range_list(*spans):
    """With an entry in front that sets the base, which is the unit's address otherwise."""
    return struct.pack("<QQ", 2**64 - 1, 0) + b"".join(struct.pack("<QQ", a, b) for a, b in spans) + b"\0" * 16


def debug_object(version=5, symbols=(("outer", 0x1000, 0x100), ("plain", 0x2000, 0x40), ("_ZN3app5otherEv", 0x3000, 0x20)), path_symbols=()):
    """A function `outer` at 0x1000 with two nested inlined calls, of which the first has a split range; and two plain functions."""
    lists = (range_list if version >= 5 else old_range_list)
    split = lists((0x1010, 0x1020), (0x1040, 0x1060))
    unit = (
        COMPILE_UNIT,
        [*at(0x1000, 0x4000)],
        [
            (SUBPROGRAM, [name("inner")], [], "inner"),
            (SUBPROGRAM, [name("declared")], [], "declared"),
            (SUBPROGRAM, [Ref("declared", 0x47)], [], "middle"),
            (NAMESPACE, [name("app")], [
                (SUBPROGRAM, [name("outer"), *at(0x1000, 0x1100)], [
                    (BLOCK, [*at(0x1000, 0x1100)], [
                        (INLINED, [Ref("middle"), ranges(0)], [(INLINED, [Ref("inner"), *at(0x1044, 0x1048)], [])]),
                        (INLINED, [Ref("inner"), *at(0x1080, 0x1090)], []),
                    ]),
                ]),
            ]),
            (SUBPROGRAM, [name("plain"), *at(0x2000, 0x2040)], []),
            (SUBPROGRAM, [name("other"), linkage("_ZN3app5otherEv"), *at(0x3000, 0x3020)], []),
            (SUBPROGRAM, [name("unlisted"), linkage("_ZN3app8unlistedEv"), *at(0x3100, 0x3120)], []),
        ],
    )
    info, table = debug_info([unit], version)
    sections = [(".debug_info", 0, info), (".debug_abbrev", 0, table), (".debug_rnglists" if version >= 5 else ".debug_ranges", 0, split)]
    return elf(sections, symbols)


def frame_section(functions, address, code=1, data=-8):
    """.eh_frame of functions (low, high, instructions); all start with the frame 8 above the stack pointer, the return address below it."""
    body = b"\x01zR\0" + uleb(code) + sleb(data) + uleb(16) + uleb(1) + b"\x1b" + b"\x0c\x07\x08" + b"\x90\x01"
    body += b"\0" * (-(len(body) + 4) % 8)
    out = struct.pack("<II", len(body) + 4, 0) + body
    for low, high, instructions in functions:
        place = len(out) + 8
        own = struct.pack("<iI", low - (address + place), high - low) + b"\0" + instructions
        own += b"\0" * (-(len(own) + 4) % 8)
        out += struct.pack("<II", len(own) + 4, len(out) + 4) + own
    return out + b"\0\0\0\0"
