"""An encoder of small binary recordings, from the layout of the format."""

import struct

IP, TID, TIME, ID, PERIOD, CALLCHAIN, REGS, STACK, IDENT = 1 << 0, 1 << 1, 1 << 2, 1 << 6, 1 << 8, 1 << 5, 1 << 12, 1 << 13, 1 << 16
BASE = IP | TID | CALLCHAIN


def q(*xs):
    return struct.pack(f"<{len(xs)}Q", *xs)


def text(s):
    return s.encode() + b"\0"


def record(kind, payload, misc=0):
    return struct.pack("<IHH", kind, misc, 8 + len(payload)) + payload


def comm(pid, tid, name, execs=False, tail=b""):
    return record(3, struct.pack("<II", pid, tid) + text(name) + tail, 1 << 13 if execs else 0)


def mmap(pid, start, size, pgoff, path):
    return record(1, struct.pack("<II", pid, pid) + q(start, size, pgoff) + text(path))


def mmap2_build_id(pid, start, size, pgoff, path, build_id=b"\x11" * 20, prot=5):
    return record(10, struct.pack("<II", pid, pid) + q(start, size, pgoff) + bytes([len(build_id), 0, 0, 0]) + build_id.ljust(20, b"\0") + struct.pack("<II", prot, 0) + text(path), 1 << 14)


def sample(chain, pid=11, tid=12, ip=0x1000, time=None, period=None, ident=None, regs=None, stack=None, dynamic=None, misc=2):
    p = (q(ident) if ident is not None else b"") + q(ip) + struct.pack("<II", pid, tid)
    p += (q(time) if time is not None else b"") + (q(period) if period is not None else b"")
    p += q(len(chain), *chain)
    if regs is not None:
        p += q(2, *regs)
    if stack is not None:
        p += q(len(stack)) + (stack + q(dynamic) if stack else b"")
    return record(9, p, misc)


def deferred(cookie, ips):
    return record(22, q(cookie, len(ips), *ips))


def recording(records, sample_type=BASE, flags=0, regs_user=0, ids=(), attrs=1, build_ids=b""):
    data = b"".join(records)
    attr_size, at = 128, 104
    id_at = at + attrs * (attr_size + 16)
    head = b""
    for k in range(attrs):
        own = ids[k] if ids else ()
        a = bytearray(attr_size)
        struct.pack_into("<I", a, 4, attr_size)
        struct.pack_into("<Q", a, 24, sample_type)
        struct.pack_into("<Q", a, 40, flags)
        struct.pack_into("<Q", a, 80, regs_user)
        head += bytes(a) + q(id_at, 8 * len(own))
        id_at += 8 * len(own)
    head += b"".join(q(*own) for own in ids)
    data_at = at + len(head)
    features = q(4 if build_ids else 0, 0, 0, 0)
    tail = q(data_at + len(data) + 16, len(build_ids)) + build_ids if build_ids else b""
    return b"PERFILE2" + q(104, attr_size + 16, at, attrs * (attr_size + 16), data_at, len(data)) + features + b"\0" * 16 + head + data + tail
