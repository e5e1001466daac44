"""Frame names: categories, rendering, and normal forms of symbol names."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from stackloom.functions.demangle import demangle

#: Categories in the order in which they are tried, and what a lower-cased name must contain.
CATEGORIES = (
    ("Cache/Foyer", ("foyer", "hybrid_cache", "article_cache", "cache::", "moka")),
    ("NNTP Protocol", ("nntp", "client_session", "route_command", "message_id")),
    ("TLS/Crypto", ("tls", "ssl", "rustls", "aes", "cipher", "ring::")),
    ("Compression", ("lz4", "compress", "decompress", "zstd")),
    ("Network I/O", ("recv", "send", "tcp", "socket", "skb")),
    ("Disk I/O", ("zfs", "zpl", "vfs", "ext4", "xfs", "btrfs", "io_uring", "pread", "pwrite")),
    ("Locks/Futex", ("futex", "mutex", "rwlock", "parking_lot")),
    ("Event Loop", ("epoll", "poll", "mio")),
    ("Tokio Runtime", ("tokio", "runtime")),
    ("Async/Futures", ("futures", "async", "waker")),
    ("Scheduling", ("schedule", "switch", "context")),
    ("Memory", ("alloc", "malloc", "free", "mmap", "jemalloc")),
)
#: Prefixes, case as is, of the category Syscall; any other name is Other.
SYSCALL_PREFIXES = ("__x64_sys_", "__x86_sys_", "syscall", "do_syscall", "entry_SYSCALL")
UNKNOWN = "[unknown]"


def category(name: Column) -> Column:
    low = F.lower(name)
    out = F.when(low.rlike("|".join(map(re.escape, CATEGORIES[0][1]))), CATEGORIES[0][0])
    for label, words in CATEGORIES[1:]:
        out = out.when(low.rlike("|".join(map(re.escape, words))), label)
    return out.when(name.rlike("^(" + "|".join(SYSCALL_PREFIXES) + ")"), "Syscall").otherwise("Other")


def syscall_name(name: Column) -> Column:
    """The name without its entry prefix; null for other names."""
    got = F.regexp_extract(name, "^__x(?:64|86)_sys_(?s)(.*)$", 1)
    return F.when(name.rlike("^__x(64|86)_sys_"), got)


def escape_frame(frame: Column) -> Column:
    return F.regexp_replace(F.replace(frame, F.lit(";"), F.lit("\\;")), "[\\r\\n]", " ")


def render_stack(frames: Column) -> Column:
    """Frames joined by ';'.  Empty frames before the first other one leave no separator."""
    escaped = F.transform(frames, escape_frame)
    return F.aggregate(escaped, F.lit(""), lambda acc, x: F.when(acc == "", x).otherwise(F.concat(acc, F.lit(";"), x)))


def comm_label(comm: Column) -> Column:
    return F.replace(F.coalesce(comm, F.lit(UNKNOWN)), F.lit(" "), F.lit("_"))


def mapped_label(path: Column, relative: Column) -> Column:
    return F.concat(path, F.lit("+0x"), F.lower(F.hex(relative)))


def module_label(path: Column) -> Column:
    return F.concat(F.lit("["), F.substring_index(path, "/", -1), F.lit("]"))


def _marks(name: str, pattern: str, opening: str, closing: str):
    """(place, mark, brackets open there) of every match of pattern, front to back; a closing mark without an opening one counts for nothing."""
    depth = 0
    for m in re.finditer(pattern, name):
        yield m.start(), m[0], depth
        depth += (m[0] in opening) - (m[0] in closing and depth > 0)


def without_parameters(part: str) -> str:
    """Up to the first parenthesis outside brackets, unless a method receiver (.( ) or an anonymous namespace opens there."""
    part = part.replace(";", ":")
    for place, mark, depth in _marks(part, r"[<{\[(\])}>]", "<{[(", ">}])"):
        if mark == "(" and not depth and part[:place][-1:] != "." and not part.startswith("(anonymous namespace)", place):
            return part[:place]
    return part


def tidy_stack(frames) -> str:
    """Frames as one folded stack: inlined parts (->) are frames of their own and marked _[i]."""
    out = ""
    for frame in frames:
        for k, part in enumerate(frame.split("->")):
            part = without_parameters(part)
            if k and "_[i]" not in part:
                part += "_[i]"
            part = part.replace(";", "\\;").replace("\r", " ").replace("\n", " ")
            out = f"{out};{part}" if out else part
    return out


def _arrow(f, c: Column) -> Column:
    """f over batches of values; null stays null.  Made when used, as it needs a session."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else f(x))

    return F.pandas_udf(run, "string")(c)


def render_tidy_stack(frames: Column) -> Column:
    """tidy_stack(frames).  Frames without ->, ( and ; need no scan of brackets and stay in the JVM."""
    hard = F.exists(frames, lambda x: x.contains("->") | x.contains("("))
    plain = render_stack(F.transform(frames, lambda x: F.replace(x, F.lit(";"), F.lit(":"))))
    return F.when(~hard, plain).otherwise(_arrow(tidy_stack, F.when(hard, frames)))


#: Names of C++ containers stay whole, and so do debug information names of these Rust modules.
WHOLE_PREFIXES, WHOLE_PARTS = ("std::vector", "std::allocator"), ("std::vector", "::")
WHOLE_DEBUG_PREFIXES = ("std::fs::", "std::io::", "std::sys::")


def _divided(name: str) -> tuple[str, str, str] | None:
    """(receiver, generics, leaf) around the last :: outside angle brackets; generics: the receiver's last <...> and what follows it, where that tells types apart."""
    groups, opened, found = None, [], None
    for place, mark, depth in _marks(name, r"[<>]|:(?=:)", "<", ">"):
        if mark == "<":
            opened.append(place)
        elif mark == ">":
            groups = opened.pop() if opened else None
        elif not depth:
            found = place, groups
    if found is None or name.startswith(WHOLE_PREFIXES) or all(x in name for x in WHOLE_PARTS):
        return None
    at, group = found
    generics = "" if group is None else name[group:at]
    return name[:at], generics if "," in generics or "::" in generics else "", name[at + 2 :]


def symbol_name(name: str) -> str:
    """A symbol table name: receiver generics that say something move behind the last part."""
    receiver, generics, leaf = _divided(name) or (name, "", "")
    return leaf + generics if generics and receiver[0] != "<" else name


def debug_function_name(name: str) -> str:
    """A debug information name, shortened to its last part with the receiver's generics."""
    parts = None if name.startswith(WHOLE_DEBUG_PREFIXES) else _divided(name)
    if parts is None:
        return name
    receiver, generics, leaf = parts
    return leaf if "<" in leaf or receiver.startswith("<") else leaf + generics


def generic_leaf(name: str) -> str | None:
    found = re.match(r"([^< (]+)<", name)
    return found and found[1]


def normal_symbol_name(names) -> Column:
    return _arrow(symbol_name, F.col(names) if isinstance(names, str) else names)


def normal_debug_name(names) -> Column:
    return _arrow(debug_function_name, F.col(names) if isinstance(names, str) else names)


def readable_name(c: Column) -> Column:
    """Names as people write them, of mangled ones."""
    return _arrow(demangle, c)


def readable_symbol_name(c: Column) -> Column:
    """normal_symbol_name of names as a symbol table has them, mangled."""
    return _arrow(lambda x: symbol_name(demangle(x)), c)


def readable_debug_name(c: Column) -> Column:
    return _arrow(lambda x: debug_function_name(demangle(x)), c)


def debug_leaf(c: Column) -> Column:
    """What debug strings list a name under."""

    def leaf(name: str) -> str:
        short = debug_function_name(name)
        return generic_leaf(short) or short

    return _arrow(leaf, c)
