"""Vectorised text kernels on Arrow buffers.

All kernels see the UTF-8 bytes of a chunk of whole documents.  White space is
the six ASCII bytes [\\x20\\x09-\\x0D]; lower-casing touches A-Z alone, so both
work on bytes.  Equality of words and word sequences is equality of 64-bit
hashes.  Chunks are bounded in bytes, so working memory does not depend on the
number of rows in a batch; one longer document makes a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + _GOLD
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(256, dtype=np.uint64))
_BYTE_LOWER = _BYTE[LOWER]
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """_STEP ** 0 .. n-1 modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 256), _STEP, np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


@dataclass
class Chunk:
    """Consecutive documents: rows lo..hi of a batch, their bytes, and n+1 offsets into them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return self.hi - self.lo


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64) if off is not None and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    raw, offsets = buffers(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield Chunk(lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """Word positions of a chunk: first[d]..first[d+1] are the words of document d."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def split_words(c: Chunk, white: np.ndarray = WHITE) -> Words:
    solid = ~white[c.data]
    if not len(solid):
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(len(c) + 1, np.int64))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    edge = c.offsets[(c.offsets > 0) & (c.offsets < len(solid))]
    begins[edge] |= solid[edge]
    stops[edge - 1] |= solid[edge - 1]
    starts = np.flatnonzero(begins)
    return Words(starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, c.offsets))


def word_hashes(c: Chunk, w: Words, lower: bool = True, white: np.ndarray = WHITE) -> np.ndarray:
    if not len(w.starts):
        return np.zeros(0, np.uint64)
    span = np.diff(np.append(w.starts, len(c.data)))
    at = np.arange(w.starts[0], len(c.data), dtype=np.int32) - np.repeat(w.starts.astype(np.int32), span)
    body = c.data[w.starts[0] :]
    term = (_BYTE_LOWER if lower else _BYTE)[body]
    length = w.ends - w.starts
    if int(span.max()) > 4096:
        at = np.where(at < np.repeat(length, span), at, 0).astype(np.int32)
    term *= powers(int(max(at.max(), 0)) + 1)[at]
    term[white[body]] = 0
    return mix(np.add.reduceat(term, w.starts - w.starts[0]) + length.astype(np.uint64) * _M2)


_LANE = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def window_hashes(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows, document after document, and n+1 offsets; a document of 1..k-1 words gives its whole sequence."""
    n_words = np.diff(first)
    counts = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    out_first = np.concatenate([[0], np.cumsum(counts)])
    if not len(h):
        return np.zeros(0, np.uint64), out_first
    full = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k):
        full += h[j : j + len(full)] * _LANE[j]
    out = np.empty(out_first[-1], np.uint64)
    starts = np.repeat(first[:-1], counts) + (np.arange(out_first[-1]) - np.repeat(out_first[:-1], counts))
    long = np.repeat(n_words >= k, counts)
    out[long] = mix(full[starts[long]])
    for d in np.flatnonzero((n_words > 0) & (n_words < k)):
        part = h[first[d] : first[d + 1]]
        out[out_first[d]] = mix(mix(np.sum(part * _LANE[: len(part)], dtype=np.uint64, keepdims=True)) + np.uint64(len(part)))[0]
    return out, out_first


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def binary_rows(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from bytes and n+1 offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def list_rows(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
