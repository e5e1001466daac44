"""WARC archives: a parallel writer and a splittable reader.

Writing: every record is a gzip member of its own, so an archive can be entered
at any record.  Of records with equal payloads the one with the smallest id is
written in full (response), the others refer to it (revisit).  Payloads are
compressed before they shuffle; which rows are revisits is found from digests
alone, by an aggregation with partial results, so a payload that a third of all
rows share costs a row a task.

Reading: archives are cut into byte ranges, one task each, whatever the file
sizes.  A task looks for the gzip magic in its range, and takes a place for a
record if the member there inflates to a WARC header, its length is what the
header says, and the file ends or another member follows.  A record belongs to
the range in which it starts; its task reads on past the end of the range.  Where
a record must start (at the head of a file, or behind another record, be that in
the next range) and none can be read, the archive is damaged: `damaged` tells
whether that is an error, a row of its own, or left out.

Archives are written through the file system of the shared folder.  File names
carry the attempt, and only the files that the manifest names are read, so a
repeated task leaves no double records.

Lengths and digests of responses are computed again from the payload that was
read, and differing ones are an error too; a revisit has those of its headers.

Edge cases: a null payload is empty; null urls and null ids are written without
the header and read back as null; of equal payloads of one id each row is written
in full or as revisit like the first, so ties need no order; a very long payload
is one member, held once by the task that writes or reads it; extra columns are
ignored and may have any name; no rows give no archives, and none are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm.scratch import Scratch, file_system

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
RANGES_A_TASK = 8
MAX_READ_TASKS = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, str(page_id))}>"


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(page_id, url, payload: bytes | None, n: int, digest: str, date: str, refers_to=None) -> bytes:
    """A response record, or a revisit record where payload is None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    body = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _responses(date: str, level: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                rows = []
                for page, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    digest = base32_digest(html)
                    rows.append((page, url, digest, len(html), _member(record(page, url, html, len(html), digest, date), level)))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["page_id", "url", "digest", "n", "member"])

    return run


def _writer(folder: str, date: str, level: int):
    def run(batches):
        out = name = None
        count = 0
        for batch in batches:
            for page, url, digest, n, member, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store, path = file_system(folder)
                    store.create_dir(path, recursive=True)
                    name = f"{path}/part-{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(name, compression=None)
                    info = b"software: stackloom\r\nformat: WARC File Format 1.1\r\n"
                    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(name.rsplit('/', 1)[1])}\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                    out.write(_member(head.encode() + info + b"\r\n\r\n", level))
                out.write(member if refers is None else _member(record(page, url, None, n, digest, date, refers), level))
                count += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], ["path", "size", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 1, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives under folder; returns their manifest (path, size, records), which must be kept to read exactly these files."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b"")).alias("html"))
    keys = rows.filter(F.octet_length("html") >= min_bytes).select("page_id", F.sha1("html").alias("sha"))
    # a null id is the last; a payload of null ids alone is written in full each time
    lone = F.max(F.col("page_id").isNull())
    first = keys.groupBy("sha").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), lone.alias("lone")).filter("first < last or (lone and first is not null)").select("sha", "first")
    again = keys.join(first, "sha").filter("page_id is null or page_id <> first").select("page_id", "sha", "first").distinct()
    made = rows.select("page_id", "url", "html").mapInArrow(_responses(date, level), "page_id long, url string, digest string, n long, member binary")
    # an id may stand for several payloads: the digest decides
    again = again.select(F.col("page_id").alias("again"), _base32(F.col("sha")).alias("again_digest"), "first")
    both = made.join(again, (F.col("digest") == F.col("again_digest")) & F.col("page_id").eqNullSafe(F.col("again")), "left")
    return both.select("page_id", "url", "digest", "n", "member", "first").mapInArrow(_writer(folder, date, level), "path string, size long, records long")


def _base32(sha_hex):
    """Base 32 of 40 hexadecimal digits: each five digits give four letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for i in range(0, 40, 5):
        v = F.conv(F.substring(sha_hex, i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(letters), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


class Member:
    """A gzip member of an open file: inflated as far as asked for."""

    def __init__(self, source, start: int, limit: int):
        self.source, self.at, self.limit = source, start, limit
        self.z = zlib.decompressobj(31)
        self.data = b""
        self.pending = b""

    def grow(self, want: int) -> bool:
        """Until want bytes are there or the member ends; False if it is no gzip member."""
        parts, have = [self.data], len(self.data)
        try:
            while have < want and not self.z.eof:
                block = self.pending or self.source.read_at(min(1 << 16, self.limit - self.at), self.at)
                if not block:
                    return False
                if not self.pending:
                    self.at += len(block)
                got = self.z.decompress(block, 1 << 20)
                self.pending = self.z.unconsumed_tail
                parts.append(got)
                have += len(got)
        except zlib.error:
            return False
        self.data = b"".join(parts)
        return True

    def end(self) -> int:
        return self.at - len(self.z.unused_data) - len(self.pending)


def _read_record(source, start: int, size: int):
    """(headers, body, end) of the WARC record that starts at start; None if none does."""
    m = Member(source, start, size)
    if not m.grow(8) or not m.data.startswith(b"WARC/1."):
        return None
    while (cut := m.data.find(b"\r\n\r\n")) < 0:
        if m.z.eof or len(m.data) > 1 << 20 or not m.grow(len(m.data) + 4096):
            return None
    head = {}
    for line in m.data[:cut].split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        head[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    try:
        length = int(head["content-length"])
    except (KeyError, ValueError):
        return None
    if not m.grow(1 << 62) or not m.z.eof or len(m.data) != cut + 8 + length or not m.data.endswith(b"\r\n\r\n"):
        return None
    end = m.end()
    if end < size and source.read_at(min(3, size - end), end) != MAGIC[: size - end]:
        return None
    return head, m.data[cut + 4 : cut + 4 + length], end


class DamagedArchive(ValueError):
    pass


def records_in_range(source, size: int, start: int, stop: int, block: int = 1 << 20):
    """(place, headers, body) of the records that start in [start, stop); headers are None where one must start and can't be read."""
    at, sure = start, start == 0
    while at < stop:
        found = _read_record(source, at, size) if source.read_at(min(3, size - at), at) == MAGIC else None
        if found:
            yield at, found[0], found[1]
            at, sure = found[2], True
            continue
        if sure:
            yield at, None, None
        # the next magic after this place, in blocks that overlap by two bytes
        at, sure = at + 1, False
        while at < stop:
            data = source.read_at(min(block, stop - at + 2, size - at), at)
            k = data.find(MAGIC)
            if k >= 0:
                at += k
                break
            at += max(1, len(data) - 2)
    # the next range cannot know that a record must start here
    if sure and stop < size and at < size and not (source.read_at(min(3, size - at), at) == MAGIC and _read_record(source, at, size)):
        yield at, None, None


def _reader(folder: str, damaged: str):
    def row(path, at, head, body):
        kind = head.get("warc-type")
        http, _, payload = body.partition(b"\r\n\r\n")
        page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
        digest = (head.get("warc-payload-digest") or "").removeprefix("sha1:")
        m = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
        n, sound = int(m[1]) if m else len(payload), True
        if kind == "response":
            own = base32_digest(payload)
            sound = own == digest and n == len(payload)
            digest, n = own, len(payload)
            if not sound and damaged == "error":
                raise DamagedArchive(f"{path}: the payload of the record at {at} is not the one its headers tell of")
        return (path, at, None if page is None else int(page), head.get("warc-target-uri"), kind, digest, n, None if refers is None else int(refers), payload if kind == "response" else None, sound)

    def run(batches):
        for batch in batches:
            for path, size, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, _ = file_system(folder)
                rows, held = [], 0
                with store.open_input_file(path) as source:
                    for at, head, body in records_in_range(source, size, start, stop):
                        if head is None:
                            if damaged == "error":
                                raise DamagedArchive(f"{path}: no record can be read at {at}")
                            if damaged == "row":
                                rows.append((path, at, None, None, "damaged", None, None, None, None, False))
                            continue
                        if head.get("warc-type") not in ("response", "revisit"):
                            continue
                        rows.append(row(path, at, head, body))
                        held += len(body)
                        if len(rows) == 500 or held > 1 << 24:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return run


_FIELDS = [("path", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("digest_ok", pa.bool_())]


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES, damaged: str = "error") -> DataFrame:
    """The response and revisit records of the archives in the manifest (path, size).

    Ranges are dealt RANGES_A_TASK to a task, in no fewer tasks than there are cores.
    damaged: "error"; "row", a row of record_type `damaged`; or "skip".
    """
    files = manifest.filter("size > 0")
    ranges = files.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 0
    tasks = int(min(MAX_READ_TASKS, max(1, min(ranges, spark.sparkContext.defaultParallelism), ranges // RANGES_A_TASK)))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    places = files.select("path", "size", starts.alias("start")).withColumn("stop", F.least(F.col("start") + split_bytes, F.col("size")))
    # a number of partitions that is asked for is left as it is
    dealt = places.repartition(tasks, "path", "start")
    return dealt.mapInArrow(_reader(folder, damaged), "path string, offset long, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary, digest_ok boolean")


def round_trip(pages: DataFrame, min_bytes: int = 0, split_bytes: int = SPLIT_BYTES, **options) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back; scratch.release() removes the archives."""
    scratch = Scratch(pages.sparkSession, "warc")
    manifest = scratch.write(write_archives(pages, f"{scratch.path}/archives", min_bytes, **options), "manifest")
    return read_archives(pages.sparkSession, manifest, f"{scratch.path}/archives", split_bytes)
