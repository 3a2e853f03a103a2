"""WARC archives: a writer that records repeated payloads as revisits, and a salvage reader.

Writing: of the pages with equal payloads the one with the largest page_id is a ``response``
record, the others ``revisit`` it; smaller payloads than ``revisit_bytes`` are always responses. Every
task writes one archive, each record a gzip member of its own, under its name only when complete.

Reading: archives are read from front to back in bounded windows. Every member must decompress with
its checksum, hold one whole record (version line, headers, as many bytes of content as announced), and its
payload and block digests must hold. After a failed check the reader searches for the next gzip member or
version line that starts a valid record, and goes on there; the bytes between are
logged as one quarantined gap with offset, length and reason. Plain records between members are read as well.

Null html is an empty payload. Rows that repeat both page_id and html are all responses, or all revisits, like the one row;
a page without page_id is a response. An empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.common import AtomicFile, fresh_folder, opened, slices, spread, utf8
from txnrisk.sources.scratch import materialise

VERSION = b"WARC/1.1"
GZIP = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_STARTS = re.compile(rb"\x1f\x8b\x08|WARC/[01]\.\d+\r\n")
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space

ARCHIVES = "archive int, path string, n_records bigint"
#: Bytes of an archive that the reader decompresses at a time.
PIECE = 1 << 14

RECORDS = (
    "path string, offset bigint, length bigint, kind string, reason string, page_id bigint, payload_bytes bigint, "
    "payload_digest string, record_type string, refers_to bigint, url string, payload binary"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, nth: str = "") -> str:
    return f"urn:uuid:{uuid.uuid5(_NAMES, f'page/{page}{nth}')}"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: HTTP headers, and for a response the payload after them."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\r\n]+", " ", url or "")
    lines = [
        VERSION.decode(),
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id(page)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def originals(pages: DataFrame, revisit_bytes: int) -> DataFrame:
    """(_page, _digest, _original): of every page that revisits another, which one."""
    ids = pages.select(F.col("page_id").cast("bigint").alias("_page"), F.sha1("html").alias("_digest"), F.octet_length("html").alias("_n"))
    ids = materialise(ids.filter(F.col("_page").isNotNull() & (F.col("_n") >= revisit_bytes)).select("_page", "_digest"), "digests")
    last = ids.groupBy("_digest").agg(F.max("_page").alias("_original"), F.min("_page").alias("_least")).filter("_least < _original")
    return ids.join(last.drop("_least"), "_digest").filter("_page < _original").distinct()


def write_archives(pages: DataFrame, revisit_bytes: int = 0, level: int = 4, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html); returns one row per archive."""
    folder = folder or fresh_folder(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), utf8("html").alias("html"))
    again = originals(rows, revisit_bytes)
    same = (F.col("page_id") == F.col("_page")) & (F.sha1("html") == F.col("_digest"))
    rows = rows.join(again, same, "left").select("page_id", "url", "html", "_original")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, n = TaskContext.get().partitionId(), None, 0
        name = f"{folder}/part-{part:06d}.warc.gz"
        for batch, payloads in slices(batches, "html"):
            if out is None:
                out = AtomicFile(name)
            pages, urls, first = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for row in zip(pages, urls, payloads, first, strict=True):
                out.write(member(record(*row), level))
                n += 1
        if out is not None:
            out.commit()
            yield pa.RecordBatch.from_pydict({"archive": pa.array([part], pa.int32()), "path": [name], "n_records": [n]})

    return materialise(rows.mapInArrow(write, ARCHIVES), "archives")


class Invalid(Exception):
    """A check of a record failed."""


class Cut(Exception):
    """The window ends before the record does."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    length: int  # bytes in the archive

    @property
    def payload(self) -> bytes:
        head, mark, body = self.block.partition(b"\r\n\r\n")
        return body if mark and head.startswith(b"HTTP/") else self.block


def _plain(data: bytes) -> Record:
    """The record at the start of ``data``."""
    head, mark, _ = data.partition(b"\r\n\r\n")
    if not re.match(rb"WARC/[01]\.\d+\r\n", data):
        if len(data) < 10:
            raise Cut
        raise Invalid("no version line")
    if not mark:
        raise Cut if len(data) < 1 << 20 else Invalid("headers don't end")
    headers: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Invalid("a header line without a name")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Invalid("no content length")
    start, n = len(head) + 4, int(length)
    if len(data) < start + n + 4:
        raise Cut
    if data[start + n : start + n + 4] != b"\r\n\r\n":
        raise Invalid("content is longer or shorter than announced")
    found = Record(headers, data[start : start + n], start + n + 4)
    for name, value in (("warc-block-digest", found.block), ("warc-payload-digest", found.payload)):
        said = headers.get(name, "")
        revisit = headers.get("warc-type") == "revisit" and name == "warc-payload-digest"
        if said.startswith("sha1:") and not revisit and said[5:] != digest(value):
            raise Invalid(f"{name} differs")
    return found


def parse(data: bytes | memoryview) -> Record:
    """The record, compressed or plain, at the start of ``data``; Cut if more bytes could help."""
    if data[:3] != GZIP:
        if len(data) < 3:
            raise Cut
        return _plain(bytes(data))
    z, view, parts, fed = zlib.decompressobj(31), memoryview(data), [], 0
    try:
        while not z.eof and fed < len(view):  # in pieces: what follows the member is copied at each end
            parts.append(z.decompress(view[fed : fed + PIECE]))
            fed += PIECE
    except zlib.error as e:
        raise Invalid(f"gzip: {e}") from None
    if not z.eof:
        raise Cut
    text = b"".join(parts)
    try:
        found = _plain(text)
    except Cut:
        raise Invalid("the member ends before its record") from None
    if found.length != len(text):
        raise Invalid("a member with more than one record")
    return Record(found.headers, found.block, min(fed, len(data)) - len(z.unused_data))


def salvage(source, window: int = 4 << 20, most: int = 1 << 30) -> Iterator[tuple[int, int, Record | None, str]]:
    """(offset, length, record, reason): records, or None with the reason for a gap. ``source`` has read_at(n, offset)
    and size(). A window is read once for all records that lie in it whole. It doubles only while a record needs it, up to ``most`` bytes for one record."""
    size, at, gap, why = source.size(), 0, -1, ""
    held, start = b"", 0
    while at < size:
        want = window
        while True:
            if not start <= at < start + len(held):
                held, start = source.read_at(min(want, size - at), at), at
            data = memoryview(held)[at - start :]  # no copy of the window for each record
            whole = len(data) >= min(want, size - at)
            try:
                found = parse(data)
                break
            except Cut:
                if whole and (at + len(data) >= size or want >= most):
                    found, reason = None, "cut short"
                    break
                if whole:
                    want = max(2 * want, 2 * len(data))
            except Invalid as e:
                if whole:
                    found, reason = None, str(e)
                    break
            held = b""  # the rest of the window was too short for a judgement
        if found is not None:
            if gap >= 0:
                yield gap, at - gap, None, why
                gap = -1
            yield at, found.length, found, ""
            at += found.length
            continue
        if gap < 0:
            gap, why = at, reason
        at = _next_start(source, at + 1, size, window)
    if gap >= 0:
        yield gap, size - gap, None, why


def _next_start(source, at: int, size: int, window: int) -> int:
    """Offset of the next gzip magic or version line from ``at`` on."""
    while at < size:
        data = source.read_at(min(window, size - at), at)
        m = _STARTS.search(data)
        if m:
            return at + m.start()
        if at + len(data) >= size:
            return size
        at += max(1, len(data) - 16)
    return size


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Records and gaps of the archives (archive, path), kind ``record`` or ``gap``; payloads on demand."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("reason", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = opened(path)
                with fs.open_input_file(inner) as source:
                    rows, size = [], 0
                    for offset, length, found, reason in salvage(source):
                        rows.append(_row(path, offset, length, found, reason, payloads))
                        size += len(rows[-1][-1] or b"") + 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds, strict=True)], names=[n for n, _ in kinds])
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds, strict=True)], names=[n for n, _ in kinds])

    return spread(archives.select("path"), "path").mapInArrow(read, RECORDS)


def _row(path: str, offset: int, length: int, found: Record | None, reason: str, payloads: bool) -> tuple:
    if found is None:
        return (path, offset, length, "gap", reason, *[None] * 7)
    h = found.headers
    number = lambda name: int(h[name]) if name in h else None
    kind = h.get("warc-type", "")
    said = re.search(rb"(?i)\r\nContent-Length: (\d+)", found.block.partition(b"\r\n\r\n")[0]) if kind == "revisit" else None
    n = int(said[1]) if said else len(found.payload)
    checksum = h.get("warc-payload-digest", "").removeprefix("sha1:") or digest(found.payload)
    payload = found.payload if payloads and kind == "response" else None
    return (path, offset, length, "record", None, number("x-page-id"), n, checksum, kind, number("x-refers-to-page"), h.get("warc-target-uri"), payload)
