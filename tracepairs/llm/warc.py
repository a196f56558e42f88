"""WARC archives: a writer with revisit records and a salvage reader.

The reader checks every gzip member (CRC), version line, header block, length, end of record and payload digest.
After a failed check it searches for the next member or version line at which a whole valid record stands,
goes on from there, and logs the bytes in between as a quarantined gap. Inside a gzip member it does the same with
the inflated content, also with what was inflated before a member was cut short or failed its checks.

Archives are rows (archive, content), as Spark's ``binaryFile`` source gives them (path, content).
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracepairs.llm.common import map_arrow, materialize, maybe_broadcast, quoted, raw, slices

_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
#: A batch of rows is closed at this many bytes of payloads or rows.
_BATCH_BYTES, _BATCH_ROWS = 8 << 20, 2000


# --- one record ------------------------------------------------------------------------------------------


@dataclass
class Record:
    headers: dict[str, str]
    payload: memoryview  # of the content it was read from
    payload_bytes: int
    digest: str | None
    offset: int = 0
    end: int = 0


class Invalid(ValueError):
    pass


def build_record(kind: str, record_id: str, uri: str, payload: bytes, digest: str, *, refers_to: str | None = None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A response with its payload, or a revisit that has the HTTP headers only. ``digest``: hex SHA-1 of the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode()
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def _digest_hex(value: str | None) -> str | None:
    """Hex of a ``sha1:`` header in base32 or hex, None for none or another algorithm."""
    name, _, text = (value or "").partition(":")
    if name.strip().lower() != "sha1":
        return None
    text = text.strip()
    try:
        return text.lower() if len(text) == 40 else base64.b32decode(text.upper()).hex()
    except ValueError as e:
        raise Invalid("unreadable payload digest") from e


def read_record(data: bytes, at: int) -> tuple[Record, int]:
    """The valid record that starts at ``at`` and the offset after it; :class:`Invalid` says which check failed."""
    version = _VERSION.match(data, at)
    if not version:
        raise Invalid("no version line")
    stop = data.find(b"\r\n\r\n", version.end() - 2)
    if stop < 0:
        raise Invalid("header block does not end")
    headers: dict[str, str] = {}
    for line in data[version.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Invalid("broken header line")
        headers[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if not {"warc-type", "warc-record-id", "warc-date"} <= headers.keys():
        raise Invalid("a header that must be there is not")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Invalid("no content length")
    body, end = stop + 4, stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Invalid("record does not end where its length says")
    start, size = body, None
    if headers.get("content-type", "").startswith("application/http"):
        http = data.find(b"\r\n\r\n", body, end)
        if http < 0:
            raise Invalid("HTTP headers do not end")
        said = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", data[body:http])
        start, size = http + 4, int(said[1]) if said else None
    payload = memoryview(data)[start:end]
    claimed = _digest_hex(headers.get("warc-payload-digest"))
    if headers.get("warc-type") == "revisit":
        return Record(headers, payload, len(payload) if size is None else size, claimed), end + 4
    found = hashlib.sha1(payload).hexdigest()
    if claimed is not None and claimed != found:
        raise Invalid("payload digest differs")
    return Record(headers, payload, len(payload), found), end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at ``at``."""
    z, out, step, view = zlib.decompressobj(31), [], 1 << 16, memoryview(data)
    p = at
    try:
        while not z.eof:
            if p >= len(data):
                raise Invalid("member cut short")
            out.append(z.decompress(view[p : p + step]))
            p += step
    except zlib.error as e:
        raise Invalid("member fails its checks") from e
    return b"".join(out), min(p, len(data)) - len(z.unused_data)


def _inflate_broken(data: bytes, at: int, most: int | None = None) -> tuple[bytes, int]:
    """What the broken member at ``at`` gives before its error, and where that is; with ``most``, the offset after the
    last byte that the first ``most`` bytes need."""
    z, out, size, p, step, view = zlib.decompressobj(31), [], 0, at, 1 << 16, memoryview(data)
    while p < len(data) and (most is None or size < most):
        ahead = z.copy()
        try:
            piece = ahead.decompress(view[p : p + step])
        except zlib.error:
            piece = None
        if step > 1 and (piece is None or (most is not None and size + len(piece) >= most)):
            step >>= 4
            continue
        if piece is None:
            break
        z, size, p = ahead, size + len(piece), p + step
        out.append(piece)
    return b"".join(out), min(p, len(data))


def _records(content: bytes) -> tuple[list[tuple[Record, int, int]], list[tuple[int, int, str]]]:
    """The valid records of a member's content with their inner ranges, and the inner gaps (start, end, reason)."""
    found, gaps, at, bad = [], [], 0, None
    while at < len(content):
        try:
            r, end = read_record(content, at)
        except Invalid as e:
            bad = bad or (at, str(e))
            later = _VERSION.search(content, at + 1)
            at = later.start() if later else len(content)
            continue
        if bad:
            gaps.append((bad[0], at, bad[1]))
            bad = None
        found.append((r, at, end))
        at = end
    if bad:
        gaps.append((bad[0], len(content), bad[1]))
    return found, gaps


Gap = tuple[int, int, str]


def salvage_stream(data: bytes) -> Iterator[Record | Gap]:
    """All valid records in order, with offsets in the archive, and the gaps (start, end, reason), as they are found.

    A gap between records of one member has the member's offset and end; its range in the inflated content is in the
    reason. Records of a member that fails its own checks are kept if they pass theirs, and end where the last byte of
    the member that they need stands; the rest of the member is a gap. A record that is all of a member falls with it.
    One member's content is held at a time; payloads are views of it.
    """
    at, bad = 0, None  # bad: start and reason of the open gap
    while at < len(data):
        found, inner, error = [], [], None
        try:
            if data.startswith(_MAGIC, at):
                try:
                    content, end = _inflate(data, at)
                    found, inner = _records(content)
                except Invalid as e:
                    error = str(e)
                    content, end = _inflate_broken(data, at)
                    found, inner = _records(content)
                    if found and (found[0][1], found[0][2]) == (0, len(content)):
                        found = []
                    if found:
                        inner = [g for g in inner if g[0] < found[-1][1]]  # what follows is in the gap to come
                        end = _inflate_broken(data, at, found[-1][2])[1]
                if not found and (error or inner):
                    raise Invalid(error or inner[0][2])
                for r, _, _ in found:
                    r.offset, r.end = at, end
            else:
                r, end = read_record(data, at)
                r.offset, r.end = at, end
                found = [(r, 0, 0)]
        except Invalid as e:
            bad = bad or (at, str(e))
            later = _NEXT.search(data, at + 1 if error or not data.startswith(_MAGIC, at) else end)
            at = later.start() if later else len(data)
            continue
        if bad:
            yield bad[0], at, bad[1]
            bad = None
        yield from (r for r, _, _ in found)
        yield from ((at, end, f"{why}; bytes {lo} to {hi} of the member's content") for lo, hi, why in inner)
        at = end
        if error:
            bad = (at, error)
            later = _NEXT.search(data, at)
            at = later.start() if later else len(data)
    if bad:
        yield bad[0], len(data), bad[1]


def salvage(data: bytes) -> tuple[list[Record], list[Gap]]:
    """The records and the gaps of :func:`salvage_stream`."""
    found = list(salvage_stream(data))
    return [x for x in found if isinstance(x, Record)], [x for x in found if not isinstance(x, Record)]


# --- reading ---------------------------------------------------------------------------------------------

_READ = "kind string, archive string, offset long, end long, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, reason string"
_READ_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary(), pa.string()]
_READ_NAMES = [x.split()[0] for x in _READ.split(", ")]


def read_archives(archives: DataFrame, name_col: str = "archive", content_col: str = "content", *, with_payload: bool = True) -> DataFrame:
    """One row per salvaged record (``kind`` 'record') and per quarantined byte gap (``kind`` 'gap', with ``reason``).

    ``payload_bytes`` and ``payload_digest`` (hex SHA-1) are of the payload that was read; for revisits, of the
    payload they refer to, as their headers say. Records around a failed one in a gzip member are salvaged too; the gap
    has the member's range and names its own range in the content (see :func:`salvage`).
    Archives may be gzip members, plain records or both. Null or empty content has no records and no gaps.
    A task holds one archive, one member's content and one batch of rows at a time; no shuffle.
    """

    def row(name: str, x: Record | Gap) -> tuple:
        if not isinstance(x, Record):
            return "gap", name, x[0], x[1], *[None] * 7, x[2]
        kind, uri = x.headers.get("warc-type"), x.headers.get("warc-target-uri")
        own, refers = (_bare(x.headers.get(h)) for h in ("warc-record-id", "warc-refers-to"))
        return "record", name, x.offset, x.end, kind, own, uri, refers, x.payload_bytes, x.digest, bytes(x.payload) if with_payload else None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        closed = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ_TYPES)], names=_READ_NAMES)
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                for x in salvage_stream(content.as_buffer().to_pybytes() if content.is_valid else b""):
                    rows.append(row(name.as_py(), x))
                    size += len(rows[-1][10] or b"")
                    if size >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                        yield closed()
                        rows, size = [], 0
        if rows:
            yield closed()

    return map_arrow(archives.select(quoted(name_col).cast("string"), quoted(content_col)), run, _READ)


def _bare(value: str | None) -> str | None:
    return value.strip("<> ") if value else None


# --- writing -----------------------------------------------------------------------------------------------


def classify(pages: DataFrame, id_col: str, payload_col: str, *, least: int) -> DataFrame:
    """``pages`` with ``__digest`` and ``__refers`` (the largest id of the equal payloads of ``least`` bytes or more; null
    for a page without such another). Copies are counted map-side; only narrow rows of repeated payloads meet."""
    digest = F.sha1(F.col("__payload"))
    rows = pages.withColumn("__payload", F.coalesce(quoted(payload_col), F.lit(""))).withColumn("__digest", digest)
    groups = rows.where(F.octet_length("__payload") >= least).groupBy("__digest").agg(F.max(quoted(id_col)).alias("__refers"), F.count(F.lit(1)).alias("__n"))
    groups = materialize(groups.where("__n > 1").select(F.col("__digest").alias("__of"), "__refers"), "repeated")
    return rows.join(maybe_broadcast(groups, groups.count()), F.col("__digest") == F.col("__of"), "left").drop("__of")


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *, revisit_bytes: int = 1000, archive_bytes: int = 1 << 20, level: int = 6
) -> DataFrame:
    """Archives (``archive, content``) of gzip members, one record per page, in the shared folder.

    Of pages with equal payloads of at least ``revisit_bytes``, the one with the largest id is a response, the others
    are revisits of it; rows that repeat this id, and groups without any id, are all responses. Null payloads are empty,
    null ids are written as such, a null URL becomes the record's own id. An archive is closed at ``archive_bytes``
    or after one record that is larger. An empty table gives no archives.
    """
    marked = classify(pages.select(quoted(id_col).cast("long").alias("__id"), quoted(url_col).alias("__url"), quoted(payload_col).alias("__body")), "__id", "__body", least=revisit_bytes)
    marked = marked.select("__payload", "__id", "__url", "__digest", "__refers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{count:06d}.warc.gz"]), pa.array([b"".join(parts)], pa.binary())], names=["archive", "content"])

        for b in slices(batches, "__payload", 1 << 20):
            data, offs = raw(b.column(0))
            data = data.tobytes()
            for i, (page, url, digest, refers) in enumerate(zip(*[b.column(k).to_pylist() for k in range(1, 5)])):
                again = refers is not None and page != refers
                own = record_name(page)
                uri = re.sub(r"[\s\x00-\x1f]", lambda m: "".join(f"%{x:02X}" for x in m[0].encode()), url) if url else own
                record = build_record("revisit" if again else "response", own, uri, data[offs[i] : offs[i + 1]], digest, refers_to=record_name(refers) if again else None)
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                parts.append(z.compress(record) + z.flush())
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield closed()
                    count, parts, size = count + 1, [], 0
        if parts:
            yield closed()

    out = map_arrow(marked, run, "archive string, content binary")
    return materialize(out, "warc", {"parquet.block.size": str(16 << 20), "compression": "none"})


_URN = "urn:page:"


def record_name(page: int | None) -> str:
    return f"{_URN}{'' if page is None else page}"


def page_of(record_id):
    """The page id in a record id of :func:`write_archives`, as a column; null for a page without one."""
    digits = F.substring(record_id, len(_URN) + 1, 40)
    return F.when(digits != "", digits).cast("long")


def page_records(pages: DataFrame, **options) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` as read back from the archives."""
    read = read_archives(write_archives(pages, **options), with_payload=False).where("kind = 'record'")
    return read.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))
