"""Web archives (WARC 1.1) written and read as streams, with payloads as tables of chunks.

Writing: each task streams its pages into archives of its own under names no other attempt uses, and returns the segments it
wrote: runs of whole records by byte range. Only archives that a stored manifest lists exist for readers, so a lost or
repeated task does no harm. Reading: a segment is read in small buffers and gives rows (record, chunk number, chunk,
digest so far); a record of any size passes through one chunk's memory, and its last chunk carries its digest.

The archives are reached through the Arrow file systems, so the folder may be local, HDFS or an object store.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenora.session import scratch_path, stored

#: Payloads shorter than this are never revisited.
MIN_REVISIT_BYTES = 100
CHUNK_BYTES = 1 << 20
#: A new segment starts after so many compressed bytes, a new archive after so many.
SEGMENT_BYTES, ARCHIVE_BYTES = 16 << 20, 1 << 30
_BUFFER = 1 << 16
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "path string, first_byte long, end_byte long, records long"
CHUNKS = (
    "record_id string, page_id string, url string, record_type string, refers_to string, declared_bytes long, "
    "declared_digest string, chunk int, chunk_start long, data binary, digest_so_far string, last boolean"
)


def _header_text(value: str) -> str:
    """A header value on one line: controls and the percent sign are written as %XX."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def _header_value(text: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), text)


def record_head(page_id, url, size: int, digest: str, refers_to) -> bytes:
    """The WARC header of a page: a response, or a revisit without a payload if ``refers_to`` is given."""
    length = 0 if refers_to is not None else len(HTTP) + size
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}",
    ]
    lines += [f"X-Page-ID: {_header_text(str(page_id))}"] if page_id is not None else []
    lines += [f"WARC-Target-URI: {_header_text(url)}"] if url is not None else []
    if refers_to is not None:
        lines += [f"X-Refers-To-Page-ID: {_header_text(str(refers_to))}",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n"


def write(spark: SparkSession, pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write one record per page into gzip archives under ``folder`` and return their stored manifest.

    Of payloads that are equal and have at least MIN_REVISIT_BYTES bytes, those with the smallest page id are responses and
    all others revisit it; shorter ones are always responses. Rows that repeat the smallest id all stay responses. A
    null id is never the smallest: where all ids are null, all are responses. A null payload is empty.
    """
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("id"), F.col(url).cast("string").alias("url"), data.alias("data"),
                        F.sha2(data, 256).alias("digest"), F.octet_length(data).cast("long").alias("size"))
    repeated = stored(spark, rows.filter(F.col("size") >= MIN_REVISIT_BYTES).groupBy("digest").agg(
        F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"), "repeated")
    refers = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    marked = rows.join(repeated, "digest", "left").select("id", "url", "data", "digest", "size", refers.alias("refers_to"))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        segments, out, at, archive = [], None, 0, 0
        for batch in batches:
            for page_id, address, body, digest, size, refers_to in zip(*batch.columns):
                if out is None:
                    path = f"{name}-{archive}.warc.gz"
                    out, at, first, records = store.open_output_stream(path, compression=None), 0, 0, 0
                at += _save_record(out, record_head(
                    page_id.as_py(), address.as_py(), size.as_py(), digest.as_py(), refers_to.as_py()),
                    memoryview(body.as_buffer()) if refers_to.as_py() is None else None)
                records += 1
                if at - first >= SEGMENT_BYTES:
                    segments.append((path, first, at, records))
                    first, records = at, 0
                if at >= ARCHIVE_BYTES:
                    out.close()
                    segments += [(path, first, at, records)] if records else []
                    out, archive = None, archive + 1
        if out is not None:
            out.close()
            segments += [(path, first, at, records)] if records else []
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("path", "first_byte", "end_byte", "records"), s)) for s in segments],
            pa.schema([("path", pa.string()), ("first_byte", pa.int64()), ("end_byte", pa.int64()), ("records", pa.int64())]))

    return stored(spark, marked.mapInArrow(save, MANIFEST), "manifest")


def _save_record(out, head: bytes, body) -> int:
    """Stream one record as a gzip member; returns its compressed size."""
    gz, size = zlib.compressobj(6, zlib.DEFLATED, 31), 0
    parts = [head] if body is None else [head, HTTP]
    chunks = [] if body is None else (body[i : i + CHUNK_BYTES] for i in range(0, len(body), CHUNK_BYTES))
    for source in (parts, chunks, [b"\r\n\r\n"]):
        for part in source:
            packed = gz.compress(part)
            out.write(packed)
            size += len(packed)
    packed = gz.flush()
    out.write(packed)
    return size + len(packed)


class _Unzipped:
    """Plain bytes of a byte range of gzip members, a buffer at a time."""

    def __init__(self, file, first: int, end: int):
        file.seek(first)
        self.file, self.left, self.gz, self.have, self.packed = file, end - first, zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        while True:
            if not self.packed and self.left:
                self.packed = self.file.read(min(_BUFFER, self.left))
                self.left -= len(self.packed)
            if self.gz.eof:
                self.gz = zlib.decompressobj(31)
            if not self.packed:
                return False
            got = self.gz.decompress(self.packed, _BUFFER)
            self.packed = self.gz.unused_data or self.gz.unconsumed_tail
            if got:
                self.have += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with ``mark``; None at the end."""
        while (at := self.have.find(mark)) < 0:
            if not self._more():
                return None
        got, self.have = self.have[: at + len(mark)], self.have[at + len(mark) :]
        return got

    def take(self, n: int) -> bytes:
        parts, need = [], n
        while need:
            if not self.have and not self._more():
                raise EOFError("archive ends inside a record")
            parts.append(self.have[:need])
            self.have = self.have[len(parts[-1]) :]
            need -= len(parts[-1])
        return b"".join(parts)


def _records(source: _Unzipped, chunk_bytes: int) -> Iterator[dict]:
    """Chunk rows of all records of a segment."""
    while (head := source.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
        got = dict(line.split(": ", 1) for line in lines if line)
        left = int(got["Content-Length"])
        if left:
            left -= len(source.until(b"\r\n\r\n"))
        page_id, url, refers = (
            None if (v := got.get(k)) is None else _header_value(v)
            for k in ("X-Page-ID", "WARC-Target-URI", "X-Refers-To-Page-ID"))
        row = {
            "record_id": got["WARC-Record-ID"], "page_id": page_id, "url": url, "record_type": got["WARC-Type"],
            "refers_to": refers, "declared_bytes": int(got["X-Payload-Length"]),
            "declared_digest": got["WARC-Payload-Digest"].removeprefix("sha256:"),
        }
        digest, chunk, start = hashlib.sha256(), 0, 0
        while True:
            data = source.take(min(chunk_bytes, left))
            left -= len(data)
            digest.update(data)
            yield row | {"chunk": chunk, "chunk_start": start, "data": data, "digest_so_far": digest.copy().hexdigest(), "last": not left}
            chunk, start = chunk + 1, start + len(data)
            if not left:
                break
        source.take(4)


def read(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of all archives a manifest lists, a task for every few segments."""
    schema = pa.schema([
        *[(n, pa.string()) for n in ("record_id", "page_id", "url", "record_type", "refers_to")], ("declared_bytes", pa.int64()),
        ("declared_digest", pa.string()), ("chunk", pa.int32()), ("chunk_start", pa.int64()), ("data", pa.binary()),
        ("digest_so_far", pa.string()), ("last", pa.bool_())])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
                store, where = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_file(where) as file:
                    for row in _records(_Unzipped(file, first, end), chunk_bytes):
                        rows.append(row)
                        size += len(row["data"])
                        if size >= 4 * chunk_bytes or len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    tasks = max(1, min(manifest.count(), 10_000))
    return manifest.select("path", "first_byte", "end_byte").repartition(tasks).mapInArrow(load, CHUNKS)


def record_summary(chunks: DataFrame, id_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per record, from last chunks alone.

    A response's figures are those of the payload read; a revisit's, which has none, those its header declares.
    """
    full, own = F.col("record_type") == "response", F.col("chunk_start") + F.octet_length("data")
    return chunks.filter("last").select(
        F.col("page_id").cast(id_type).alias("page_id"), F.when(full, own).otherwise(F.col("declared_bytes")).cast("long").alias("payload_bytes"),
        F.when(full, F.col("digest_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"), "record_type",
        F.col("refers_to").cast(id_type).alias("refers_to"))


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages and read the archives back."""
    manifest = write(spark, pages, folder or scratch_path(spark, "warc"))
    return record_summary(read(manifest), pages.schema["page_id"].dataType.simpleString())


#: ``round_trip`` in SQL.
SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= {MIN_REVISIT_BYTES} AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {MIN_REVISIT_BYTES} AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
