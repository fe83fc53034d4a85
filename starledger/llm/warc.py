"""WARC archives: writing, normalising monolithic gzip files, reading by offset.

``write_archives`` writes each partition as archives that are one gzip stream each, as
crawlers do that compress a file as a whole. ``normalise`` inflates such a file once, as a
stream, rewrites every record as a gzip member of its own and writes a sidecar
index of offsets. ``read_records`` then reads any run of records by seeking.

Files are written under names that no other task attempt uses. What counts is the
manifest that Spark commits with the rows of the successful attempts, so attempts
that were lost or ran twice leave files that nothing refers to.

Null html is an empty payload. Rows that repeat with one page_id and payload are the
same page and get the same record type; a null page_id is allowed, never
referred to, and refers to nothing unless its payload has a page with an id.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starledger.sources.staging import stage, staging_path

# --- fixed values: names and formats of the archive standard -------------------

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31  # zlib's window bits for a gzip wrapper

ARCHIVE_BYTES = 1 << 30  # records' bytes after which a task begins another archive
SPAN_BYTES = 8 << 20  # compressed bytes of consecutive records that one read takes
READ_BYTES = 1 << 20
BROADCAST_ROWS = 500_000
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "archive string, records long, raw_bytes long"
INDEX = (
    "archive string, record_id string, record_type string, target_uri string,"
    " payload_digest string, offset long, length long, span long"
)
RECORDS = (
    "record_id string, record_type string, target_uri string, payload_bytes long,"
    " payload_digest string, refers_to string"
)
_ARROW = {"string": pa.string(), "long": pa.int64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(",")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _ARROW[k]) for c, k in zip(columns, kinds, strict=True)], list(names)
    )


def resolved(spark: SparkSession, path: str) -> str:
    """A path as Spark's file system understands it, so that tasks open the same one.

    A path without a scheme may be one of HDFS; those of a local file system stay plain.
    """
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    whole = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(found).toString()
    return "/" + whole.removeprefix("file:").lstrip("/") if whole.startswith("file:") else whole


def _open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


# --- record ids ----------------------------------------------------------------


def record_id(page_id: int | None) -> str:
    """A version 8 (custom) UUID that holds the page id, or a random one."""
    if page_id is None:
        return f"<urn:uuid:{uuid.uuid4()}>"
    bits = page_id & 0xFFFFFFFFFFFFFFFF
    value = (bits >> 16 << 80) | (8 << 76) | (0b10 << 62) | (bits & 0xFFFF)
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def page_of(record: str | None) -> int | None:
    """The page id in a record id; none in ids that ``record_id`` did not make from one."""
    if not record:
        return None
    value = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if value >> 76 & 0xF != 8:
        return None
    bits = (value >> 80 << 16) | (value & 0xFFFF)
    return bits - (1 << 64) if bits >> 63 else bits


# --- deciding ------------------------------------------------------------------


def page_records(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = 0,
) -> DataFrame:
    """page_id, url, payload, digest (SHA-1, hex) and keeper, null for a response.

    Digests are grouped without payloads. Only digests that occur more than once
    are joined, and only their revisits meet the wide rows.
    """
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    narrow = stage(rows.where(F.length("payload") >= min_revisit_bytes).select("page_id", "digest"))
    keepers = stage(
        narrow.groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
        .where("copies > 1 AND keeper IS NOT NULL")
        .select("digest", "keeper")
    )
    revisits = stage(
        narrow.join(keepers, "digest")
        .where("page_id IS NULL OR page_id <> keeper")
        .select("page_id", "digest", "keeper")
        .distinct()
    )
    found = F.broadcast(revisits) if revisits.count() <= BROADCAST_ROWS else revisits
    return rows.alias("r").join(
        found.alias("v"),
        F.col("r.page_id").eqNullSafe(F.col("v.page_id")) & (F.col("r.digest") == F.col("v.digest")),
        "left",
    ).select("r.*", "v.keeper")


# --- writing -------------------------------------------------------------------


def _record(row: dict) -> bytes:
    payload, revisit = row["payload"], row["keeper"] is not None
    http = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        b"Content-Length: %d\r\n\r\n" % len(payload)
    )
    block = http if revisit else http + payload
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    uri = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in row["url"] or "")
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(row["page_id"])),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", REVISIT_PROFILE if revisit else ""),
        ("WARC-Refers-To", record_id(row["keeper"]) if revisit else ""),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers if v)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(
    records: DataFrame, folder: str, *, archive_bytes: int = ARCHIVE_BYTES, level: int = 1
) -> DataFrame:
    """Write ``page_records`` as monolithic gzip archives; returns the manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open_fs(folder)
        out = None
        path, deflate, count, raw = "", None, 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                    deflate, count, raw = zlib.compressobj(level, zlib.DEFLATED, GZIP), 0, 0
                data = _record({c: batch.column(c)[i].as_py() for c in batch.schema.names})
                out.write(deflate.compress(data))
                count, raw = count + 1, raw + len(data)
                if raw >= archive_bytes:
                    out.write(deflate.flush())
                    out.close()
                    out = None
                    yield _batch([(f"{folder}/{path.rpartition('/')[2]}", count, raw)], MANIFEST)
        if out is not None:
            out.write(deflate.flush())
            out.close()
            yield _batch([(f"{folder}/{path.rpartition('/')[2]}", count, raw)], MANIFEST)

    folder = resolved(records.sparkSession, folder)
    return stage(records.mapInArrow(write, MANIFEST))


# --- reading a stream of records -----------------------------------------------


class _Inflated:
    """Bytes of a gzip file, inflated as they are asked for; members may follow each other."""

    def __init__(self, source):
        self._source, self._inflate = source, zlib.decompressobj(GZIP)
        self._ready, self._left, self._begun = bytearray(), b"", False

    def _more(self) -> bool:
        data = self._left or self._source.read(READ_BYTES)
        self._left = b""
        if not data:
            if self._begun and not self._inflate.eof:
                raise ValueError("the archive ends inside its gzip stream")
            return False
        self._begun = True
        if self._inflate.eof:
            data = data.lstrip(b"\0")  # padding between members
            if not data:
                return True
            self._inflate = zlib.decompressobj(GZIP)
        self._ready += self._inflate.decompress(data, 4 * READ_BYTES)
        self._left = self._inflate.unconsumed_tail or self._inflate.unused_data
        return True

    def until(self, end: bytes) -> bytes:
        """Bytes up to and with ``end``; empty at the end of the file."""
        seen = 0
        while (at := self._ready.find(end, max(0, seen - len(end)))) < 0:
            seen = len(self._ready)
            if not self._more():
                if self._ready.strip(b"\r\n"):
                    raise ValueError("the archive ends inside a record")
                return b""
        return self._take(at + len(end))

    def blocks(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes, piecewise."""
        while size:
            if not self._ready and not self._more():
                raise ValueError("the archive ends inside a record")
            if piece := self._take(min(size, len(self._ready))):
                size -= len(piece)
                yield piece

    def _take(self, size: int) -> bytes:
        data = bytes(memoryview(self._ready)[:size])
        del self._ready[:size]
        return data


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode().strip("\r\n").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def normalise(manifest: DataFrame, folder: str, *, span_bytes: int = SPAN_BYTES, level: int = 6) -> DataFrame:
    """Rewrite each archive with one gzip member a record; returns the index.

    Each archive is inflated once, as a stream, by one task; a record is held in pieces
    of bounded size. A stream that is cut, even between
    records, and a number of records other than the manifest's are errors. Beside ``x.warc.gz`` stands ``x.cdxj``: one line a record with
    its offset and length. Rows of the index also tell the run of records (span) to read.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from rewrite_one(archive, records)

    def rewrite_one(archive: str, records: int | None) -> Iterator[pa.RecordBatch]:
        store, path = _open_fs(archive)
        target_store, root = _open_fs(folder)
        target_store.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        rows, offset, span, count = [], 0, 0, 0
        with (
            store.open_input_stream(path, compression=None) as source,
            target_store.open_output_stream(f"{root}/{name}.warc.gz", compression=None) as out,
            target_store.open_output_stream(f"{root}/{name}.cdxj") as sidecar,
        ):
            stream = _Inflated(source)
            while head := stream.until(b"\r\n\r\n"):
                head = head.lstrip(b"\r\n")
                fields = _headers(head)
                deflate = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                length = out.write(deflate.compress(head)) or 0
                for piece in stream.blocks(int(fields["content-length"])):
                    length += out.write(deflate.compress(piece)) or 0
                if b"".join(stream.blocks(4)) != b"\r\n\r\n":
                    raise ValueError(f"a record of {archive} does not end where it says")
                length += out.write(deflate.compress(b"\r\n\r\n") + deflate.flush()) or 0
                if offset - span >= span_bytes:
                    span = offset
                entry = (
                    fields.get("warc-record-id"),
                    fields.get("warc-type"),
                    fields.get("warc-target-uri"),
                    fields.get("warc-payload-digest", "").rpartition(":")[2] or None,
                )
                told = {"id": entry[0], "type": entry[1], "digest": entry[3]}
                told |= {"filename": f"{name}.warc.gz", "offset": offset, "length": length}
                sidecar.write(f"{entry[2] or '-'} {DATE} {json.dumps(told)}\n".encode())
                rows.append((f"{folder}/{name}.warc.gz", *entry, offset, length, span))
                offset, count = offset + length, count + 1
                if len(rows) >= 10_000:
                    yield _batch(rows, INDEX)
                    rows = []
        if records is not None and count != records:
            raise ValueError(f"{archive} has {count} records, not {records}")
        yield _batch(rows, INDEX)

    folder = resolved(manifest.sparkSession, folder)
    spread = manifest.select("archive", "records").repartition(max(1, manifest.count()), "archive")
    return stage(spread.mapInArrow(rewrite, INDEX))


def _read_member(data: memoryview) -> tuple[tuple, int]:
    """A record's row and the bytes that its member takes."""
    inflate, taken, parts = zlib.decompressobj(GZIP), 0, []
    while not inflate.eof:
        piece = data[taken : taken + (1 << 16)]
        parts.append(inflate.decompress(piece))
        taken += len(piece)
    record = b"".join(parts)
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _headers(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = len(payload), fields.get("warc-payload-digest", "").rpartition(":")[2] or None
    if fields["warc-type"] == "revisit":
        size = int(_headers(http).get("content-length", 0))
    else:
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    row = (
        fields.get("warc-record-id"),
        fields["warc-type"],
        fields.get("warc-target-uri"),
        size,
        digest,
        fields.get("warc-refers-to"),
    )
    return row, taken - len(inflate.unused_data)


def read_records(index: DataFrame) -> DataFrame:
    """Every record of the index, read by seeking to its span.

    Digest and size are those of the payload as read; a revisit, which has no payload
    of its own, tells them in its headers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, path = _open_fs(archive)
                with store.open_input_file(path) as source:
                    source.seek(start)
                    data = source.read(length)
                rows, at = [], memoryview(data)
                while at:
                    row, taken = _read_member(at)
                    rows.append(row)
                    at = at[taken:]
                yield _batch(rows, RECORDS)

    spans = (
        index.groupBy("archive", "span")
        .agg(F.sum("length").alias("length"))
        .select("archive", F.col("span").alias("start"), "length")
    )
    return spans.repartition("archive", "start").mapInArrow(read, RECORDS)


def archive_pages(
    pages: DataFrame,
    folder: str | None = None,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Write pages, normalise the archives; returns the index and the records read back."""
    folder = folder or staging_path(pages.sparkSession)
    rows = page_records(
        pages, id_col=id_col, url_col=url_col, html_col=html_col, min_revisit_bytes=min_revisit_bytes
    )
    index = normalise(write_archives(rows, f"{folder}/crawl"), f"{folder}/normal")
    return index, read_records(index)
