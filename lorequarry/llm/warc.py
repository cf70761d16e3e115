"""WARC archives: one gzip member per record, read back sequentially."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import fresh_path, materialize

READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
#: Tasks that read archives, at most; a task reads several archives one after the other.
MAX_TASKS = 20_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that breaks off, isn't framed as it says, or doesn't have the digests it says."""


def open_filesystem(uri: str):
    """A file system and the path there, for file paths and for URIs of stores that pyarrow knows."""
    from pyarrow import fs

    uri = uri.replace("s3a://", "s3://", 1)
    return fs.FileSystem.from_uri(uri)


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A record as one gzip member. A revisit has the payload's digest and length but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).digest())}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    zip_ = zlib.compressobj(6, zlib.DEFLATED, 31)
    return zip_.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + zip_.compress(block) + zip_.compress(b"\r\n\r\n") + zip_.flush()


def inflated(stream, chunk: int = 1 << 18) -> Iterator[bytes | None]:
    """The stream's data, decompressed bit by bit; None after each gzip member."""
    data, member = b"", None
    while True:
        data = data or stream.read(chunk)
        if not data:
            if member is not None:
                raise WarcError("the archive ends within a gzip member")
            return
        member = member or zlib.decompressobj(31)
        try:
            out = member.decompress(data, chunk)
        except zlib.error as e:
            raise WarcError(f"not a gzip member: {e}") from e
        if out:
            yield out
        if member.eof:
            data, member = member.unused_data, None
            yield None
        else:
            data = member.unconsumed_tail


class RecordReader:
    """Takes one record's data piece by piece; holds its headers, and the payload only if asked to."""

    def __init__(self, keep: bool):
        self.keep, self.head, self.headers, self.left = keep, b"", None, 0
        self.http, self.block, self.payload, self.bytes, self.kept, self.tail = b"", hashlib.sha1(), hashlib.sha1(), 0, [], b""

    def feed(self, data: bytes) -> None:
        if self.headers is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            version, *lines = self.head[:end].decode().split("\r\n")
            if not version.startswith("WARC/"):
                raise WarcError(f"not a record: {version[:40]}")
            self.headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            self.left = int(self.headers["content-length"])
            data, self.head = self.head[end + 4 :], b""
        body, rest = data[: self.left], data[self.left :]
        self.left -= len(body)
        self.block.update(body)
        if self.http is not None:
            self.http += body
            end = self.http.find(b"\r\n\r\n")
            if end >= 0:
                fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in self.http[:end].decode().split("\r\n")[1:])}
                self.full, body, self.http = int(fields["content-length"]), self.http[end + 4 :], None
            else:
                body = b""
        self.payload.update(body)
        self.bytes += len(body)
        if self.keep and body:
            self.kept.append(body)
        self.tail += rest

    def row(self) -> tuple:
        h = self.headers
        if h is None or self.left or self.http is not None or self.tail != b"\r\n\r\n":
            raise WarcError("a record isn't as long as its content-length says")
        if h["warc-block-digest"] != f"sha1:{b32(self.block.digest())}":
            raise WarcError(f"the block digest of {h['warc-record-id']} doesn't hold")
        kind, digest = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and (self.bytes != self.full or digest != b32(self.payload.digest())):
            raise WarcError(f"the payload digest of {h['warc-record-id']} doesn't hold")
        number = lambda name: int(x) if (x := h.get(name, "")[len("<urn:page:") : -1]) else None
        return (number("warc-record-id"), h["warc-target-uri"], self.full, digest, kind, number("warc-refers-to"), b"".join(self.kept) if self.keep and kind == "response" else None)


def read_records(stream, keep: bool = False) -> Iterator[tuple]:
    """A row (READ_SCHEMA) for each record of a .warc.gz stream, in its order. Raises WarcError where it is damaged."""
    reader = None
    for data in inflated(stream):
        if data is None:
            yield (reader or RecordReader(keep)).row()
            reader = None
        else:
            reader = reader or RecordReader(keep)
            reader.feed(data)


def with_revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, html (null: empty), digest (hex SHA-1), and the page that has the same payload first, if that is another.

    Only the narrow table of ids and digests is grouped; a payload that very many pages share is one row per page there.
    """
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha1("html"))
    narrow = base.where(F.octet_length("html") >= min_revisit_bytes).select("page_id", "digest")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = narrow.join(first, "digest").where("page_id <> first").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("first").alias("refers_to")).distinct()
    return base.join(again, (F.col("page_id") == F.col("p")) & (F.col("digest") == F.col("d")), "left").drop("p", "d")


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, roll_bytes: int = 64 << 20) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) to .warc.gz files under path; returns (file, records, bytes).

    path must be reachable from every executor. The returned manifest has just the files of the task attempts that
    Spark committed; files that a lost or repeated attempt left are not in it and are never read.
    """
    rows = with_revisits(pages, min_revisit_bytes)

    def run(batches):
        import uuid

        import pyarrow as pa

        store, top = open_filesystem(path)
        store.create_dir(top, recursive=True)
        out = name = None
        count = size = 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"file": [f"{path}/{name}"], "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            ids, urls, html, digests, refers = (batch.column(i) for i in range(5))
            for i in range(batch.num_rows):
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                first = refers[i].as_py()
                data = record(ids[i].as_py(), urls[i].as_py(), html[i].as_buffer().to_pybytes(), b32(bytes.fromhex(digests[i].as_py())), first, first is not None)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= roll_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    written = rows.select("page_id", "url", F.col("html").cast("binary"), "digest", "refers_to").mapInArrow(run, "file string, records long, bytes long")
    return materialize(written, "warc-manifest")


def read_archives(files: DataFrame, payload: bool = False) -> DataFrame:
    """A row for each record of the archives in column file; see READ_SCHEMA. Payloads are returned for responses only, if asked for."""

    def run(batches):
        import pyarrow as pa

        fields = [f.split() for f in READ_SCHEMA.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, at = open_filesystem(uri)
                rows, held = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for row in read_records(stream, payload):
                        rows.append(row)
                        held += 1 + len(row[-1] or b"") // 4096
                        if held >= 4096:
                            yield table(rows)
                            rows, held = [], 0
                if rows:
                    yield table(rows)

    n = max(1, min(files.count(), MAX_TASKS))
    return files.select("file").repartition(n).mapInArrow(run, READ_SCHEMA)


def round_trip(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0, payload: bool = False) -> DataFrame:
    """Pages written as archives in the shared folder and read back.

    Null html: an empty payload. Of the rows with equal payloads of at least min_revisit_bytes bytes those with the
    smallest page_id are responses, all others revisit it; rows equal in page_id and html have the same role. A page
    without page_id keeps a null id and is always a response. An empty table writes no archive and gives no rows.
    Columns other than page_id, url and html are ignored.
    """
    return read_archives(write_archives(pages, fresh_path(spark, "warc"), min_revisit_bytes), payload)
