"""WARC archives of web pages: a writer with one gzip member per record, and a sequential reader.

The reader inflates a member piece by piece, frames its block by Content-Length, and checks the block's and payload's
digests; it never needs more than one record in memory. Archives are written to a folder that all executors see, through
the file system that the folder's scheme names. A writing task gives each file a new name and reports it only when it is
complete, so files of lost tasks are never read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, checkpoint_root, map_arrow, on_store, salted_lookup, slices, staged

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTENT_TYPE = "application/http; msgtype=response"
#: Bytes read at once, and compressed bytes after which a writer begins another file.
CHUNK, FILE_BYTES = 1 << 16, 32 << 20
#: Payloads below this size are always stored.
LEAST_REVISIT = 100
ID_PREFIX = "urn:page:"

FILES = "path string, records bigint"
RECORDS = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]

    def http(self) -> tuple[dict[str, str], bytes]:
        """The HTTP header fields of the block, and what follows them."""
        head, _, body = self.block.partition(b"\r\n\r\n")
        return fields(head.split(b"\r\n")[1:]), body


def fields(lines: Iterable[bytes]) -> dict[str, str]:
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines if x)}


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str, date: str) -> bytes:
    """A record as a gzip member: a response with its payload, or a revisit of another one without it."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID_PREFIX}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{sha256(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += [f"Content-Type: {CONTENT_TYPE}", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(VERSION + b"\r\n" + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n") + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def read_records(stream: BinaryIO, name: str = "archive") -> Iterator[Record]:
    """The records of an archive, in order. Raises ValueError at a damaged, truncated or wrongly framed one."""
    data, place = stream.read(CHUNK), 0
    while data:
        inflate, out, need, head = zlib.decompressobj(31), bytearray(), None, {}
        while not inflate.eof:
            if not data:
                raise ValueError(f"{name}: record {place} is cut short")
            try:
                out += inflate.decompress(data)
            except zlib.error as e:
                raise ValueError(f"{name}: record {place}: {e}") from e
            data = inflate.unused_data if inflate.eof else stream.read(CHUNK)
            if need is None and (end := out.find(b"\r\n\r\n")) >= 0:
                lines = bytes(out[:end]).split(b"\r\n")
                head = fields(lines[1:])
                if not lines[0].startswith(b"WARC/") or not head.get("content-length", "").isdigit():
                    raise ValueError(f"{name}: record {place} has no version or length")
                del out[: end + 4]
                need = int(head["content-length"])
            if need is not None and len(out) > need + 4:
                raise ValueError(f"{name}: record {place} is longer than its length")
        if need is None or len(out) != need + 4 or out[need:] != b"\r\n\r\n":
            raise ValueError(f"{name}: record {place} does not have its length")
        record = Record(head, bytes(out[:need]))
        stated = head.get("warc-block-digest")
        if stated and stated != f"sha256:{sha256(record.block)}":
            raise ValueError(f"{name}: record {place} does not have its block's digest")
        if record.kind == "response" and (stated := head.get("warc-payload-digest")) and stated != f"sha256:{sha256(record.http()[1])}":
            raise ValueError(f"{name}: record {place} does not have its payload's digest")
        yield record
        place += 1
        data = data or stream.read(CHUNK)


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def with_originals(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, html, digest, refers_to``: ``refers_to`` is the smallest id of pages with an equal payload of at
    least ``least`` bytes, null on that page itself and on all without an equal."""
    text = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", text.alias("html"), F.sha2(text, 256).alias("digest"))
    keys = pages.select("page_id", F.sha2(text, 256).alias("digest"), F.octet_length(text).alias("size")).where(F.col("size") >= least)
    shared = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first", "n")
    joined = salted_lookup(rows, shared, ["digest"], ["page_id", "url"], count="n", total=pages.count())
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) under ``folder``, a URI that every executor sees.

    Returns the table of complete files (path, records), which is written first. Null html is an empty payload, null
    urls are left out, null ids make records without one. Rows repeated with one id are all written; those that have the
    smallest id of an equal payload are all responses. An empty table makes no file.
    """
    schema = arrow_schema(FILES)
    where, store = on_store(pages.sparkSession, folder)
    store.mkdirs(where)
    folder = store.makeQualified(where).toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size, records = None, "", 0, 0
        for batch in batches:
            for part in slices(batch, "html"):
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if out is None:
                        path, size, records = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        fs, local = filesystem(path)
                        out = fs.open_output_stream(local, compression=None)
                    size += out.write(data := member(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, digest, date)) or len(data)
                    records += 1
                    if size >= file_bytes:
                        out.close()
                        out = None
                        yield batch_of(schema, [[path], [records]])
        if out is not None:
            out.close()
            yield batch_of(schema, [[path], [records]])

    return staged(map_arrow(with_originals(pages), run, FILES), "warc-files")


def page_of(reference: str | None) -> int | None:
    """The page's id in a record's id, if it has one."""
    digits = (reference or "").strip("<>").removeprefix(ID_PREFIX)
    return int(digits) if digits.lstrip("-").isdigit() else None


def read_warc(files: DataFrame) -> DataFrame:
    """The records of archives (path), one row each: id, url, payload (empty for a revisit), the full payload's size and
    digest, ``response`` or ``revisit``, and the page that a revisit refers to. Each file is one task's work."""
    schema = arrow_schema(RECORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, local = filesystem(path)
                rows, size = [], 0
                with fs.open_input_stream(local, compression=None) as stream:
                    for record in read_records(stream, path):
                        http, body = record.http()
                        url = record.headers.get("warc-target-uri")
                        url = url if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                        digest = record.headers["warc-payload-digest"].removeprefix("sha256:")
                        rows.append((page_of(record.headers.get("warc-record-id")), url, body, int(http["content-length"]), digest, record.kind, page_of(record.headers.get("warc-refers-to"))))
                        size += len(body) + 200
                        if size > 4_000_000:
                            yield batch_of(schema, [list(c) for c in zip(*rows, strict=True)])
                            rows, size = [], 0
                if rows:
                    yield batch_of(schema, [list(c) for c in zip(*rows, strict=True)])

    n = max(1, files.count())
    return map_arrow(files.select("path").repartition(n), run, RECORDS)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back: a row per page, without its payload.

    These archives go when the driver's JVM ends.
    """
    folder = f"{checkpoint_root(pages.sparkSession)}/tidemark-warc-{uuid.uuid4().hex}"
    files = write_warc(pages, folder)
    where, store = on_store(pages.sparkSession, folder)
    store.deleteOnExit(where)
    return read_warc(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
