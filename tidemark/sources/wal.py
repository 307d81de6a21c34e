"""The write-ahead log: frames of length, checksum and payload, and their replay."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import share_code

MAX_PAYLOAD = 64 << 20
RECORDS = "segment bigint, seq bigint, kind int, key binary, val binary"


def uvarint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def read_uvarint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("cut varint")
        value |= (data[at] & 0x7F) << shift
        at += 1
        if data[at - 1] < 0x80:
            return value, at
        shift += 7


def encode_record(seq: int, kind: int, key: bytes, val: bytes) -> bytes:
    return uvarint(seq) + bytes([kind]) + uvarint(len(key)) + key + uvarint(len(val)) + val


def decode_record(payload: bytes) -> tuple[int, int, bytes, bytes]:
    seq, at = read_uvarint(payload, 0)
    if at >= len(payload) or payload[at] not in (1, 2):
        raise ValueError("bad kind")
    kind = payload[at]
    parts = []
    at += 1
    for _ in range(2):
        n, at = read_uvarint(payload, at)
        if at + n > len(payload):
            raise ValueError("cut field")
        parts.append(payload[at : at + n])
        at += n
    return seq, kind, parts[0], parts[1]


def frame(payload: bytes) -> bytes:
    return struct.pack("<II", len(payload), zlib.crc32(payload)) + payload


def replay(data: bytes) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Records up to the first short, empty, oversized, damaged or undecodable frame; all after it is dropped."""
    at = 0
    while at + 8 <= len(data):
        n, crc = struct.unpack_from("<II", data, at)
        payload = data[at + 8 : at + 8 + n]
        if n == 0 or n > MAX_PAYLOAD or len(payload) < n or zlib.crc32(payload) != crc:
            return
        try:
            yield decode_record(payload)
        except ValueError:
            return
        at += 8 + n


def write_segments(records: DataFrame, folder: str) -> DataFrame:
    """Append records (segment, seq, kind, key, val) as log segments ``NNNNNN.wal`` in a folder that all executors see:
    ``segment, path, frames, bytes``.

    A segment, which rotation keeps small, is one task's work, in the order of its sequence numbers. It is written under
    another name first, so a task that is lost leaves no half segment; an existing segment is replaced.
    """
    share_code(records.sparkSession)
    rows = records.select("segment", "seq", "kind", F.col("key").cast("binary").alias("key"), F.col("val").cast("binary").alias("val"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, data, frames, done = None, [], 0, []

        def close() -> None:
            if current is not None:
                content, name = b"".join(data), f"{int(current):06d}.wal"
                put_file(folder, name, content)
                done.append((int(current), f"{folder}/{name}", frames, len(content)))

        for part in parts:
            for segment, seq, kind, key, val in zip(*(part[c] for c in ("segment", "seq", "kind", "key", "val")), strict=True):
                if segment != current:
                    close()
                    current, data, frames = segment, [], 0
                data.append(frame(encode_record(int(seq), int(kind), bytes(key or b""), bytes(val or b""))))
                frames += 1
        close()
        yield pd.DataFrame(done, columns=["segment", "path", "frames", "bytes"])

    return rows.repartition("segment").sortWithinPartitions("segment", "seq").mapInPandas(run, "segment bigint, path string, frames bigint, bytes bigint")


def put_file(folder: str, name: str, content: bytes) -> None:
    """Write a whole file under a name of its own and then give it its name."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at)
    part = f"{at}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part, compression=None) as out:
        out.write(content)
    store.move(part, f"{at}/{name}")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The records of the log segments (``NNNNNN.wal``) in a folder; other files are ignored. A segment, which rotation
    keeps small, is one task's work."""
    share_code(spark)
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"/(\d+)\.wal$", 1).alias("number"), "content").where("number <> ''")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(int(n), *record) for n, content in zip(part["number"], part["content"], strict=True) for record in replay(bytes(content))]
            yield pd.DataFrame(rows, columns=["segment", "seq", "kind", "key", "val"])

    return files.mapInPandas(run, RECORDS)


def valid_frames(frames: DataFrame) -> DataFrame:
    """Of frames as rows (segment, pos, len, crc, payload), those before the first bad one of their segment."""
    bad = (F.col("len") <= 0) | (F.col("len") > MAX_PAYLOAD) | (F.octet_length("payload") < F.col("len")) | (F.crc32("payload") != F.col("crc"))
    first = F.min(F.when(F.coalesce(bad, F.lit(True)), F.col("pos"))).over(W.partitionBy("segment"))
    return frames.withColumn("_bad", first).where("_bad is null or pos < _bad").drop("_bad")
