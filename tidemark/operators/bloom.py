"""Bloom filters as tables of set bits, with the stored form's sizing and double hashing."""

from __future__ import annotations

import math
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fnv64, fnv64_array


def sizing(n: int, p: float = 0.01) -> tuple[int, int]:
    """Bits and hashes for ``n`` keys at a false-positive rate of ``p``; bad arguments fall back to 1 key and 0.01."""
    n, p = max(n, 1), p if 0 < p < 1 else 0.01
    bits = max(8, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    bits = (bits + 7) // 8 * 8
    return bits, max(1, math.floor(bits / n * math.log(2) + 0.5))


def places(hashes: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The ``k`` bits of each 64-bit hash, as rows."""
    low, high = hashes & np.uint64(0xFFFFFFFF), np.maximum(hashes >> np.uint64(32), np.uint64(1))
    step = np.arange(k, dtype=np.uint64)[None, :] * high[:, None]
    return (((low[:, None] + step) & np.uint64(0xFFFFFFFF)) % np.uint64(bits)).astype(np.int64)


def pack(hashes: np.ndarray, bits: int, k: int) -> bytes:
    """A filter over hashes as it is stored: bits, hashes, and the bits from the lowest of each byte on."""
    held = np.zeros(bits, np.uint8)
    held[places(hashes, bits, k).ravel()] = 1
    return struct.pack("<II", bits, k) + np.packbits(held, bitorder="little").tobytes()


def load(data: bytes) -> tuple[int, int, np.ndarray]:
    """Number of bits, number of hashes, and the bits of a stored filter; a wrong length or no hash is an error."""
    if len(data) < 8:
        raise ValueError("a filter needs eight bytes at least")
    bits, k = struct.unpack_from("<II", data)
    if len(data) - 8 != bits // 8 or not k or not bits:
        raise ValueError("a filter without hashes or of another length than it says")
    return bits, k, np.unpackbits(np.frombuffer(data, np.uint8, offset=8), bitorder="little")


def may_contain(data: bytes, keys: list[bytes]) -> np.ndarray:
    """For each key whether a stored filter may have it."""
    bits, k, held = load(data)
    return held[places(fnv64_array(keys), bits, k)].all(1) if keys else np.zeros(0, bool)


def stored(filter_bits: DataFrame, bits: int, hashes: int) -> DataFrame:
    """``filter``: a table of set bits (bit) in stored form, as one row of ``bits`` / 8 bytes."""
    # A number of eight bits for each byte; empty bytes are filled in.
    byte = filter_bits.groupBy(F.expr("bit div 8").alias("i")).agg(F.expr("sum(shiftleft(1, cast(bit % 8 as int)))").alias("b"))
    every = filter_bits.sparkSession.range(bits // 8).select(F.col("id").alias("i")).join(byte, "i", "left").select("i", F.lpad(F.hex(F.coalesce("b", F.lit(0))), 2, "0").alias("h"))
    head = struct.pack("<II", bits, hashes).hex().upper()
    return every.groupBy().agg(F.unhex(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]), ""))).alias("filter"))


def bits_of(keys: DataFrame, bits: int, hashes: int) -> DataFrame:
    """``key, bit``: two 32-bit halves of a key's hash, combined with 32-bit wrap-around, for each hash function."""
    h = keys.where(F.col("key").isNotNull()).select("key", fnv64(F.col("key")).alias("h"))
    low, high = F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("h", 32)
    rows = h.select("key", low.alias("low"), F.greatest(high, F.lit(1)).alias("high"), F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))).alias("i"))
    return rows.select("key", ((F.col("low") + F.col("i") * F.col("high")) % (1 << 32) % bits).alias("bit"))


def build(keys: DataFrame, bits: int, hashes: int) -> DataFrame:
    """The set bits, each once; combined in each task before the shuffle."""
    return bits_of(keys, bits, hashes).select("bit").distinct()


def probe(filter_bits: DataFrame, probes: DataFrame, bits: int, hashes: int) -> DataFrame:
    """``key, may_contain`` of each distinct probe: false means certainly absent. Null keys are in no filter."""
    asked = bits_of(probes.select("key").distinct(), bits, hashes)
    hit = asked.join(filter_bits.withColumn("hit", F.lit(1)), "bit", "left")
    return hit.groupBy("key").agg((F.min(F.coalesce("hit", F.lit(0))) == 1).alias("may_contain"))
