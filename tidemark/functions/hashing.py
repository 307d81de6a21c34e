"""64-bit ring hashes with unsigned wrap-around, vectorised over Arrow batches.

Spark's own arithmetic raises on overflow, so the multiplications are done in numpy. A hash is a BIGINT with the same
bits; ``ordered`` turns it into one whose signed order is the unsigned order, ``unsigned`` into its decimal value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import active

#: FNV-1a's offset and prime, and splitmix64's increment and multipliers.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211
INCREMENT, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SIGN = -(2**63)


def fnv64_array(keys: list[bytes]) -> np.ndarray:
    """FNV-1a of each key: one step over all keys for each byte position, longest keys last."""
    lengths = np.fromiter(map(len, keys), np.int64, len(keys))
    order = np.argsort(-lengths, kind="stable")
    data = np.frombuffer(b"".join(keys), np.uint8)
    starts = np.cumsum(lengths) - lengths
    out = np.full(len(keys), FNV_OFFSET, np.uint64)
    ranked = lengths[order]
    for place in range(int(ranked[0]) if len(keys) else 0):
        at = order[: np.searchsorted(-ranked, -place, "left")]
        out[at] = (out[at] ^ data[starts[at] + place]) * np.uint64(FNV_PRIME)
    return out


def mix64_array(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(INCREMENT)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def _bytes(values: pd.Series) -> list[bytes]:
    return [b"" if v is None else v.encode() if isinstance(v, str) else bytes(v) for v in values]


def hash64_array(keys: list[bytes]) -> np.ndarray:
    return mix64_array(fnv64_array(keys))


def fnv64(key: Column) -> Column:
    """FNV-1a of a string or binary; null stays null."""
    active()

    @F.pandas_udf("bigint")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(fnv64_array(_bytes(values)).view(np.int64), dtype="Int64").where(values.notna().to_numpy())

    return run(key)


def hash64(key: Column) -> Column:
    """The ring's hash of a string or binary; null stays null."""
    active()

    @F.pandas_udf("bigint")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(hash64_array(_bytes(values)).view(np.int64), dtype="Int64").where(values.notna().to_numpy())

    return run(key)


def ordered(h: Column) -> Column:
    return h.bitwiseXOR(F.lit(SIGN))


def unsigned(h: Column) -> Column:
    d = h.cast("decimal(20,0)")
    return F.when(h < 0, d + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


def unsigned_mod(h: Column, n: int) -> Column:
    """The unsigned value modulo ``n``; for a power of two, the low bits."""
    if n & (n - 1) == 0:
        return h.bitwiseAND(F.lit(n - 1))
    half = F.shiftrightunsigned(h, 1) % n
    return (half * 2 + h.bitwiseAND(F.lit(1))) % n
