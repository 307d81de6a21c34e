"""A replica's view of its engine: stored versions read, scanned and shown, and values as clients send them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import versions
from . import changelog
from .resolve import VERSION


def stored_log(written: DataFrame) -> DataFrame:
    """Change records (seq, key, kind, val) that store versions (seq, key, val, clock, ts, deleted): a logical tombstone is a
    set as well, since its clock has to survive."""
    return written.select("seq", "key", F.lit(changelog.SET).alias("kind"), versions.encode(*map(F.col, VERSION)).alias("val"))


def _decoded(rows: DataFrame) -> DataFrame:
    v = versions.decode(F.col("val"))
    checked = F.when(F.col("val").isNotNull() & v.isNull(), F.raise_error(F.concat(F.lit("unreadable version of key "), F.col("key").cast("string")))).otherwise(v)
    return rows.withColumn("_v", checked)


def replica_read(log: DataFrame, requests: DataFrame) -> DataFrame:
    """``key, found`` and the version (val binary, clock, ts, deleted) of each requested key; an unreadable one is an error."""
    got = _decoded(changelog.multi_get(log, requests))
    return got.select("key", "found", *(F.col(f"_v.{c}").alias(c) for c in VERSION))


def replica_scan(log: DataFrame, scope: Column | None = None) -> DataFrame:
    """``key`` and version of all live records whose key is in ``scope``; logical tombstones are included."""
    rows = changelog.live(changelog.newest(log.select("seq", "key", "kind", "val") if scope is None else log.select("seq", "key", "kind", "val").where(scope)))
    return _decoded(rows).select("key", *(F.col(f"_v.{c}").alias(c) for c in VERSION))


def shown_value(value: Column) -> Column:
    """What a client is shown of a value: base64, and the text if the bytes are valid UTF-8."""
    raw = value.cast("binary")
    return F.struct(versions.base64_text(raw).alias("value_base64"), F.try_validate_utf8(raw.cast("string")).alias("value"))


def decoded_value(value: Column, value_base64: Column) -> Column:
    """What a client sent, as a struct of ``bytes`` and ``error``: exactly one of the two has to be there, and base64 has to
    be readable."""
    raw = F.try_to_binary(value_base64, F.lit("base64"))
    error = (
        F.when(value.isNotNull() & value_base64.isNotNull(), "provide exactly one of value or value_base64")
        .when(value.isNull() & value_base64.isNull(), "provide value or value_base64")
        .when(value_base64.isNotNull() & raw.isNull(), "value_base64 is not valid base64")
    )
    return F.struct(F.when(error.isNull(), F.coalesce(value.cast("binary"), raw)).alias("bytes"), error.alias("error"))
