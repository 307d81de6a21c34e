"""The stored form of a version: JSON of its value in base64 (v), clock (c), timestamp (t) and deleted flag (d).

Empty values, empty clocks and a false flag are left out, so an absent and an empty value are the same, as are their
stored forms; counters are in the order of their nodes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clocks import clock as clock_of

STORED = "v string, c map<string,bigint>, t bigint, d boolean"


def base64_text(value: Column) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(value.cast("binary")), "[\r\n]", "")


def encode(val: Column, clock: Column, ts: Column, deleted: Column) -> Column:
    """One text for each version, in which no two different versions agree; null without a timestamp."""
    counters = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(clock_of(clock)))))
    for sign, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        counters = F.replace(counters, F.lit(sign), F.lit(code))
    value = F.when(F.octet_length(val) > 0, F.concat(F.lit('"v":"'), base64_text(val), F.lit('",'))).otherwise("")
    known = F.when(F.size(clock_of(clock)) > 0, F.concat(F.lit('"c":'), counters, F.lit(","))).otherwise("")
    return F.concat(F.lit("{"), value, known, F.lit('"t":'), ts.cast("string"), F.when(deleted, ',"d":true').otherwise(""), F.lit("}"))


def decode(stored: Column) -> Column:
    """The version (val binary, clock, ts, deleted) of a stored text; null if it is not readable. An absent value is empty."""
    j = F.from_json(stored, STORED)
    value = F.coalesce(F.try_to_binary(j["v"], F.lit("base64")), F.unhex(F.lit("")))
    readable = stored.isNotNull() & F.coalesce(F.get_json_object(stored, "$").startswith("{"), F.lit(False)) & (j["v"].isNull() | F.try_to_binary(j["v"], F.lit("base64")).isNotNull())
    version = F.struct(value.alias("val"), clock_of(j["c"]).alias("clock"), F.coalesce(j["t"], F.lit(0).cast("bigint")).alias("ts"), F.coalesce(j["d"], F.lit(False)).alias("deleted"))
    return F.when(readable, version)
