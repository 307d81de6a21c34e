"""Metric text, label lists and node lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_labels(text: Column) -> Column:
    """A label list as a map: commas inside quotes do not split, names and values are trimmed, quotes go, nothing is
    unescaped. Later labels of a name win; entries without ``=`` or name are skipped."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r'((?:[^,"]|"[^"]*"?)+)'), 1)
    pairs = F.filter(F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)), r'^"+|"+$', "").alias("v"), F.instr(p, "=").alias("at"))), lambda e: (e["at"] > 0) & (e["k"] != ""))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])))


def parse_samples(lines: DataFrame) -> DataFrame:
    """``name, labels, value`` of metric lines (line, and any other columns, which are kept); comments, blank and
    unreadable lines are skipped, and a timestamp after the value is ignored."""
    rest = [c for c in lines.columns if c != "line"]
    line = F.trim("line")
    rows = lines.select(*rest, line.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    braced = F.instr("line", "{") > 0
    name = F.when(braced, F.trim(F.substring_index("line", "{", 1))).otherwise(F.regexp_extract("line", r"^(\S+)\s+\S", 1))
    labels = F.when(braced, F.regexp_extract("line", r"^[^{]*\{([^}]*)\}", 1)).otherwise(F.lit(""))
    value = F.when(braced, F.regexp_extract("line", r"^[^{]*\{[^}]*\}\s*(\S+)", 1)).otherwise(F.regexp_extract("line", r"^\S+\s+(\S+)", 1))
    out = rows.select(*rest, name.alias("name"), parse_labels(labels).alias("labels"), number(value).alias("value"))
    return out.where(F.col("value").isNotNull())


#: How a sample's number is written.
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
INFINITE = r"^[+-]?(?i:inf|infinity)$"


def number(text: Column) -> Column:
    """A number in decimal notation, an infinity or ``nan``; null for anything else, and for what overflows."""
    plain = F.when(text.rlike(NUMBER), text.try_cast("double"))
    infinite = F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(text.rlike(INFINITE), infinite).when(F.lower(text) == "nan", F.lit(float("nan"))).when(F.abs(plain) != float("inf"), plain)


def show_labels(labels: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def parse_nodes(text: Column) -> Column:
    """``id=grpc;admin`` entries, separated by commas, as structs; entries without all three parts are left out."""
    parts = F.filter(F.transform(F.split(text, ","), F.trim), lambda p: p != "")
    read = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("id"), F.trim(F.regexp_extract(p, r"^[^=]*=([^;]*);", 1)).alias("grpc"), F.trim(F.regexp_extract(p, r"^[^=]*=[^;]*;(.*)$", 1)).alias("admin")))
    return F.filter(read, lambda n: (n["id"] != "") & (n["grpc"] != "") & (n["admin"] != ""))


#: HTTP statuses of node errors by their codes; any other code is a bad gateway.
STATUS = {"InvalidArgument": 400, "Unavailable": 503, "DeadlineExceeded": 504}


def http_status(code: Column) -> Column:
    out = F.lit(502)
    for name, status in STATUS.items():
        out = F.when(code == name, status).otherwise(out)
    return out
