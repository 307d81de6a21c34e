"""Vector clocks as MAP<STRING, BIGINT>; a missing counter is 0, a null clock is empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How one clock relates to another.
EQUAL, BEFORE, AFTER, CONCURRENT = 0, 1, 2, 3


def clock(c: Column) -> Column:
    return F.coalesce(c, F.create_map().cast("map<string,bigint>"))


def counter(c: Column, node: Column) -> Column:
    return F.coalesce(F.try_element_at(clock(c), node), F.lit(0).cast("bigint"))


def compare(a: Column, b: Column) -> Column:
    nodes = F.array_union(F.map_keys(clock(a)), F.map_keys(clock(b)))
    less = F.exists(nodes, lambda n: counter(a, n) < counter(b, n))
    more = F.exists(nodes, lambda n: counter(a, n) > counter(b, n))
    return F.when(less & more, CONCURRENT).when(less, BEFORE).when(more, AFTER).otherwise(EQUAL)


def merge(a: Column, b: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.map_zip_with(clock(a), clock(b), lambda _, x, y: F.greatest(F.coalesce(x, zero), F.coalesce(y, zero)))


def increment(c: Column, node: Column) -> Column:
    rest = F.map_filter(clock(c), lambda k, _: k != node)
    return F.map_concat(rest, F.create_map(node, counter(c, node) + 1))


def canonical(c: Column) -> Column:
    """Sorted counters above zero, which can be compared and grouped, as maps can not."""
    return F.array_sort(F.map_entries(F.map_filter(clock(c), lambda _, v: v != 0)))


def show(c: Column) -> Column:
    return F.array_join(F.transform(canonical(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
