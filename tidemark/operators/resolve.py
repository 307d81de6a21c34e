"""Conflict resolution of versions (val, clock, ts, deleted).

`reconcile_pair` keeps the pairwise rule, in which the order of arguments decides between equal clocks. `reconcile_group`
is a canonical fold that does not depend on any order: versions that another one's clock strictly dominates are dropped;
of the rest the latest wins by timestamp, then value, then live over deleted; its clock is the pointwise maximum of all.
It agrees with the pairwise rule wherever that does not depend on the order of its arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clocks

VERSION = ["val", "clock", "ts", "deleted"]


def version(prefix: str = "") -> Column:
    return F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in VERSION))


def weight(v: Column) -> Column:
    """What concurrent versions are compared by."""
    return F.struct(v["ts"].alias("ts"), F.coalesce(v["val"], F.lit("")).alias("val"), (~v["deleted"]).alias("live"))


def reconcile_pair(a: Column, b: Column) -> Column:
    """The version that survives of two structs; ``a`` on equal clocks and on full ties."""
    rel = clocks.compare(a["clock"], b["clock"])
    first = rel.isin(clocks.AFTER, clocks.EQUAL) | ((rel == clocks.CONCURRENT) & (weight(a) >= weight(b)))
    chosen = F.when(first, a).otherwise(b)
    return chosen.withField("clock", F.when(rel == clocks.CONCURRENT, clocks.merge(a["clock"], b["clock"])).otherwise(chosen["clock"]))


def reconcile_group(versions: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` with the surviving version of each group.

    A group is the replicas of one key, a handful however large the data, so it folds inside one row.
    """
    rows = versions.groupBy(*keys).agg(F.collect_list(version()).alias("vs"))

    def beaten(v: Column, vs: Column) -> Column:
        return F.exists(vs, lambda o: clocks.compare(v["clock"], o["clock"]) == clocks.BEFORE)

    top = F.array_max(F.transform(F.filter("vs", lambda v: ~beaten(v, F.col("vs"))), lambda v: F.struct(weight(v).alias("w"), v["deleted"].alias("deleted"))))
    joint = F.aggregate("vs", clocks.clock(F.lit(None)), lambda acc, v: clocks.merge(acc, v["clock"]))
    return rows.select(*keys, top["w"]["val"].alias("val"), joint.alias("clock"), top["w"]["ts"].alias("ts"), top["deleted"].alias("deleted"))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The stored state after incoming versions, one per key: each meets the current one, the incoming one first."""
    c = current.select(*keys, version().alias("c"))
    i = incoming.select(*keys, version().alias("i"))
    got = F.when(F.col("c").isNull(), F.col("i")).when(F.col("i").isNull(), F.col("c")).otherwise(reconcile_pair(F.col("i"), F.col("c")))
    return c.join(i, keys, "full").select(*keys, got.alias("v")).select(*keys, "v.*")
