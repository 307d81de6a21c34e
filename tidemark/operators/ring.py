"""Consistent-hash placement: tokens, owners, preference lists, moves and placement checks.

A ring's tokens are a few hundred rows whatever the data (nodes times virtual nodes), so they are sorted once on the
driver and looked up by binary search in the same Arrow batch that hashes the keys: no join and no shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import _bytes, hash64, hash64_array, unsigned
from ..session import active

DEFAULT_VNODES = 128


class Ring:
    def __init__(self, nodes: list[str], vnodes: int = DEFAULT_VNODES) -> None:
        """``nodes``: the members, in order, once each; ``len`` of the ring is their number."""
        self.nodes, self.vnodes = sorted(set(nodes)), vnodes if vnodes > 0 else DEFAULT_VNODES
        owners = [n for n in self.nodes for _ in range(self.vnodes)]
        hashes = hash64_array([f"{n}#{i}".encode() for n in self.nodes for i in range(self.vnodes)])
        order = sorted(range(len(owners)), key=lambda k: (int(hashes[k]), owners[k]))
        self.hashes = hashes[order] if owners else hashes
        self.owners = [owners[k] for k in order]

    def __len__(self) -> int:
        return len(self.nodes)

    def preferences(self, n: int) -> list[list[str]]:
        """For each token, the first ``n`` distinct nodes clockwise from it."""
        n = min(max(n, 0), len(self.nodes))
        out = []
        for start in range(len(self.owners)):
            found: dict[str, None] = {}
            k = start
            while len(found) < n:
                found[self.owners[k % len(self.owners)]] = None
                k += 1
            out.append(list(found))
        return out

    def preference_list(self, key: Column, n: int) -> Column:
        """The key's preference list as an array; empty for an empty ring, null for a null key."""
        active()
        hashes, lists = self.hashes, self.preferences(n)

        @F.pandas_udf("array<string>")
        def run(keys: pd.Series) -> pd.Series:
            if not lists:
                return pd.Series([[]] * len(keys))
            at = np.searchsorted(hashes, hash64_array(_bytes(keys)), "left") % len(hashes)
            return pd.Series([lists[k] if known else None for k, known in zip(at, keys.notna(), strict=True)])

        return run(key)

    def in_scope(self, key: Column, a: str, b: str, n: int) -> Column:
        """Whether both nodes are among the first ``n`` of the key's preference list; null keys are in no scope."""
        prefs = self.preference_list(key, n)
        return F.coalesce(F.array_contains(prefs, a) & F.array_contains(prefs, b), F.lit(False))

    def owner(self, key: Column) -> Column:
        return F.get(self.preference_list(key, 1), F.lit(0))


def tokens(spark: SparkSession, nodes: DataFrame, vnodes: int = DEFAULT_VNODES) -> DataFrame:
    """``node, i, hash`` of every virtual node of the nodes (node)."""
    rows = nodes.select("node").distinct().select("node", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("i"))
    return rows.select("node", "i", unsigned(hash64(F.concat("node", F.lit("#"), F.col("i").cast("string")))).alias("hash"))


def distribution(owned: DataFrame) -> DataFrame:
    return owned.groupBy("node").agg(F.count("*").alias("n"))


def moves(keys: DataFrame, before: Ring, after: Ring) -> DataFrame:
    """How many keys go from which node to which when the ring changes."""
    return keys.select(before.owner(F.col("key")).alias("src"), after.owner(F.col("key")).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def placement_faults(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``key, node, fault``: replicas that are missing or that should not be there."""
    e, a = expected.withColumn("e", F.lit(1)), actual.withColumn("a", F.lit(1))
    return e.join(a, ["key", "node"], "full").where("e is null or a is null").select("key", "node", F.when(F.col("a").isNull(), "missing").otherwise("extra").alias("fault"))
