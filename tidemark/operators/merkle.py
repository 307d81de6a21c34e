"""Merkle trees over versions (node, key, val, clock, ts, deleted), and the anti-entropy that they drive.

Leaves hash entries in key order, each as key length, key, and the hash of the version's stored form, so equal data gives
equal trees. A tree has 256 leaves per node whatever the data: entries reach their leaf through one sort by node, bucket
and key, and a leaf's hash is updated entry by entry as they stream by, so no task holds a leaf's entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import versions as stored
from ..functions.hashing import hash64, unsigned_mod
from ..session import cut, share_code
from .resolve import VERSION, reconcile_group

LEAVES = 256
#: A tree as bytes: one unused hash, then the root, and so on down to the leaves.
TREE_BYTES = 2 * LEAVES * 32


def bucket(key: Column) -> Column:
    return unsigned_mod(hash64(key), LEAVES).cast("int")


def encoding(val: Column, clock: Column, ts: Column, deleted: Column) -> Column:
    """One text for each version, in which no two different versions agree: its stored form."""
    return stored.encode(val, clock, ts, deleted)


def leaves(versions: DataFrame) -> DataFrame:
    """``node, bucket, hash`` (hex) of the leaves that have entries. Rows without a key have no place in a tree."""
    share_code(versions.sparkSession)
    digest = F.unhex(F.sha2(F.coalesce(encoding(F.col("val"), F.col("clock"), F.col("ts"), F.col("deleted")), F.lit("")), 256))
    rows = versions.where(F.col("key").isNotNull()).select("node", bucket(F.col("key")).alias("bucket"), F.col("key").cast("binary").alias("key"), digest.alias("digest"))
    schema = pa.schema([("node", pa.string()), ("bucket", pa.int32()), ("hash", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            done = []
            for node, place, key, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (node, place) != current:
                    if state is not None:
                        done.append((*current, state.hexdigest()))
                    current, state = (node, place), hashlib.sha256()
                state.update(len(key).to_bytes(4, "big") + key + value)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d, strict=True)) for d in done], schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*current, state.hexdigest()), strict=True))], schema)

    return rows.repartition("node", "bucket").sortWithinPartitions("node", "bucket", "key", "digest").mapInArrow(run, "node string, bucket int, hash string")


def full_leaves(leaf: DataFrame) -> DataFrame:
    """All 256 leaves of each node; empty ones hash nothing."""
    every = leaf.select("node").distinct().select("node", F.explode(F.sequence(F.lit(0), F.lit(LEAVES - 1))).alias("bucket"))
    return every.join(leaf, ["node", "bucket"], "left").select("node", "bucket", F.coalesce("hash", F.sha2(F.lit(""), 256)).alias("hash"))


def _folded(below: str, n: int) -> Column:
    """``n`` hashes of pairs of the hashes in a column."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.sha2(F.unhex(F.concat(F.get(below, i * 2), F.get(below, i * 2 + 1))), 256))


def _levels(leaf: DataFrame) -> DataFrame:
    """``node, h0`` (the leaves' hashes) to ``h8`` (the root's): pairs fold level by level, inside one row per node."""
    level = full_leaves(leaf).groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "hash"))), lambda x: x["hash"]).alias("h0"))
    n, k = LEAVES, 0
    while n > 1:
        n, k = n // 2, k + 1
        level = level.withColumn(f"h{k}", _folded(f"h{k - 1}", n))
    return level


def roots(leaf: DataFrame) -> DataFrame:
    """``node, root``."""
    return _levels(leaf).select("node", F.get("h8", F.lit(0)).alias("root"))


def serialize(leaf: DataFrame) -> DataFrame:
    """``node, tree``: all hashes of a tree, the root first, after 32 bytes of zeros."""
    hashes = F.flatten(F.array(*(F.col(f"h{k}") for k in range(8, -1, -1))))
    return _levels(leaf).select("node", F.unhex(F.concat(F.lit("0" * 64), F.array_join(hashes, ""))).alias("tree"))


def parse_trees(trees: DataFrame) -> DataFrame:
    """``node, bucket, hash`` of the leaves of trees (node, tree); a tree of another length is an error."""
    n = F.octet_length("tree")
    right = F.when(n == TREE_BYTES, F.hex("tree")).otherwise(F.raise_error(F.concat(F.lit("a tree has "), n.cast("string"), F.lit(f" bytes, not {TREE_BYTES}"))))
    rows = trees.select("node", F.lower(right).alias("_hex")).select("node", "_hex", F.explode(F.sequence(F.lit(0), F.lit(LEAVES - 1))).alias("bucket"))
    return rows.select("node", "bucket", F.substring("_hex", (F.col("bucket") + LEAVES) * 64 + 1, F.lit(64)).alias("hash"))


def differing(leaf: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, bucket`` of leaves that differ between the nodes of each pair (a, b)."""
    full = full_leaves(leaf)
    left = full.select(F.col("node").alias("a"), "bucket", F.col("hash").alias("ha"))
    right = full.select(F.col("node").alias("b"), "bucket", F.col("hash").alias("hb"))
    return pairs.join(left, "a").join(right, ["b", "bucket"]).where("ha <> hb").select("a", "b", "bucket")


def bucket_entries(versions: DataFrame, buckets: DataFrame) -> DataFrame:
    """The versions, with their ``bucket``, whose bucket is in the set (bucket): 256 values at most."""
    return versions.withColumn("bucket", bucket(F.col("key"))).join(F.broadcast(buckets.select("bucket").distinct()), "bucket", "left_semi")


def exchange(versions: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, src, key``: the entries that repair sends, from each node of a pair, in buckets that differ."""
    diff = differing(leaves(versions), pairs)
    ends = diff.select("a", "b", "bucket", F.explode(F.array("a", "b")).alias("src"))
    held = versions.select(F.col("node").alias("src"), "key", bucket(F.col("key")).alias("bucket"))
    return held.join(ends, ["src", "bucket"]).select("a", "b", "src", "key")


def repair(versions: DataFrame, a: str, b: str, scope: Column | None = None) -> tuple[DataFrame, int]:
    """``versions`` after a repair between two nodes, and the number of pushes, which counts equal entries of differing
    buckets as well.

    Both nodes send each other their entries in the buckets that differ, of the keys in ``scope`` (all by default), and
    both keep the canonical fold of the two versions, so both have the same afterwards.
    """
    columns = ["node", "key", *VERSION]
    versions = versions.select(columns)
    inside = F.col("node").isin(a, b) & (F.lit(True) if scope is None else scope)
    held = versions.where(inside).withColumn("bucket", bucket(F.col("key")))
    pair = versions.sparkSession.createDataFrame([(a, b)], "a string, b string")
    diff = differing(leaves(versions.where(inside)), pair).select("bucket")
    # 256 buckets at most.
    sent = held.join(F.broadcast(diff), "bucket", "left_semi").drop("bucket")
    joint = reconcile_group(sent, ["key"])
    told = joint.select(F.explode(F.array(F.lit(a), F.lit(b))).alias("node"), "key", *VERSION)
    after = told.select(columns).unionByName(held.join(F.broadcast(diff), "bucket", "left_anti").select(columns)).unionByName(versions.where(~inside))
    return cut(after), sent.count()


def anti_entropy(versions: DataFrame, pairs: list[tuple[str, str, Column | None]], reach: set[tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """``versions`` after one repair of each pair of nodes (a, b, scope) in turn, and ``a, b, pushes``.

    ``reach`` are the pairs that reach each other (all by default); a pair that is cut off reconciles nothing and is left
    out, and is repaired in a later round. The pairs are those of the cluster's nodes, so they are few.
    """
    spark, pushes = versions.sparkSession, []
    for a, b, scope in pairs:
        if reach is not None and (a, b) not in reach and (b, a) not in reach:
            continue
        versions, n = repair(versions, a, b, scope)
        pushes.append((a, b, n))
    return versions, spark.createDataFrame(pushes, "a string, b string, pushes bigint")
