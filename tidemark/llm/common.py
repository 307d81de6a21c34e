"""What the text operators share: staged tables, salted lookups, Arrow batches and a vectorised pair table."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts of one batch are worked on in slices of about so many characters, which bounds a worker's temporary arrays.
SLICE_CHARS = 2_000_000
#: Entries of a worker's word cache; a full cache is emptied.
CACHE_WORDS = 600_000
#: Copies of a hot key's row in a salted lookup: its rows are dealt over so many partitions.
SALTS = 64
#: Bytes of texts that a training sample brings to the driver at most.
SAMPLE_BYTES = 64 << 20
#: A key with more than this part of all rows is hot.
HOT_KEYS = 4096


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a folder of this machine serves a local session,
    as in tests; a cluster has to name one, for its executors would not see this machine's."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = Path(tempfile.gettempdir(), "tidemark-checkpoints").as_uri()
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def on_store(spark: SparkSession, path: str):
    """A path of the shared folder and its file system, as Hadoop's."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps neither recompute it nor lose it with an executor.

    The files go when nothing needs them (`release`), or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, store = on_store(spark, path)
    store.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    where, store = on_store(df.sparkSession, df.staged_path)
    store.delete(where, True)


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed, from the folder the driver imports it from."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    share_code(df.sparkSession)
    return df.mapInArrow(function, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [x if isinstance(x, pa.Array) else pa.array(x, field.type, from_pandas=False) for x, field in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays([x.cast(f.type) if x.type != f.type else x for x, f in zip(arrays, schema, strict=True)], schema=schema)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of text each; one long text makes a part of its own."""
    sizes = batch.column(text).nbytes
    if sizes <= limit or batch.num_rows <= 1:
        if batch.num_rows:
            yield batch
        return
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def fold(column: str | Column, n: int) -> Column:
    """``crc32`` of the id as text, modulo ``n``; null ids fold to -1."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(c.cast("string")) % n, F.lit(-1))


def salted_lookup(rows: DataFrame, found: DataFrame, keys: list[str], by: list[str], salts: int = SALTS, count: str | None = None, total: int = 0) -> DataFrame:
    """``rows`` left-joined with ``found`` (one row per key), with the rows of a hot key dealt over ``salts`` partitions.

    ``count`` is the column of ``found`` that says how many rows a key has, of ``total`` in all. Keys with more than one in
    HOT_KEYS of them are hot; there are fewer than HOT_KEYS of those, so they can be broadcast. All others are joined
    plainly. Without ``count`` every key is taken as hot. The salt is a hash of the columns ``by``, so a recomputed task
    deals its rows as before. Null keys match nothing.
    """
    salt = F.pmod(F.xxhash64(*by), F.lit(salts))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    if count is None:
        left, copies = rows.withColumn("_salt", salt), every
    else:
        hot = F.col(count) > max(1000, total // HOT_KEYS)
        left = rows.join(F.broadcast(found.where(hot).select(*keys, F.lit(True).alias("_hot"))), keys, "left")
        left = left.withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0).cast("bigint"))).drop("_hot")
        copies = F.when(hot, every).otherwise(F.array(F.lit(0).cast("bigint")))
    return left.join(found.withColumn("_salt", F.explode(copies)), [*keys, "_salt"], "left").drop("_salt")


def sampled_ids(rows: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """The ``most`` distinct ids of ``rows`` whose hashes are smallest. Only about twice as many are brought together: a first
    pass estimates how many there are, and drops those whose hash is too large to be among them."""
    known = rows.where(F.col(key).isNotNull())
    every = known.agg(F.approx_count_distinct(key).alias("n")).first()["n"]
    hashed = F.xxhash64(key)
    if every > 4 * most + 1000:
        # The estimate is off by a twentieth; a sample of twice the size falls short of it with no probability to speak of.
        known = known.where(hashed < F.lit(-(2**63) + int(2.0**64 * (2 * most + 300) / every)))
    return known.select(key).distinct().orderBy(hashed, key).limit(most)


def fetched_texts(docs: DataFrame, ids: DataFrame, most_bytes: int, carried: tuple[str, ...] = (), key: str = "doc_id") -> list[tuple]:
    """``key, carried columns, text`` of a bounded set of ids, in the order of their hashes, until the texts have ``most_bytes``.

    Of an id that comes with several texts one is taken, the first by a hash. Texts are fetched a partition at a time.
    """
    texts = docs.where(F.col("text").isNotNull()).select(key, "text").join(F.broadcast(ids.select(key).distinct()), key)
    one = texts.groupBy(key).agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("t"))).alias("x")).select(key, F.col("x.t").alias("text"))
    rows = one.join(F.broadcast(ids), key).orderBy(F.xxhash64(key), key, *carried)
    out, size = [], 0
    for row in rows.toLocalIterator():
        size += len(row["text"].encode("utf-8", "surrogatepass"))
        if size > most_bytes and out:
            break
        out.append((row[key], *(row[c] for c in carried), row["text"]))
    return out


class PairTable:
    """Merges of symbol pairs by rank: an open-addressing hash table that looks up whole arrays of pairs."""

    MISS = np.int32(2**31 - 1)

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]) -> None:
        """``pairs``: (left, right) to (rank, merged symbol)."""
        n = max(len(pairs), 1)
        self.bits = max(4, int(np.ceil(np.log2(n * 4))))
        self.keys = np.full((1 << self.bits) + 1, -1, np.int64)
        self.rank = np.full(len(self.keys), self.MISS, np.int32)
        self.merged = np.full(len(self.keys), -1, np.int32)
        if not pairs:
            return
        left, right = np.array(list(pairs), np.int64).T
        values = np.array(list(pairs.values()), np.int32)
        key = (left << 32) | right
        todo, at = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = self.keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[at[won]] = key[todo[won]]
            self.rank[at[won]], self.merged[at[won]] = values[todo[won]].T
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, at = todo[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = (key.astype(np.uint64) ^ (key.astype(np.uint64) >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair; slots of absent pairs have rank ``MISS``."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self._slot(key)
        got = self.keys[at]
        todo = np.flatnonzero((got != key) & (got != -1))
        mask = (1 << self.bits) - 1
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            got = self.keys[at[todo]]
            todo = todo[(got != key[todo]) & (got != -1)]
        at[self.keys[at] == -1] = 1 << self.bits
        return at
