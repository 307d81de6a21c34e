"""The write path over change records: validated writes, flushes, table sets and a block cache's hits."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import numbered, share_code
from .changelog import DELETE, MAX_KEY_BYTES, MAX_VALUE_BYTES, SET, newest, validate

#: Writers wait once this many sealed segments are not flushed yet.
MAX_IMMUTABLES = 4
CACHE_BYTES = 8 << 20


def write(log: DataFrame, writes: DataFrame, max_key: int = MAX_KEY_BYTES, max_value: int = MAX_VALUE_BYTES) -> tuple[DataFrame, DataFrame]:
    """``log`` (seq, key, kind, val) with the valid ones of ``writes`` (at, key, kind, val) after it, and the others with a
    ``result``. Sequence numbers go on from the log's highest in the order of ``at`` (then key and value).

    A delete has no value. An empty log begins at 1; null keys are empty ones and refused.
    """
    checked = writes.select("at", "key", "kind", F.when(F.col("kind") == SET, F.col("val")).alias("val")).withColumn("result", validate(F.col("key"), F.col("val"), F.col("kind"), max_key, max_value))
    last = log.agg(F.max("seq").alias("top")).first()["top"] or 0
    new = numbered(checked.where("result = 'ok'"), [F.col(c) for c in ("at", "key", "kind", "val")], "seq", last + 1)
    return log.select("seq", "key", "kind", "val").unionByName(new.select("seq", "key", "kind", "val")), checked.where("result <> 'ok'")


def put(log: DataFrame, rows: DataFrame, **limits: int) -> tuple[DataFrame, DataFrame]:
    """`write` of sets (at, key, val)."""
    return write(log, rows.withColumn("kind", F.lit(SET)), **limits)


def delete(log: DataFrame, rows: DataFrame, **limits: int) -> tuple[DataFrame, DataFrame]:
    """`write` of tombstones (at, key)."""
    return write(log, rows.select("at", "key", F.lit(DELETE).alias("kind"), F.lit(None).cast("string").alias("val")), **limits)


def stalled(immutables: int, most: int = MAX_IMMUTABLES) -> bool:
    return immutables >= most


def flush(log: DataFrame, segments: DataFrame) -> DataFrame:
    """``run, key, seq, kind, val``: the tables that sealed segments (segment) become, sorted by key. Each segment of ``log``
    (segment, seq, key, kind, val) is one table, with the newest record of each key; tombstones stay."""
    rows = log.join(F.broadcast(segments.select("segment").distinct()), "segment", "left_semi")
    tables = newest(rows, ["segment", "key"])
    return tables.select(F.col("segment").alias("run"), "key", "seq", "kind", "val").repartitionByRange("run", "key").sortWithinPartitions("run", "key")


def flushed_state(state: dict, segments: list[int], last_seq: int) -> dict:
    """The manifest after a flush, oldest segment first: a table for each, and its segment as flushed."""
    tables, number = list(state["tables"]), state["next_file_num"]
    for _ in sorted(segments):
        tables.append(number)
        number += 1
    return {"tables": tables, "next_file_num": number, "last_flushed_wal": max([state["last_flushed_wal"], *segments]), "last_seq": max(state["last_seq"], last_seq)}


def remaining_tables(tables: DataFrame, removed: DataFrame) -> DataFrame:
    """``tables`` (num, ...) without those of ``removed`` (num)."""
    return tables.join(removed.select("num").distinct(), "num", "left_anti").select(tables.columns)


def full_merge(tables: DataFrame, picked: DataFrame) -> DataFrame:
    """``engine, every``: whether the picked tables (engine, num) are all of the engine's, so that tombstones may go."""
    of = tables.groupBy("engine").agg(F.count_distinct("num").alias("n"))
    chosen = picked.groupBy("engine").agg(F.count_distinct("num").alias("m"))
    return chosen.join(of, "engine").select("engine", (F.col("m") == F.col("n")).alias("every"))


def cache_hits(reads: DataFrame, capacity: int = CACHE_BYTES) -> DataFrame:
    """``engine, at, hit`` of block reads (engine, at, num, offset, bytes) through a cache that forgets the block used longest
    ago when its blocks exceed ``capacity`` bytes. An engine's reads stream through one task, which keeps its cache alone."""
    share_code(reads.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held, size = None, OrderedDict(), 0
        for part in parts:
            out = []
            for engine, at, num, offset, length in zip(*(part[c] for c in ("engine", "at", "num", "offset", "bytes")), strict=True):
                if engine != current:
                    current, held, size = engine, OrderedDict(), 0
                hit = (num, offset) in held
                if hit:
                    held.move_to_end((num, offset))
                else:
                    held[num, offset] = length
                    size += length
                    while size > capacity and held:
                        size -= held.popitem(last=False)[1]
                out.append((engine, at, hit))
            yield pd.DataFrame(out, columns=["engine", "at", "hit"])

    return reads.where(F.col("engine").isNotNull()).repartition("engine").sortWithinPartitions("engine", "at").mapInPandas(run, "engine bigint, at bigint, hit boolean")
