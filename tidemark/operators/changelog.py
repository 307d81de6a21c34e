"""Scans, point reads, compaction, statistics and rotation over change records (seq, key, kind, val, ...)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import share_code

#: Kinds of records, the memtable's overhead per entry, limits of keys and values, block and size rules.
SET, DELETE = 1, 2
ENTRY_OVERHEAD = 48
MAX_KEY_BYTES, MAX_VALUE_BYTES = 64 << 10, 1 << 20
BLOCK_BYTES, SIZE_RATIO = 4096, 1.5


def newest(log: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The newest record of each key; combined in each task before one shuffle by key."""
    keys, order = keys or ["key"], order or ["seq"]
    rest = [c for c in log.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return log.groupBy(*keys).agg(best).select(*keys, *(F.col(f"r.`{c}`").alias(c) for c in rest))


def live(records: DataFrame) -> DataFrame:
    """Drop tombstones. Only after `newest`: a tombstone has to hide the older records of its key first."""
    return records.where(F.col("kind") != DELETE)


def live_scan(log: DataFrame) -> DataFrame:
    return live(newest(log)).orderBy("key")


def multi_get(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Each requested key with ``found`` and its live value."""
    state = live(newest(log)).select("key", F.col("val"), F.lit(True).alias("found"))
    return requests.join(state, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"), "val")


def compact(log: DataFrame, runs: list[int], every: bool) -> DataFrame:
    """Merge runs; tombstones go only if the merge covers every run."""
    merged = newest(log.where(F.col("run").isin(runs)))
    return live(merged) if every else merged


def tiered_get(log: DataFrame) -> DataFrame:
    """The record that a read finds first: from the highest tier that has the key, and there the newest."""
    return newest(log, order=["tier", "seq"])


def entry_bytes(key: Column, value: Column) -> Column:
    return F.octet_length(key) + F.octet_length(F.coalesce(value, F.lit(""))) + ENTRY_OVERHEAD


def stats(log: DataFrame) -> DataFrame:
    """Keys, estimated bytes, next sequence number and number of runs, as one row. Values are measured before the shuffle."""
    value = F.when(F.col("kind") == SET, F.col("val"))
    state = log.select("key", "seq", entry_bytes(F.col("key"), value).alias("bytes")).groupBy("key").agg(F.max_by("bytes", "seq").alias("bytes"))
    size = state.agg(F.count("*").alias("keys"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("approx_bytes"))
    return size.crossJoin(log.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).cast("bigint").alias("next_seq"), F.countDistinct("run").alias("runs")))  # two single rows


def _in_order(log: DataFrame, group: str, order: list[str], step: Callable[[], Callable[[pd.DataFrame, bool], list]], schema: str) -> DataFrame:
    """Run a sequential rule over each group's rows in order. Rows stream through a task; only the rule's state is kept.
    Rows without a group are a group of their own."""
    share_code(log.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, rule = None, None
        other = lambda a, b: a != b and not (pd.isna(a) and pd.isna(b))
        columns = [c.split()[0] for c in schema.split(", ")]
        for part in parts:
            out = []
            for value, rows in part.groupby(group, sort=False, dropna=False):
                if rule is not None and other(value, current):
                    out += rule(part.iloc[:0], True)
                    rule = None
                if rule is None:
                    current, rule = value, step()
                out += rule(rows, False)
            yield pd.DataFrame(out, columns=columns)
        if rule is not None:
            yield pd.DataFrame(rule(pd.DataFrame(), True), columns=columns)

    return log.repartition(group).sortWithinPartitions(group, *order).mapInPandas(run, schema)


def rotations(log: DataFrame, threshold: int) -> DataFrame:
    """Segments that each engine's memtable was sealed into: it rotates after the write that reaches the threshold.

    An overwritten key adds only its value's change of length. The last segment may be open.
    """

    def step():
        state = {"segment": 0, "sizes": {}, "bytes": 0, "first": None, "last": None, "engine": None}

        def seal(keys: int, is_open: bool) -> list:
            row = (state["engine"], state["segment"], state["first"], state["last"], keys, state["bytes"], is_open)
            state.update(segment=state["segment"] + 1, sizes={}, bytes=0, first=None)
            return [row]

        def rule(rows: pd.DataFrame, end: bool) -> list:
            if end:
                return seal(len(state["sizes"]), True) if state["first"] is not None else []
            engine = rows["engine"].iloc[0]
            state["engine"] = None if pd.isna(engine) else engine
            keys, seq, out = rows["key"].tolist(), rows["seq"].to_numpy(), []
            size = np.fromiter((len(v.encode()) if k == SET and v is not None else 0 for k, v in zip(rows["kind"], rows["val"], strict=True)), np.int64, len(keys))
            full = np.fromiter((len(k.encode()) for k in keys), np.int64, len(keys)) + size + ENTRY_OVERHEAD
            # The place of each key's write before this one in the batch.
            codes, place = pd.factorize(rows["key"])[0], np.arange(len(keys))
            order = np.lexsort((place, codes))
            before = np.full(len(keys), -1)
            again = codes[order[1:]] == codes[order[:-1]]
            before[order[1:][again]] = order[:-1][again]
            start = 0
            while start < len(keys):
                width = 256
                while True:
                    stop = min(len(keys), start + width)
                    known = before[start:stop] >= start
                    change = np.where(known, size[start:stop] - size[before[start:stop]], full[start:stop])
                    if state["sizes"]:  # the segment has begun in an earlier batch
                        for i in np.flatnonzero(~known).tolist():
                            if keys[start + i] in state["sizes"]:
                                known[i], change[i] = True, size[start + i] - state["sizes"][keys[start + i]]
                    total = state["bytes"] + np.cumsum(change)
                    reached = total >= threshold
                    if reached.any() or stop == len(keys):
                        break
                    width *= 4
                state["first"] = int(seq[start]) if state["first"] is None else state["first"]
                if reached.any():
                    n = int(reached.argmax()) + 1
                    state["bytes"], state["last"] = int(total[n - 1]), int(seq[start + n - 1])
                    out += seal(len(state["sizes"]) + int((~known[:n]).sum()), False)
                    start += n
                else:
                    state["bytes"], state["last"] = int(total[-1]), int(seq[-1])
                    state["sizes"].update(zip(keys[start:], size[start:].tolist(), strict=True))
                    start = len(keys)
            return out

        return rule

    return _in_order(log, "engine", ["seq"], step, "engine bigint, segment bigint, first_seq bigint, last_seq bigint, keys bigint, bytes bigint, open boolean")


def pick_buckets(tables: DataFrame, threshold: int, ratio: float = SIZE_RATIO) -> DataFrame:
    """The tables that size-tiered compaction of each engine merges next: ``engine, num``.

    Tables sorted by size form groups as long as the next is at most ``ratio`` times the group's mean (rounded down, one
    at least); the first group with enough members is picked.
    """

    def step():
        state = {"nums": [], "sum": 0, "done": False, "engine": None}

        def rule(rows: pd.DataFrame, end: bool) -> list:
            out = []
            enough = threshold >= 2 and len(state["nums"]) >= threshold and not state["done"]
            if end:
                return [(state["engine"], n) for n in state["nums"]] if enough else []
            for engine, num, size in zip(rows["engine"], rows["num"], rows["size"], strict=True):
                state["engine"] = engine
                if state["done"]:
                    break
                if state["nums"] and size > max(1, state["sum"] // len(state["nums"])) * ratio:
                    if threshold >= 2 and len(state["nums"]) >= threshold:
                        out += [(engine, n) for n in state["nums"]]
                        state["done"] = True
                        break
                    state["nums"], state["sum"] = [], 0
                state["nums"].append(num)
                state["sum"] += size
            return out

        return rule

    return _in_order(tables, "engine", ["size", "num"], step, "engine bigint, num bigint")


def blocks(entries: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """The sparse index of each table sorted by key: a block ends with the entry that brings it to ``limit`` bytes."""

    def step():
        state = {"block": 0, "bytes": 0, "entries": 0, "first": None, "last": None, "run": None}

        def cut() -> list:
            row = (state["run"], state["block"], state["first"], state["last"], state["entries"], state["bytes"])
            state.update(block=state["block"] + 1, bytes=0, entries=0, first=None)
            return [row]

        def rule(rows: pd.DataFrame, end: bool) -> list:
            if end:
                return cut() if state["entries"] else []
            keys, total, out, start = rows["key"].tolist(), np.cumsum(rows["bytes"].to_numpy(np.int64)), [], 0
            state["run"] = None if pd.isna(rows["run"].iloc[0]) else rows["run"].iloc[0]
            while start < len(keys):
                past = int(total[start - 1]) if start else 0
                # The entry that brings the block to its limit ends it.
                stop = min(len(keys), int(np.searchsorted(total, past + limit - state["bytes"], "left")) + 1)
                state["first"] = keys[start] if state["first"] is None else state["first"]
                state.update(last=keys[stop - 1], bytes=state["bytes"] + int(total[stop - 1]) - past, entries=state["entries"] + stop - start)
                start = stop
                if state["bytes"] >= limit:
                    out += cut()
            return out

        return rule

    return _in_order(entries, "run", ["key"], step, "run string, block bigint, first_key string, last_key string, entries bigint, bytes bigint")


def uvarint_bytes(n: Column) -> Column:
    """Bytes of a number as a base-128 varint."""
    n = n.cast("bigint")
    out = F.lit(1)
    for bits in range(7, 64, 7):
        out = out + F.when(F.shiftrightunsigned(n, bits) > 0, 1).otherwise(0)
    return out


def stored_bytes(key: Column, seq: Column, value: Column) -> Column:
    """Bytes of an entry in a sorted table: lengths and sequence number as varints, one byte of kind, key and value."""
    k, v = F.octet_length(key), F.octet_length(F.coalesce(value, F.lit("")))
    return (uvarint_bytes(k) + k + uvarint_bytes(seq) + 1 + uvarint_bytes(v) + v).cast("bigint")


def validate(key: Column, value: Column, kind: Column, max_key: int = MAX_KEY_BYTES, max_value: int = MAX_VALUE_BYTES) -> Column:
    """What is wrong with a write, or ``ok``; only sets are held to the value limit."""
    k = F.octet_length(F.coalesce(key, F.lit("")))
    return F.when(k == 0, "empty key").when(k > max_key, "key too large").when((kind == SET) & (F.octet_length(F.coalesce(value, F.lit(""))) > max_value), "value too large").otherwise("ok")


def recover(frames: DataFrame, flushed: DataFrame, last_flushed: int, last_seq: int) -> DataFrame:
    """State after a restart: log segments up to the last flushed one are dropped, the newest segment is active, earlier
    ones are immutable. One row per key, with the tier that holds its newest record (2 active, 1 immutable, 0 flushed) and
    ``next_seq``: sequence numbers go on from the highest of the log that is left and the manifest's ``last_seq``."""
    left = frames.where(F.col("segment") > last_flushed)
    top = left.agg(F.max("segment").alias("top"), (F.greatest(F.max("seq"), F.lit(last_seq)) + 1).cast("bigint").alias("next_seq"))
    # One row: the number of the active segment.
    tiers = left.join(F.broadcast(top)).withColumn("tier", F.when(F.col("segment") == F.col("top"), 2).otherwise(1)).drop("top", "segment")
    state = tiered_get(tiers.drop("next_seq").unionByName(flushed.withColumn("tier", F.lit(0))))
    return state.join(F.broadcast(top.select("next_seq")))  # one row
