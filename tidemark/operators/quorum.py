"""Outcomes of quorum writes and reads, read repair, and hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clocks
from .resolve import reconcile_group

ALIVE, SUSPECT, DEAD = 0, 1, 2


def attempts(writes: DataFrame, candidates: str, replicas: int) -> DataFrame:
    """A row per write and candidate node: its place, and whether it is preferred or a fallback."""
    rest = [c for c in writes.columns if c != candidates]
    return writes.select(*rest, F.posexplode(candidates).alias("place", "node")).withColumn("preferred", F.col("place") < replicas)


def answered(state: Column, latency: Column, timeout: int) -> Column:
    """Only dead nodes are skipped; a node that takes longer than the timeout counts as failed (0: no timeout)."""
    within = F.lit(True) if timeout == 0 else F.coalesce(latency <= timeout, F.lit(False))
    return (F.coalesce(state, F.lit(ALIVE)) != DEAD) & within


def hint_plan(tried: DataFrame, key: str) -> DataFrame:
    """``key, intended, holder``: failed preferred nodes, by place, matched with the fallbacks that answer, by place."""
    order = W.partitionBy(key).orderBy("place")
    failed = tried.where(F.col("preferred") & ~F.col("ok")).select(key, F.col("node").alias("intended"), F.row_number().over(order).alias("n"))
    usable = tried.where(~F.col("preferred") & F.col("ok")).select(key, F.col("node").alias("holder"), F.row_number().over(order).alias("n"))
    return failed.join(usable, [key, "n"]).select(key, "intended", "holder")


def write_outcomes(tried: DataFrame, key: str, need: int) -> DataFrame:
    """``key, acks, hints, outcome``: acknowledgements of preferred nodes and hints against the quorum, of which no more
    can be asked than there are candidates. One aggregation by write; hints are the smaller of failures and fallbacks."""
    counts = tried.groupBy(key).agg(F.count("*").alias("c"), F.count_if(F.col("preferred") & F.col("ok")).alias("direct"), F.count_if(F.col("preferred") & ~F.col("ok")).alias("failed"), F.count_if(~F.col("preferred") & F.col("ok")).alias("spare"))
    hints = F.least("failed", "spare")
    acks = F.col("direct") + hints
    return counts.select(key, acks.alias("acks"), hints.alias("hints"), F.when(acks >= F.least(F.lit(need), F.col("c")), "ok").otherwise("error").alias("outcome"))


def merged_clocks(replies: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, clock``: the pointwise maximum of the clocks of the replicas that answered (ok, clock), as far as they did;
    an empty clock where none has one."""
    every = replies.select(*keys).distinct()
    counters = replies.where("ok").select(*keys, F.explode(clocks.clock(F.col("clock"))).alias("node", "n")).groupBy(*keys, "node").agg(F.max("n").alias("n"))
    merged = counters.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", "n")))).alias("clock"))
    return every.join(merged, keys, "left").select(*keys, clocks.clock(F.col("clock")).alias("clock"))


def new_versions(writes: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, val, clock, ts, deleted``: the version that each write (val, ts, deleted, candidates) makes. Its clock is that of
    ``before`` (`merged_clocks`), one step on for the first preferred node."""
    rows = writes.join(before.select(*keys, F.col("clock").alias("_before")), keys, "left")
    clock = clocks.increment(F.col("_before"), F.get("candidates", F.lit(0)))
    return rows.select(*keys, F.when(~F.col("deleted"), F.col("val")).alias("val"), clock.alias("clock"), "ts", "deleted")


def quorum_write(writes: DataFrame, replies: DataFrame, key: str, replicas: int, need: int, ok: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A write of each row (key, val, ts, deleted, candidates): ``outcomes``, the ``versions`` sent, and the ``hints`` that
    fallback nodes hold for failed ones. ``ok`` says from (key, node) whether a node answers."""
    versions = new_versions(writes, merged_clocks(replies, [key]), [key])
    tried = attempts(writes.select(key, "candidates"), "candidates", replicas).withColumn("ok", ok)
    return write_outcomes(tried, key, need), versions, hint_plan(tried, key).join(versions, key)


def result_class(failed: Column, found: Column, reads: Column) -> Column:
    """``error``, ``not_found`` (reads only) or ``ok``."""
    return F.when(failed, "error").when(reads & ~found, "not_found").otherwise("ok")


def failover(tries: DataFrame, keys: list[str], code: str = "code", place: str = "place") -> DataFrame:
    """``keys, served_by, last``: nodes are tried in order, the first success serves the request; ``last`` is the code of the last
    try, which is the answer where none succeeds."""
    return tries.groupBy(*keys).agg(F.min(F.when(F.col(code) == "OK", F.col(place))).alias("served_by"), F.max_by(code, place).alias("last"))


#: Replicas of a key, answers that a read and a write need where nothing else is said.
DEFAULT_N, DEFAULT_R, DEFAULT_W = 3, 2, 2


def check_cluster(nodes: list[str], n: int = 0, r: int = 0, w: int = 0) -> tuple[int, int, int]:
    """The numbers of replicas and of answers that reads and writes need; those below one are the defaults. No more answers
    can be asked than there are replicas, and nodes have names, each its own."""
    n, r, w = (x if x >= 1 else d for x, d in ((n, DEFAULT_N), (r, DEFAULT_R), (w, DEFAULT_W)))
    if not nodes:
        raise ValueError("a cluster needs a node")
    if any(not x for x in nodes) or len(set(nodes)) != len(nodes):
        raise ValueError("nodes need names, each its own")
    if r > n or w > n:
        raise ValueError(f"reads ({r}) and writes ({w}) can not need more answers than there are replicas ({n})")
    return n, r, w


def quorum_read(replies: DataFrame, keys: list[str], need: int, replicas: int) -> DataFrame:
    """``keys, outcome, val, clock, ts``: replies (ok, found, version) fold to one answer if enough replicas answered."""
    heard = replies.groupBy(*keys).agg(F.count_if("ok").alias("answers"))
    won = reconcile_group(replies.where("ok and found"), keys)
    state = F.when(F.col("answers") < min(need, replicas), "error").when(F.col("ts").isNull() | F.col("deleted"), "not_found").otherwise("ok")
    out = heard.join(won, keys, "left").withColumn("outcome", state)
    shown = lambda c: F.when(F.col("outcome") == "ok", F.col(c)).alias(c)
    return out.select(*keys, "outcome", shown("val"), shown("clock"), shown("ts"))


def read_repairs(replies: DataFrame, keys: list[str]) -> DataFrame:
    """Replicas that answered and lack the winner or have an older clock: ``keys, node``."""
    won = reconcile_group(replies.where("ok and found"), keys).select(*keys, F.col("clock").alias("won"))
    stale = ~F.col("found") | (clocks.compare(F.col("clock"), F.col("won")) == clocks.BEFORE)
    return replies.where("ok").join(won, keys).where(stale).select(*keys, "node")


def pending_hints(hints: DataFrame) -> DataFrame:
    """One buffered version for each holder, intended node and key."""
    return reconcile_group(hints, ["holder", "intended", "key"])


def deliver(hints: DataFrame, reachable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hints whose intended node is reachable (node), which are delivered and removed, and those that stay."""
    up = reachable.select(F.col("node").alias("intended")).distinct()
    return hints.join(up, "intended", "left_semi"), hints.join(up, "intended", "left_anti")
