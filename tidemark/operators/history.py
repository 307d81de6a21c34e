"""Invariants over histories of operations (id, kind, key, value, found, ok, start_seq, end_seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Sequence numbers of a span of time.
SPAN = 1 << 16


def fabrications(history: DataFrame) -> DataFrame:
    """Gets that returned a value nobody ever put, even in a put that failed."""
    put = history.where("kind = 'put'").select("key", "value").distinct()
    return history.where("kind = 'get' and ok and found").join(put, ["key", "value"], "left_anti")


def _numbered_puts(puts: DataFrame, span) -> DataFrame:
    """Puts with ``n``, their number by key in the order of their starts: counted in each span, after what spans before it have."""
    rows = puts.withColumn("span", span("s"))
    counts = rows.groupBy("key", "span").agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(W.partitionBy("key").orderBy("span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("c")
    own = F.row_number().over(W.partitionBy("key", "span").orderBy("s", "id"))
    return rows.withColumn("own", own).join(before, ["key", "span"]).withColumn("n", (F.col("own") + F.col("before")).cast("bigint")).drop("own", "before", "span")


def freshness_faults(history: DataFrame, width: int = SPAN) -> DataFrame:
    """Gets that broke freshness: ``id, key, value, expected``.

    With a key's successful puts in order of their starts, the value read has to be of the last put that had completed
    before the read began, or of a later one that had begun before the read ended; without a completed one, not-found
    is right as well. Both bounds are running maxima over the key's operations in order of time, so no get meets every
    put of its key. A key's history is cut into spans of ``width`` sequence numbers, each with the maxima of those before it,
    so that no task has more of a key with most of the operations than a span of them; ids are unique. An empty history has
    no faults.
    """
    span = lambda t: F.floor(F.col(t) / width)
    puts = _numbered_puts(history.where("kind = 'put' and ok").select("id", "key", F.col("value").alias("put"), F.col("start_seq").alias("s"), F.col("end_seq").alias("e")), span)
    gets = history.where("kind = 'get' and ok").select("id", "key", "value", "found", "start_seq", "end_seq")
    # Both bounds in one pass: puts by their ends meet gets by their starts (side 0), puts by their starts gets by their ends
    # (side 1). At equal times the get comes first: only puts strictly before it count.
    put, nobody = F.struct("n", "put"), F.lit(None).cast("struct<n:bigint,put:string>")
    event = lambda t, late, last, id_: F.struct(t.alias("t"), F.lit(late).alias("late"), last.alias("last"), id_.alias("id"))
    sided = lambda *events: F.posexplode(F.array(*events)).alias("side", "x")
    nothing = F.lit(None).cast("bigint")
    rows = puts.select("key", sided(event(F.col("e"), 1, put, nothing), event(F.col("s"), 1, put, nothing)))
    rows = rows.unionByName(gets.select("key", sided(event(F.col("start_seq"), 0, nobody, F.col("id")), event(F.col("end_seq"), 0, nobody, F.col("id"))))).select("key", "side", "x.*").withColumn("span", span("t"))
    tops = rows.groupBy("key", "side", "span").agg(F.max("last").alias("top"))
    before = tops.withColumn("before", F.max("top").over(W.partitionBy("key", "side").orderBy("span").rowsBetween(W.unboundedPreceding, -1))).drop("top")
    own = F.max("last").over(W.partitionBy("key", "side", "span").orderBy("t", "late").rowsBetween(W.unboundedPreceding, W.currentRow))
    known = rows.withColumn("own", own).where("id is not null").join(before, ["key", "side", "span"])
    bound = F.greatest("own", "before")
    bounds = known.groupBy("id").agg(F.max(F.when(F.col("side") == 0, bound)).alias("d"), F.max(F.when(F.col("side") == 1, bound)).alias("s"))
    bounds = bounds.select("id", F.coalesce("d.n", F.lit(0)).alias("done"), F.col("d.put").alias("expected"), F.coalesce("s.n", F.lit(0)).alias("seen"))
    met = gets.join(bounds, "id")
    read = puts.select("key", F.col("put").alias("value"), F.col("n").alias("read"))
    # A get that found something meets the puts of its value; one row for each get says whether any of them was legal.
    tried = met.join(read, ["key", "value"], "left").withColumn("legal", F.col("found") & (F.col("read") >= F.greatest("done", F.lit(1))) & (F.col("read") <= F.col("seen")) | ~F.col("found") & (F.col("done") == 0))
    judged = tried.groupBy("id").agg(F.first("key").alias("key"), F.first("value").alias("value"), F.first("expected").alias("expected"), F.max(F.coalesce("legal", F.lit(False))).alias("legal"))
    return judged.where(~F.col("legal")).select("id", "key", "value", "expected")


def divergences(replicas: DataFrame) -> DataFrame:
    """Keys on which live replicas (key, node, found, deleted, val) disagree; clocks are not compared."""
    seen = F.struct(F.col("found"), F.when(F.col("found"), F.col("deleted")).alias("deleted"), F.when(F.col("found") & ~F.col("deleted"), F.col("val")).alias("val"))
    counts = replicas.groupBy("key").agg(F.count("*").alias("replicas"), F.countDistinct(seen).alias("states"))
    return counts.where("replicas > 1 and states > 1")


def workload(keys: DataFrame, writes: int, nodes: int) -> DataFrame:
    """The writes of a workload over keys (key): values ``key#1`` and on, through the nodes in turn."""
    rows = keys.select("key", F.explode(F.sequence(F.lit(1), F.lit(writes))).alias("i"))
    return rows.select("key", F.concat("key", F.lit("#"), F.col("i").cast("string")).alias("value"), ((F.col("i") - 1) % nodes).cast("int").alias("via"))


def gate(calls: DataFrame, isolated: list[str], hung: list[str], dead: list[str], drop: float = 0.0, latency: tuple[int, int] = (0, 0), timeout: int = 0, seed: int = 0) -> DataFrame:
    """``calls`` (id, src, dst) with ``result`` and ``latency``: what the network does with each.

    Nodes of ``dead`` are skipped. A call of a node to itself never fails. Others fail across a partition, of which
    ``isolated`` is one side; hung nodes never answer; a share ``drop`` is lost, and the rest takes between the two latencies
    (a whole number, the upper one excluded), ``late`` if that is beyond the timeout (0: none). Drops and latencies are drawn
    by hashes of the id and the seed, so a repeated run draws the same.
    """
    among = lambda c, names: F.col(c).isin(names) if names else F.lit(False)
    draw = lambda what: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(what)), F.lit(1 << 32)) / float(1 << 32)
    low, high = latency
    own = F.col("src") == F.col("dst")
    takes = F.when(own | (F.lit(high) <= 0), 0).otherwise(low + F.floor(draw("latency") * max(0, high - low))).cast("bigint")
    result = (
        F.when(among("dst", dead), "skipped")
        .when(own, "ok")
        .when(among("src", isolated) != among("dst", isolated), "unavailable")
        .when(among("dst", hung), "timeout")
        .when(draw("drop") < drop, "unavailable")
        .when((F.lit(timeout) > 0) & (takes > timeout), "timeout")
        .otherwise("ok")
    )
    return calls.withColumns({"result": result, "latency": F.when(result == "ok", takes)})


def reachable(a, b, isolated_a, isolated_b):
    """Two nodes reach each other if both or neither are cut off; a node always reaches itself."""
    return (a == b) | (isolated_a == isolated_b)
