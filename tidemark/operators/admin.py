"""What a node and a cluster show of themselves, as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .membership import state_name
from .ring import Ring

#: Bytes of a node's answer that are relayed.
BODY_BYTES, METRICS_BYTES = 1 << 20, 4 << 20


def status_json(stats: DataFrame, node: str, settings: dict, uptime_seconds: int) -> DataFrame:
    """``json``: a node's settings and engine statistics (keys, approx_bytes, next_seq, runs), one row."""
    storage = F.struct(F.col("keys").alias("memtable_keys"), "approx_bytes", "next_seq", F.col("runs").alias("sstables"))
    config = F.from_json(F.lit(_dump(settings)), F.schema_of_json(F.lit(_dump(settings))))
    return stats.select(F.to_json(F.struct(F.lit(node).alias("node_id"), F.lit(uptime_seconds).cast("bigint").alias("uptime_seconds"), config.alias("config"), storage.alias("storage"))).alias("json"))


def _dump(settings: dict) -> str:
    import json

    return json.dumps(settings)


def members_json(members: DataFrame) -> DataFrame:
    """``json``: the members (id, incarnation, severity) by id; an empty list without any. Members are few: one message
    names them all."""
    rows = members.groupBy().agg(F.array_sort(F.collect_list(F.struct("id", state_name(F.col("severity")).alias("state"), "incarnation"))).alias("members"))
    return rows.select(F.to_json(F.struct("members")).alias("json"))


def ring_json(spark, ring: Ring) -> DataFrame:
    """``json``: the ring's virtual nodes, size and nodes."""
    nodes = F.array(*map(F.lit, ring.nodes)) if ring.nodes else F.array().cast("array<string>")
    return spark.range(1).select(F.to_json(F.struct(F.lit(ring.vnodes).alias("vnodes"), F.lit(len(ring)).alias("size"), nodes.alias("nodes"))).alias("json"))


def key_json(key: Column, ring: Ring, n: int) -> Column:
    """A key's preference list as JSON; null for a missing key."""
    prefs = F.coalesce(ring.preference_list(key, n), F.array().cast("array<string>"))
    return F.when(F.octet_length(key) > 0, F.to_json(F.struct(key.alias("key"), F.lit(n).alias("n"), prefs.alias("preference_list"))))


def fan_out(nodes: DataFrame, answers: DataFrame, on: str = "node", order: str = "place", most: int = BODY_BYTES) -> DataFrame:
    """``nodes`` with ``ok, error, data``: each node's answer (status, body), a row for every node. A node that did not answer,
    or not with 200, is not ok; bodies are cut at ``most`` bytes. Rows are told apart by ``order``, the configured one."""
    got = nodes.join(answers.select(on, "status", "body"), on, "left")
    ok = F.coalesce(F.col("status") == 200, F.lit(False))
    error = F.when(F.col("status").isNull(), "no answer").when(~ok, F.concat(F.lit("node returned status "), F.col("status").cast("string")))
    body = F.when(F.octet_length("body") > most, F.expr(f"substring(cast(body as binary), 1, {most})").cast("string")).otherwise(F.col("body"))
    return got.select(order, on, ok.alias("ok"), error.alias("error"), F.when(ok, body).alias("data"))
