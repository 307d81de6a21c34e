"""Views of the driver tables that the queries share, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = ["n0", "n1", "n2"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as change records: an error deletes its user's key, any other event sets it."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("kind"), F.col("props").alias("val"), (F.col("event_id") % 4).alias("run"), "user_id")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each replica's version of each key: every node misses a seventh of the records, so replicas diverge."""
    seen = log(spark, sf_dir).select("*", F.posexplode(F.array(*map(F.lit, NODES))).alias("i", "node")).where(F.col("seq") % 7 != F.col("i"))
    counts = [F.count_if(F.col("seq") % 3 == k).alias(f"c{k}") for k in range(3)]
    rows = seen.groupBy("key", "node").agg(F.max_by(F.struct("val", "kind", "seq"), "seq").alias("r"), *counts)
    clock = F.map_filter(F.create_map(*(x for k in range(3) for x in (F.lit(f"n{k}"), F.col(f"c{k}")))), lambda _, v: v > 0)
    return rows.select("key", "node", F.col("r.val").alias("val"), clock.alias("clock"), F.col("r.seq").alias("ts"), (F.col("r.kind") == 2).alias("deleted"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations on keys: purchases and sign-ups put, views and clicks get. A get reads the value of one of
    the three newest puts before it, sometimes nothing, sometimes a value that nobody put."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events").where(F.col("event_type") != "error")
    e = e.select(F.col("event_id").alias("id"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.when(F.col("event_type").isin("purchase", "signup"), "put").otherwise("get").alias("kind"))
    own = F.concat("key", F.lit("#"), F.col("id").cast("string"))
    before = W.partitionBy("key").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    # Only the last three puts matter, so the running list is cut to three at each put.
    puts = F.when(F.col("kind") == "put", own)
    ranks = F.count(puts).over(before)
    rows = e.withColumn("rank", ranks)
    put = rows.where("kind = 'put'").select("key", (F.col("rank") + 1).alias("n"), own.alias("old"))
    gets = rows.where("kind = 'get'").withColumn("n", F.col("rank") - F.col("id") % 3).join(put, ["key", "n"], "left")
    found = (F.col("id") % 11 != 0) & ((F.col("id") % 13 == 0) | F.col("old").isNotNull())
    value = F.when(found, F.when(F.col("id") % 13 == 0, "phantom").otherwise(F.col("old")))
    times = [(F.col("id") * 10).alias("start_seq"), (F.col("id") * 10 + F.col("id") % 37).alias("end_seq")]
    ok = (F.col("id") % 17 != 0).alias("ok")
    return gets.select("id", "key", "kind", value.alias("value"), found.alias("found"), ok, *times).unionByName(rows.where("kind = 'put'").select("id", "key", "kind", own.alias("value"), F.lit(True).alias("found"), ok, *times))


def rumours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    severity = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    return e.select(F.concat(F.lit("m"), (F.col("user_id") % 20).cast("string")).alias("id"), (F.col("event_id") % 8).alias("incarnation"), severity.alias("severity"), F.col("event_id").alias("tick"))


LOG = """log AS (SELECT event_id AS seq, 'user:' || user_id AS key, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS kind, props AS val, event_id % 4 AS run, user_id FROM events)"""
NEWEST = """newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1)"""
VERSIONS = f"""{LOG},
seen AS (SELECT log.*, i, 'n' || i AS node FROM log, (SELECT unnest(range(3)) AS i) WHERE seq % 7 <> i),
version AS (SELECT key, node, arg_max(val, seq) AS val, max(seq) AS ts, arg_max(kind, seq) = 2 AS deleted,
    count(*) FILTER (seq % 3 = 0) AS c0, count(*) FILTER (seq % 3 = 1) AS c1, count(*) FILTER (seq % 3 = 2) AS c2 FROM seen GROUP BY key, node)"""


def clock_text(prefix: str = "c") -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {prefix}{k} > 0 THEN 'n{k}=' || {prefix}{k} END" for k in range(3)) + ")"


HISTORY = """ops AS (SELECT event_id AS id, 'user:' || user_id AS key, CASE WHEN event_type IN ('purchase', 'signup') THEN 'put' ELSE 'get' END AS kind FROM events WHERE event_type <> 'error'),
ranked AS (SELECT *, count(*) FILTER (kind = 'put') OVER (PARTITION BY key ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rank FROM ops),
putn AS (SELECT key, rank + 1 AS n, key || '#' || id AS old FROM ranked WHERE kind = 'put'),
history AS (
    SELECT g.id, g.key, g.kind, g.id % 11 <> 0 AND (g.id % 13 = 0 OR old IS NOT NULL) AS found,
           CASE WHEN g.id % 11 <> 0 THEN CASE WHEN g.id % 13 = 0 THEN 'phantom' ELSE old END END AS value,
           g.id % 17 <> 0 AS ok, g.id * 10 AS start_seq, g.id * 10 + g.id % 37 AS end_seq
    FROM ranked g LEFT JOIN putn ON g.key = putn.key AND putn.n = g.rank - g.id % 3 WHERE g.kind = 'get'
    UNION ALL SELECT id, key, kind, true, key || '#' || id, id % 17 <> 0, id * 10, id * 10 + id % 37 FROM ranked WHERE kind = 'put')"""
RUMOUR = """rumour AS (SELECT 'm' || (user_id % 20) AS id, event_id % 8 AS incarnation, CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS severity, event_id AS tick FROM events)"""
#: Ring hashes in SQL: 64-bit arithmetic on 128-bit integers, modulo 2 to the power of 64.


def fnv(key: str) -> str:
    return f"list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split({key}, ''), lambda c: ascii(c)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


def mix(h: str) -> str:
    """The finaliser of a hash column; nested so that each step's value is computed once by a list of one."""
    m = "% 18446744073709551616::UHUGEINT"
    return f"list_transform(list_transform(list_transform([({h} + 11400714819323198485::UHUGEINT) {m}], lambda x: (xor(x, x >> 30) * 13787848793156543929::UHUGEINT) {m}), lambda x: (xor(x, x >> 27) * 10723151780598845931::UHUGEINT) {m}), lambda x: xor(x, x >> 31))[1]"
