"""The registered queries: each applies an operator to views of the driver tables, over all of their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clocks
from ..functions import versions as stored
from ..operators import admin, bloom, changelog, engine, history, membership, merkle, metrics, quorum, replica, resolve, ring
from ..session import scratch
from ..sources import tables, text_metrics, wal
from ..streaming import windows
from . import views
from .views import NODES, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LATENCY_BOUNDS_MS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0]


def query(f):
    QUERIES[f.__name__] = f
    return f


def ring_nodes(spark, sf_dir) -> list[str]:
    """The ring's nodes: the 25 nations, a table of fixed size."""
    return [r[0] for r in table(spark, sf_dir, "nation").select(F.concat(F.lit("node"), F.col("n_nationkey").cast("string"))).collect()]


def order_keys(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("key"), "o_orderkey")


@query
def q01_live_scan(spark, sf):
    return changelog.live_scan(views.log(spark, sf)).select("key", "seq", "val")


@query
def q02_multi_get(spark, sf):
    asked = table(spark, sf, "customer").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key"))
    return changelog.multi_get(views.log(spark, sf), asked)


@query
def q03_compact_full(spark, sf):
    return changelog.compact(views.log(spark, sf), [0, 1, 2, 3], True).select("key", "seq", "kind", "val")


@query
def q04_compact_partial(spark, sf):
    return changelog.compact(views.log(spark, sf), [0, 1], False).select("key", "seq", "kind", "val")


@query
def q05_tier_precedence(spark, sf):
    tiers = views.log(spark, sf).where("seq % 5 <> 0 or run < 2").withColumn("tier", F.col("run"))
    return changelog.tiered_get(tiers).select("key", "tier", "seq", (F.col("kind") == 1).alias("found"))


@query
def q06_stats(spark, sf):
    return changelog.stats(views.log(spark, sf))


@query
def q07_rotation(spark, sf):
    return changelog.rotations(views.log(spark, sf).withColumn("engine", F.col("user_id") % 16), 2000)


@query
def q08_size_tier(spark, sf):
    sizes = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("num")).agg(F.sum("l_linenumber").alias("size"))
    return changelog.pick_buckets(sizes.select((F.col("num") % 10).alias("engine"), "num", F.pow("size", F.lit(2)).cast("bigint").alias("size")), 3)


@query
def q09_bloom_probe(spark, sf):
    keys = table(spark, sf, "customer").select(F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("key"))
    asked = table(spark, sf, "orders").select(F.concat(F.lit("c-"), (F.col("o_custkey") * 2).cast("string")).alias("key"))
    return bloom.probe(bloom.build(keys, 16384, 7), asked, 16384, 7)


@query
def q10_sparse_index(spark, sf):
    part = table(spark, sf, "part")
    entries = part.select(F.col("p_brand").alias("run"), F.format_string("%s:%08d", "p_name", "p_partkey").alias("key"), changelog.stored_bytes(F.format_string("%s:%08d", "p_name", "p_partkey"), F.col("p_partkey"), F.col("p_type")).alias("bytes"))
    return changelog.blocks(entries, 1024)


@query
def q11_tokens(spark, sf):
    nodes = table(spark, sf, "nation").select(F.concat(F.lit("node"), F.col("n_nationkey").cast("string")).alias("node"))
    return ring.tokens(spark, nodes, 32).select("node", F.col("i").cast("bigint").alias("i"), F.col("hash").cast("string").alias("hash"))


@query
def q12_owner(spark, sf):
    return order_keys(spark, sf).select("key", ring.Ring(ring_nodes(spark, sf), 32).owner(F.col("key")).alias("node"))


@query
def q13_pref_list(spark, sf):
    return order_keys(spark, sf).select("key", F.array_join(ring.Ring(ring_nodes(spark, sf), 32).preference_list(F.col("key"), 3), ",").alias("nodes"))


@query
def q14_distribution(spark, sf):
    return ring.distribution(q12_owner(spark, sf))


@query
def q15_moves(spark, sf):
    nodes = ring_nodes(spark, sf)
    return ring.moves(order_keys(spark, sf), ring.Ring(nodes, 32), ring.Ring([n for n in nodes if n != "node7"], 32))


@query
def q16_placement(spark, sf):
    prefs = ring.Ring(ring_nodes(spark, sf), 32).preference_list(F.col("key"), 2)
    expected = order_keys(spark, sf).select("o_orderkey", "key", F.posexplode(prefs).alias("place", "node"))
    actual = expected.select("key", F.when((F.col("o_orderkey") % 97 == 0) & (F.col("place") == 1), "stray").otherwise(F.col("node")).alias("node"))
    return ring.placement_faults(expected.select("key", "node"), actual)


def replica_pairs(spark, sf) -> DataFrame:
    v = views.versions(spark, sf)
    side = lambda p: v.select("key", F.col("node").alias(p), resolve.version().alias(f"v{p}"))
    return side("a").join(side("b"), "key").where("a < b")


@query
def q17_clock_compare(spark, sf):
    return replica_pairs(spark, sf).select("key", "a", "b", clocks.compare(F.col("va.clock"), F.col("vb.clock")).alias("relation"))


@query
def q18_clock_merge(spark, sf):
    p = replica_pairs(spark, sf)
    both = clocks.merge(F.col("va.clock"), F.col("vb.clock"))
    return p.select("key", "a", "b", clocks.show(both).alias("merged"), clocks.show(clocks.increment(both, F.lit("n0"))).alias("next"))


@query
def q19_reconcile_pair(spark, sf):
    r = replica_pairs(spark, sf).withColumn("r", resolve.reconcile_pair(F.col("va"), F.col("vb")))
    return r.select("key", "a", "b", F.col("r.val").alias("val"), F.col("r.ts").alias("ts"), F.col("r.deleted").alias("deleted"), clocks.show(F.col("r.clock")).alias("clock"))


def replies(spark, sf) -> DataFrame:
    """What three replicas answer: some fail, some do not have the key."""
    v = views.versions(spark, sf)
    return v.withColumns({"ok": (F.col("ts") + F.substring("node", 2, 1).cast("int")) % 5 != 0, "found": F.col("ts") % 9 != 0})


@query
def q20_quorum_read(spark, sf):
    out = quorum.quorum_read(replies(spark, sf), ["key"], 2, 3)
    return out.select("key", "outcome", "val", F.when(F.col("outcome") == "ok", clocks.show(F.col("clock"))).alias("clock"), "ts")


def tried_writes(spark, sf) -> DataFrame:
    """Writes with five candidate nodes each, three of them preferred; some nodes are dead or slow."""
    e = table(spark, sf, "events").where(F.col("event_type").isin("purchase", "signup"))
    w = e.select("event_id", "user_id", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: ((F.col("user_id") + i) % 7).cast("int")).alias("candidates"))
    t = quorum.attempts(w, "candidates", 3)
    state = F.when((F.col("user_id") + F.col("node")) % 6 == 0, quorum.DEAD).otherwise(quorum.ALIVE)
    return t.withColumn("ok", quorum.answered(state, (F.col("event_id") * 7 + F.col("node") * 13) % 100, 60))


@query
def q21_write_outcome(spark, sf):
    return quorum.write_outcomes(tried_writes(spark, sf), "event_id", 2)


@query
def q22_read_repair(spark, sf):
    return quorum.read_repairs(replies(spark, sf), ["key"])


@query
def q23_hint_plan(spark, sf):
    return quorum.hint_plan(tried_writes(spark, sf), "event_id")


def hints(spark, sf) -> DataFrame:
    v = views.versions(spark, sf)
    return v.select(F.concat(F.lit("h"), (F.col("ts") % 2).cast("string")).alias("holder"), F.concat(F.lit("t"), (F.length("key") % 2).cast("string")).alias("intended"), "key", *resolve.VERSION)


@query
def q24_hint_pending(spark, sf):
    p = quorum.pending_hints(hints(spark, sf))
    return p.select("holder", "intended", "key", "val", "ts", "deleted", clocks.show(F.col("clock")).alias("clock"))


@query
def q25_hint_deliver(spark, sf):
    sent, kept = quorum.deliver(quorum.pending_hints(hints(spark, sf)), spark.createDataFrame([("t1",)], "node string"))
    both = sent.withColumn("state", F.lit("delivered")).unionByName(kept.withColumn("state", F.lit("kept")))
    return both.groupBy("holder", "intended", "state").agg(F.count("*").alias("n"))


def node_pairs(spark) -> DataFrame:
    return spark.createDataFrame([(a, b) for a in NODES for b in NODES if a < b], "a string, b string")


@query
def q26_merkle(spark, sf):
    return merkle.roots(merkle.leaves(views.versions(spark, sf)))


@query
def q27_merkle_diff(spark, sf):
    return merkle.differing(merkle.leaves(views.versions(spark, sf)), node_pairs(spark)).select("a", "b", F.col("bucket").cast("bigint").alias("bucket"))


@query
def q28_bucket_entries(spark, sf):
    asked = spark.range(64).select(F.col("id").cast("int").alias("bucket"))
    return merkle.bucket_entries(views.versions(spark, sf), asked).select("node", F.col("bucket").cast("bigint").alias("bucket"), "key", "ts")


@query
def q29_repair_plan(spark, sf):
    return merkle.exchange(views.versions(spark, sf), node_pairs(spark)).groupBy("a", "b", "src").agg(F.count("*").alias("pushes"))


@query
def q30_scope(spark, sf):
    return order_keys(spark, sf).where(ring.Ring(ring_nodes(spark, sf), 32).in_scope(F.col("key"), "node1", "node2", 3)).select("key")


@query
def q31_member_merge(spark, sf):
    return membership.merge(views.rumours(spark, sf))


@query
def q32_refute(spark, sf):
    return membership.apply_news(views.rumours(spark, sf), "m3", 2)


def member_states(spark, sf) -> DataFrame:
    r = views.rumours(spark, sf)
    return r.groupBy("id").agg(F.max(F.struct("incarnation", "severity", "tick")).alias("r")).select("id", "r.incarnation", "r.severity", F.col("r.tick").alias("since"), (F.col("r.tick") % 4).alias("left"))


@query
def q33_suspicion(spark, sf):
    top = table(spark, sf, "events").agg(F.max("event_id").alias("top"))
    m = member_states(spark, sf).join(F.broadcast(top))  # one row
    return membership.expire(m.withColumn("since", F.col("since") - F.col("top") + 100), 100, 50).select("id", "incarnation", "severity")


@query
def q34_gossip(spark, sf):
    return membership.outgoing(member_states(spark, sf), "m3", "m5")


@query
def q35_fabrication(spark, sf):
    return history.fabrications(views.history(spark, sf)).select("id", "key", "value")


@query
def q36_freshness(spark, sf):
    return history.freshness_faults(views.history(spark, sf))


@query
def q37_convergence(spark, sf):
    v = views.versions(spark, sf)
    return history.divergences(v.select("key", "node", F.lit(True).alias("found"), "deleted", "val"))


@query
def q38_workload(spark, sf):
    return history.workload(table(spark, sf, "supplier").select(F.concat(F.lit("k"), F.col("s_suppkey").cast("string")).alias("key")), 20, 3)


@query
def q39_histogram(spark, sf):
    # Decimals, so that the sum does not depend on the order of its terms.
    out = metrics.histogram(table(spark, sf, "events"), ["event_type"], F.col("value").cast("decimal(18,4)"), LATENCY_BOUNDS_MS)
    return out.withColumn("sum", F.col("sum").cast("double"))


def requests(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.when(F.col("event_type").isin("purchase", "signup"), "put").when(F.col("event_type") == "error", "delete").otherwise("get").alias("op"), F.when(F.col("event_id") % 19 == 0, "error").when((F.col("event_id") % 5 == 0) & F.col("event_type").isin("view", "click"), "not_found").otherwise("ok").alias("result"), "event_id", "user_id", "value")


@query
def q40_counters(spark, sf):
    return metrics.counters(requests(spark, sf), ["op", "result"])


@query
def q41_gauges(spark, sf):
    return membership.state_counts(member_states(spark, sf))


@query
def q42_exposition(spark, sf):
    registry = metrics.Registry()
    registry.register("requests_total", "Requests by operation and result.", "counter", ["op", "result"])
    registry.register("request_ms", "Latency by operation.", "histogram", ["op"])
    counts, latencies = metrics.observe_requests(requests(spark, sf), F.col("event_id") % 97, LATENCY_BOUNDS_MS)
    return registry.expose({"requests_total": counts, "request_ms": latencies}, LATENCY_BOUNDS_MS)


def metric_lines(spark, sf) -> DataFrame:
    """Lines as a scrape has them: samples with and without labels, timestamps, comments and damaged ones."""
    e = table(spark, sf, "events")
    i = F.col("event_id").cast("string")
    line = F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("# HELP m"), i)).when(F.col("event_id") % 6 == 1, F.concat(F.lit("plain "), i, F.lit(" 1700000000"))).when(F.col("event_id") % 6 == 2, F.concat(F.lit("broken{a=\"1\"} x"), i)).otherwise(F.concat(F.lit('  req{type="'), F.col("event_type"), F.lit(',x", user = "'), F.col("user_id").cast("string"), F.lit('"} '), i, F.lit(".5")))
    return e.select("event_id", line.alias("line"))


@query
def q43_parse_samples(spark, sf):
    return text_metrics.parse_samples(metric_lines(spark, sf)).select("event_id", "name", "value")


@query
def q44_parse_labels(spark, sf):
    return text_metrics.parse_samples(metric_lines(spark, sf)).select("event_id", text_metrics.show_labels(F.col("labels")).alias("labels"))


@query
def q45_aggregate(spark, sf):
    nodes = table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("node"), F.col("n_nationkey").cast("string")).alias("node"))
    answers = table(spark, sf, "supplier").where(F.col("s_nationkey") % 6 != 0).groupBy("s_nationkey").agg(F.count("*").alias("n"))
    answers = answers.select(F.concat(F.lit("node"), F.col("s_nationkey").cast("string")).alias("node"), F.when(F.col("s_nationkey") % 5 == 0, 500).otherwise(200).alias("status"), F.concat(F.lit('{"suppliers":'), F.col("n").cast("string"), F.lit("}")).alias("body"))
    return admin.fan_out(nodes, answers, order="n_nationkey")


@query
def q46_failover(spark, sf):
    e = table(spark, sf, "events")
    tries = e.select("event_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("place"))
    code = F.get(F.array(*map(F.lit, ["OK", "Unavailable", "DeadlineExceeded", "InvalidArgument", "Internal"])), ((F.col("event_id") * 3 + F.col("place") * 7) % 11 % 5).cast("int"))
    got = quorum.failover(tries.withColumn("code", code), ["event_id"])
    return got.select("event_id", "served_by", F.when(F.col("served_by").isNotNull(), 200).otherwise(text_metrics.http_status(F.col("last"))).alias("status"))


@query
def q47_value_json(spark, sf):
    i = F.col("event_id")
    d = table(spark, sf, "events").select("event_id", "props", F.when(i % 11 == 0, F.unhex(F.lit("FF"))).otherwise(F.encode("props", "UTF-8")).alias("raw"))
    shown = replica.shown_value(F.col("raw"))
    coded = stored.base64_text(F.encode("props", "UTF-8"))
    # Both, neither, base64 that is none, base64, and text.
    text = F.when((i % 5 == 0) | (i % 5 == 4), F.col("props"))
    sent = replica.decoded_value(text, F.when(i % 5 == 2, F.concat(F.lit("!"), coded)).when(i % 5 != 4, F.when(i % 5 != 1, coded)))
    return d.select("event_id", shown["value_base64"].alias("value_base64"), shown["value"].alias("value"), F.decode(sent["bytes"], "UTF-8").alias("decoded"), sent["error"].alias("error"))


@query
def q48_snapshot(spark, sf):
    out = windows.snapshots(table(spark, sf, "events"), "1 hour")
    return out.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "event_type", "n")


@query
def q49_wal_replay(spark, sf):
    e = table(spark, sf, "events")
    payload = F.encode("props", "UTF-8")
    crc = F.when(F.col("event_id") % 401 == 400, F.lit(0).cast("bigint")).otherwise(F.crc32(payload))
    length = F.octet_length(payload) + F.when(F.col("event_id") % 577 == 576, 9).otherwise(0)
    frames = e.select((F.col("event_id") % 16).alias("segment"), F.col("event_id").alias("pos"), length.alias("len"), crc.alias("crc"), payload.alias("payload"))
    return wal.valid_frames(frames).groupBy("segment").agg(F.count("*").alias("frames"), F.max("pos").alias("last_pos"))


@query
def q50_recovery(spark, sf):
    rows = views.log(spark, sf).withColumn("segment", (F.col("seq") / 1000).cast("bigint")).select("segment", "seq", "key", "kind", "val")
    out = changelog.recover(rows, rows.where("segment <= 3").drop("segment"), 3, 4000)
    return out.select("key", "tier", "seq", "kind", "next_seq")


@query
def q51_config(spark, sf):
    s = table(spark, sf, "supplier")
    i = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit(" a"), i, F.lit("=10.0.0.1:"), i, F.lit(";10.0.0.2:9 , bad, =x;y,c="), F.when(F.col("s_suppkey") % 2 == 0, "h:1;h:2").otherwise("h:1"))
    return s.select("s_suppkey", F.inline(text_metrics.parse_nodes(text)))


@query
def q52_validate(spark, sf):
    d = table(spark, sf, "documents")
    key = F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))
    kind = F.when(F.col("doc_id") % 7 == 0, 2).otherwise(1)
    return d.select("doc_id", changelog.validate(key, F.col("text"), kind, 7, 2000).alias("result"))


@query
def q53_reachability(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", (F.col("n_regionkey") == 2).alias("isolated"))
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("isolated").alias("ia")), n.select(F.col("n_nationkey").alias("b"), F.col("isolated").alias("ib"))
    # Pairs of the 25 nations, a table of fixed size.
    return a.join(F.broadcast(b)).select("a", "b", history.reachable(F.col("a"), F.col("b"), F.col("ia"), F.col("ib")).alias("reachable"))


@query
def q54_upsert(spark, sf):
    v = views.versions(spark, sf)
    out = resolve.upsert(v.where("node = 'n0' and ts % 5 <> 0"), v.where("node = 'n1' and ts % 7 <> 0"), ["key"])
    return out.select("key", "val", "ts", "deleted", clocks.show(F.col("clock")).alias("clock"))


@query
def q55_gauge_values(spark, sf):
    e = table(spark, sf, "events")
    op = F.when(F.col("event_type") == "error", "set").when(F.col("event_type").isin("purchase", "signup"), "add").otherwise("sub")
    return metrics.gauge_values(e.select("user_id", op.alias("op"), (F.col("event_id") % 50).alias("value"), F.col("event_id").alias("at")), ["user_id"])


def replica_log(spark, sf) -> DataFrame:
    """The change records of one replica, which store its versions."""
    v = views.versions(spark, sf).where("node = 'n1'")
    return replica.stored_log(v.withColumn("seq", F.col("ts")))


def version_text(rows: DataFrame, *first: str) -> DataFrame:
    return rows.select(*first, F.decode("val", "UTF-8").alias("val"), F.when(F.col("clock").isNotNull(), clocks.show(F.col("clock"))).alias("clock"), "ts", "deleted")


@query
def q56_replica_scan(spark, sf):
    return version_text(replica.replica_scan(replica_log(spark, sf), ~F.col("key").endswith("3")), "key")


@query
def q57_replica_read(spark, sf):
    asked = table(spark, sf, "customer").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key"))
    return version_text(replica.replica_read(replica_log(spark, sf), asked), "key", "found")


@query
def q58_write(spark, sf):
    log = views.log(spark, sf)
    d = table(spark, sf, "documents")
    key = F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))
    new = d.select((-F.col("doc_id")).alias("at"), key.alias("key"), F.when(F.col("doc_id") % 7 == 0, 2).otherwise(1).alias("kind"), F.col("source").alias("val"))
    out, refused = engine.write(log, new, 7)
    cols = ["key", "kind", "val"]
    return out.select("seq", *cols, F.lit("ok").alias("result")).unionByName(refused.select(F.lit(None).cast("bigint").alias("seq"), *cols, "result"))


@query
def q59_flush(spark, sf):
    log = views.log(spark, sf).withColumn("segment", (F.col("seq") / 1000).cast("bigint"))
    sealed = log.select("segment").distinct().where("segment % 3 <> 1")
    return engine.flush(log, sealed).select("run", "key", "seq", "kind", "val")


REPAIR_PAIRS = [(a, b, None) for a in NODES for b in NODES if a < b]


@query
def q60_repair(spark, sf):
    out, _ = merkle.anti_entropy(views.versions(spark, sf), REPAIR_PAIRS)
    return out.select("key", "node", "val", "ts", "deleted", clocks.show(F.col("clock")).alias("clock"))


@query
def q61_repair_again(spark, sf):
    once, _ = merkle.anti_entropy(views.versions(spark, sf), REPAIR_PAIRS)
    return merkle.anti_entropy(once, REPAIR_PAIRS, {("n0", "n1"), ("n2", "n1")})[1]


@query
def q62_new_versions(spark, sf):
    before = quorum.merged_clocks(replies(spark, sf), ["key"])
    w = table(spark, sf, "customer").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("val"), F.col("c_custkey").alias("ts"), (F.col("c_custkey") % 5 == 0).alias("deleted"), F.array(F.concat(F.lit("n"), (F.col("c_custkey") % 3).cast("string"))).alias("candidates"))
    out = quorum.new_versions(w, before, ["key"])
    return out.select("key", "val", "ts", "deleted", clocks.show(F.col("clock")).alias("clock"))


@query
def q63_faults(spark, sf):
    e = table(spark, sf, "events")
    node = lambda c, n: F.concat(F.lit("n"), (F.col(c) % n).cast("string"))
    calls = e.select(F.col("event_id").alias("id"), node("user_id", 5).alias("src"), node("event_id", 7).alias("dst"))
    return history.gate(calls, ["n0", "n1"], ["n3"], ["n6"]).select("id", "result")


@query
def q64_suspect(spark, sf):
    failed = spark.createDataFrame([("m1",), ("m2",), ("m3",), ("m4",), ("nobody",), ("m1",)], "id string")
    return membership.suspect(member_states(spark, sf), failed, "m3", 77).select("id", "incarnation", "severity", "since", "left")


@query
def q65_gossip_round(spark, sf):
    return membership.gossip_round(membership.gossip_round(member_states(spark, sf))).select("id", "left")


@query
def q66_log_files(spark, sf):
    log = views.log(spark, sf).withColumn("segment", (F.col("seq") / 1000).cast("bigint"))
    folder = scratch(spark, "segments")
    wal.write_segments(log, folder).agg(F.sum("frames")).first()
    return wal.read_segments(spark, folder).select("segment", "seq", "kind", F.decode("key", "UTF-8").alias("key"), F.decode("val", "UTF-8").alias("val"))


@query
def q67_table_files(spark, sf):
    log = views.log(spark, sf).withColumn("segment", F.col("run"))
    folder = scratch(spark, "tables")
    tables.write_tables(engine.flush(log, log.select("segment")), folder).agg(F.sum("entries")).first()
    return tables.read_tables(spark, folder).select("run", "seq", "kind", F.decode("key", "UTF-8").alias("key"), F.decode("val", "UTF-8").alias("val"))


@query
def q68_cache_hits(spark, sf):
    reads = table(spark, sf, "events").select((F.col("user_id") % 4).alias("engine"), F.col("event_id").alias("at"), F.lit(1).cast("bigint").alias("num"), F.col("user_id").alias("offset"), F.lit(100).cast("bigint").alias("bytes"))
    return engine.cache_hits(reads, 550)


@query
def q69_table_sets(spark, sf):
    t = table(spark, sf, "supplier").select((F.col("s_suppkey") % 10).alias("engine"), F.col("s_suppkey").alias("num"))
    picked = t.where("num % 3 <> 0 or engine < 4")
    kept = engine.remaining_tables(t, picked.select("num"))
    return kept.join(engine.full_merge(t, picked), "engine", "left").select("engine", "num", "every").unionByName(engine.full_merge(t, picked).select("engine", F.lit(None).cast("bigint").alias("num"), "every"))


@query
def q70_merkle_bytes(spark, sf):
    trees = merkle.serialize(merkle.leaves(views.versions(spark, sf)))
    leaf = merkle.parse_trees(trees).groupBy("node").agg(F.count("*").alias("leaves"))
    return trees.join(leaf, "node").select("node", F.octet_length("tree").alias("n"), F.sha2("tree", 256).alias("digest"), "leaves")


@query
def q71_key_json(spark, sf):
    return order_keys(spark, sf).select("key", admin.key_json(F.col("key"), ring.Ring(ring_nodes(spark, sf), 32), 3).alias("json"))


@query
def q72_members_json(spark, sf):
    return admin.members_json(member_states(spark, sf))


@query
def q73_result_class(spark, sf):
    e = table(spark, sf, "events")
    failed, found, reads = F.col("event_id") % 9 == 0, F.col("event_id") % 4 != 0, F.col("event_type").isin("view", "click")
    return e.select("event_id", quorum.result_class(failed, found, reads).alias("result"))


@query
def q74_known_members(spark, sf):
    m = member_states(spark, sf)
    about = membership.negative_news(m, "m5").unionByName(membership.negative_news(m, "m6")).unionByName(membership.known(m, "m7"))
    return about.unionByName(membership.alive_count(m).select(F.lit("alive").alias("id"), F.col("n").alias("incarnation"), F.lit(None).cast("int").alias("severity")))
