"""Write path, files, replicas, repair, gossip, metrics and settings: exact cases, and nulls and empty tables."""

import random
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import versions
from tidemark.functions.hashing import fnv64, fnv64_array, hash64
from tidemark.operators import admin, bloom, changelog, engine, history, membership, merkle, metrics, quorum, replica, ring
from tidemark.sources import manifest, settings, tables, text_metrics, wal

LOG = "seq bigint, key string, kind int, val string"
STATE = "node string, key string, val string, clock map<string,bigint>, ts bigint, deleted boolean"
MEMBER = "id string, incarnation bigint, severity int, since bigint, left bigint"


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- faults that were found


def test_hashes_beside_a_null_are_exact(spark):
    df = spark.createDataFrame([(f"key-{i}",) for i in range(50)] + [(None,)], "key string").coalesce(1)
    got = dict(rows(df.select("key", fnv64(F.col("key")))))
    want = fnv64_array([f"key-{i}".encode() for i in range(50)]).view(np.int64)
    assert [got[f"key-{i}"] for i in range(50)] == want.tolist() and got[None] is None
    assert dict(rows(df.select("key", hash64(F.col("key")))))[None] is None
    bits = bloom.build(df, 1024, 7)
    assert all(may for _, may in rows(bloom.probe(bits, df, 1024, 7))) and bloom.probe(bits, df, 1024, 7).count() == 50


def test_different_versions_have_different_leaves(spark):
    data = [("a", "k", "v", {"a=1,b": 2}, 1, False), ("b", "k", "v", {"a": 1, "b": 2}, 1, False), ("c", "k", None, {"a": 1}, 1, False), ("d", "k", "", {"a": 1}, 1, False), ("e", "k", "", {"a": 1}, 1, True), ("f", "k", "|1", {}, 1, False)]
    df = spark.createDataFrame(data, STATE)
    leaf = {r.node: r.hash for r in merkle.leaves(df).collect()}
    # An absent and an empty value are the same value.
    assert len(leaf) == 6 and leaf["c"] == leaf["d"] and len(set(leaf.values())) == 5
    text = {r.node: r.t for r in df.select("node", merkle.encoding(*(F.col(c) for c in ("val", "clock", "ts", "deleted"))).alias("t")).collect()}
    assert text["a"] == '{"v":"dg==","c":{"a=1,b":2},"t":1}' and text["e"] == '{"c":{"a":1},"t":1,"d":true}' and text["f"] == '{"v":"fDE=","t":1}'


def test_rows_without_an_engine_are_an_engine(spark):
    df = spark.createDataFrame([(None, 1, "a", 1, "x" * 100), (1, 2, "b", 1, "y"), (None, 3, "c", 1, "z")], "engine bigint, seq bigint, key string, kind int, val string")
    got = {r.engine: (r.first_seq, r.last_seq, r["keys"]) for r in changelog.rotations(df, 1000).collect()}
    assert got == {None: (1, 3, 2), 1: (2, 2, 1)}


def test_numbers_of_samples(spark):
    lines = ["a 1.0f", "a 2d", "b 1e999", "c 0x10", "d 1_0", "e +Inf", "f -inf", "g NaN", "h .5", "i 5.", "j 1e-3", "k +2", "l infinit"]
    got = {r.name: r.value for r in text_metrics.parse_samples(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert got.pop("g") != got.get("g") and got == {"e": float("inf"), "f": float("-inf"), "h": 0.5, "i": 5.0, "j": 0.001, "k": 2.0}


def test_null_keys_have_no_owner(spark):
    r = ring.Ring(["a", "b", "b", "c"], 16)
    df = spark.createDataFrame([(None,), ("k",), ("",)], "key string")
    got = {x.key: (x.o, x.p, x.s) for x in df.select("key", r.owner(F.col("key")).alias("o"), r.preference_list(F.col("key"), 2).alias("p"), r.in_scope(F.col("key"), "a", "b", 3).alias("s")).collect()}
    assert got[None] == (None, None, False) and got[""][0] in "abc" and got["k"][2] and len(r) == 3 and r.nodes == ["a", "b", "c"]


def test_a_member_that_nobody_names_is_there(spark):
    news = spark.createDataFrame([("a", 1, 0)], "id string, incarnation bigint, severity int")
    assert sorted(rows(membership.apply_news(news, "s", 4))) == [("a", 1, 0), ("s", 4, 0)]
    assert rows(membership.apply_news(news.limit(0), "s", 4)) == [("s", 4, 0)]


# --- write path and files


def test_writes_go_on_from_the_log(spark):
    log = spark.createDataFrame([(7, "a", 1, "x")], LOG)
    new = spark.createDataFrame([(3, "b", 1, "late"), (1, "c", 1, "early"), (2, "", 1, "none"), (4, None, 1, "none"), (5, "a", 2, "dropped")], "at bigint, key string, kind int, val string")
    out, refused = engine.write(log, new)
    assert sorted(rows(out)) == [(7, "a", 1, "x"), (8, "c", 1, "early"), (9, "b", 1, "late"), (10, "a", 2, None)]
    assert sorted((r.at, r.result) for r in refused.collect()) == [(2, "empty key"), (4, "empty key")]
    first, _ = engine.put(log.limit(0), new.where("key = 'b'").select("at", "key", "val"))
    assert rows(first) == [(1, "b", 1, "late")]
    gone, _ = engine.delete(first, new.where("key = 'c'"))
    assert sorted(rows(gone))[1] == (2, "c", 2, None)
    assert engine.stalled(4) and not engine.stalled(3)


def test_a_flush_and_a_restart_keep_all(spark, tmp_path):
    folder = tmp_path.as_uri()
    log = spark.createDataFrame([(s, f"key{s % 40:04d}", 2 if s % 9 == 0 else 1, None if s % 9 == 0 else f"val{s}") for s in range(1, 200)], LOG).withColumn("segment", F.expr("seq div 50"))
    written = {r.segment: r.frames for r in wal.write_segments(log, folder).collect()}
    assert written == {0: 49, 1: 50, 2: 50, 3: 50}
    back = wal.read_segments(spark, folder)
    assert sorted((r.segment, r.seq, r.kind, bytes(r.key), bytes(r.val)) for r in back.collect()) == sorted((r.segment, r.seq, r.kind, r.key.encode(), (r.val or "").encode()) for r in log.collect())
    state, found = manifest.read_manifest(folder)
    assert not found and state["tables"] == []
    files = engine.flush(log, spark.createDataFrame([(0,), (1,)], "segment bigint"))
    assert {r.run for r in tables.write_tables(files, folder, 256).collect()} == {0, 1}
    manifest.write_manifest(folder, engine.flushed_state(state, [0, 1], 99))
    state, found = manifest.read_manifest(folder)
    assert found and state == {"tables": [0, 1], "next_file_num": 2, "last_flushed_wal": 1, "last_seq": 99}
    flushed = tables.read_tables(spark, folder).select("seq", F.decode("key", "UTF-8").alias("key"), "kind", F.decode("val", "UTF-8").alias("val"))
    got = changelog.recover(log, flushed, state["last_flushed_wal"], 500).where("kind = 1")
    assert dict(rows(got.select("key", "val"))) == dict(rows(changelog.live_scan(log).select("key", "val"))) and {r.next_seq for r in got.collect()} == {501}
    (tmp_path / "MANIFEST").write_text("[]")
    with pytest.raises(ValueError, match="no manifest"):
        manifest.read_manifest(folder)


def test_tables_are_read_by_index_and_by_filter(spark, tmp_path):
    folder = tmp_path.as_uri()
    data = [(1, f"user:{k}", k, 1, f"v{k}") for k in range(1000, 1500)] + [(1, "user:2001", 2001, 2, None), (2, "user:1001", 9999, 1, "newer"), (2, "zz", 3, 1, "")]
    df = spark.createDataFrame(data, "run bigint, key string, seq bigint, kind int, val string")
    info = {r.run: r for r in tables.write_tables(df, folder, 512).collect()}
    assert info[1].entries == 501 and info[1].blocks > 10 and tables.read_index(spark, folder).where("run = 1").count() == info[1].blocks
    got = {(r.run, bytes(r.key)): (r.seq, r.kind, bytes(r.val)) for r in tables.get_from_tables(spark, folder, [b"user:1001", b"user:2001", b"absent", b"", b"zzz"]).collect()}
    assert got == {(1, b"user:1001"): (1001, 1, b"v1001"), (2, b"user:1001"): (9999, 1, b"newer"), (1, b"user:2001"): (2001, 2, b"")}
    keys = [bytes(r.key) for r in tables.read_tables(spark, folder).where("run = 1").collect()]
    assert keys == sorted(keys) and len(keys) == 501
    with pytest.raises(PySparkException, match="have to ascend"):
        tables.write_tables(df.unionByName(df.limit(1)), folder).collect()
    for name, content in (("000007.sst", b"short"), ("000008.sst", b"x" * 60)):
        (tmp_path / "bad").mkdir(exist_ok=True)
        (tmp_path / "bad" / name).write_bytes(content)
        with pytest.raises(PySparkException):
            tables.read_tables(spark, (tmp_path / "bad").as_uri()).collect()
    assert tables.decode_entry(tables.encode_entry(b"k", 300, 2, b"")) == ((b"k", 300, 2, b""), 6)
    with pytest.raises(ValueError):
        tables.decode_entry(tables.encode_entry(b"key", 1, 1, b"value")[:-2])


def test_a_stored_filter_is_the_table_of_bits(spark):
    keys = [f"present-{i}" for i in range(1000)]
    bits, k = bloom.sizing(1000)
    packed = bloom.pack(fnv64_array([x.encode() for x in keys]), bits, k)
    df = spark.createDataFrame([(x,) for x in keys], "key string")
    assert (bits, k) == (9592, 7) and bytes(bloom.stored(bloom.build(df, bits, k), bits, k).first()[0]) == packed
    assert bloom.may_contain(packed, [x.encode() for x in keys]).all()
    assert bloom.may_contain(packed, [f"absent-{i}".encode() for i in range(10000)]).mean() <= 0.05
    for bad in (b"", packed[:-1], packed[:4] + b"\0\0\0\0" + packed[8:]):
        with pytest.raises(ValueError):
            bloom.load(bad)


def test_cache_forgets_the_block_used_longest_ago(spark):
    r = random.Random(2)
    reads = [(e, i, r.randrange(3), r.randrange(9) * 100, r.choice([50, 100, 300])) for e in (1, 2) for i in range(300)]
    size = {(e, n, o): b for e, _, n, o, b in reads}
    reads = [(e, i, n, o, size[e, n, o]) for e, i, n, o, _ in reads]
    want = {}
    for e in (1, 2):
        held = OrderedDict()
        for _, i, n, o, b in (x for x in reads if x[0] == e):
            want[e, i] = (n, o) in held
            held[n, o] = b
            held.move_to_end((n, o))
            while sum(held.values()) > 900:
                held.popitem(last=False)
    df = spark.createDataFrame(reads, "engine bigint, at bigint, num bigint, offset bigint, bytes bigint").repartition(3)
    assert {(x.engine, x.at): x.hit for x in engine.cache_hits(df, 900).collect()} == want
    assert engine.cache_hits(df.limit(0)).count() == 0


# --- replicas and repair


def test_versions_come_back_from_their_stored_form(spark):
    data = [(1, "a", "v", {"n0": 2, "n<1>": 1}, 5, False), (2, "b", None, {}, 6, True), (3, "c", "日本", None, 7, False), (4, "a", "w", {"n0": 3}, 8, False)]
    log = replica.stored_log(spark.createDataFrame(data, "seq bigint, key string, val string, clock map<string,bigint>, ts bigint, deleted boolean"))
    got = {r.key: (bytes(r.val).decode(), r.clock, r.ts, r.deleted) for r in replica.replica_scan(log).collect()}
    assert got == {"a": ("w", {"n0": 3}, 8, False), "b": ("", {}, 6, True), "c": ("日本", {}, 7, False)}
    assert [r.key for r in replica.replica_scan(log, F.col("key") > "a").orderBy("key").collect()] == ["b", "c"]
    asked = spark.createDataFrame([("a",), ("zz",)], "key string")
    assert sorted((r.key, r.found, r.ts) for r in replica.replica_read(log, asked).collect()) == [("a", True, 8), ("zz", False, None)]
    bad = log.withColumn("val", F.lit("not json"))
    with pytest.raises(PySparkException, match="unreadable version"):
        replica.replica_scan(bad).collect()
    texts = spark.createDataFrame([('{"t":1}',), ("",), ("[1]",), ('{"v":"!"}',), (None,)], "s string")
    assert [r[0] is not None for r in texts.select(versions.decode(F.col("s"))).collect()] == [True, False, False, False, False]


def test_what_clients_send(spark):
    df = spark.createDataFrame([("x", "eA=="), (None, None), (None, "!!"), (None, "eA=="), ("", None)], "value string, value_base64 string")
    got = [(r.v.bytes and bytes(r.v.bytes), r.v.error) for r in df.select(replica.decoded_value(F.col("value"), F.col("value_base64")).alias("v")).collect()]
    assert got == [(None, "provide exactly one of value or value_base64"), (None, "provide value or value_base64"), (None, "value_base64 is not valid base64"), (b"x", None), (bytearray(b""), None)]


def test_a_second_repair_pushes_nothing(spark):
    base = [("n0", k, f"v{k}", {"p": 1}, 1, False) for k in "abcde"]
    other = [("n1", "b", "vb", {"p": 1}, 1, False), ("n1", "c", "new", {"p": 2}, 2, False), ("n1", "d", "other", {"q": 1}, 9, False), ("n2", "e", "equal clocks", {"p": 1}, 1, False)]
    df = spark.createDataFrame(base + other, STATE)
    pairs = [("n0", "n1", None), ("n0", "n2", None), ("n1", "n2", None)]
    split, pushed = merkle.anti_entropy(df, pairs, {("n1", "n0")})
    assert [(r.a, r.b) for r in pushed.collect()] == [("n0", "n1")] and split.where("node = 'n2'").count() == 1
    once, _ = merkle.anti_entropy(split, pairs)
    state = {(r.node, r.key): r.val for r in once.collect()}
    assert len(state) == 15 and len({tuple(state[n, k] for k in "abcde") for n in ("n0", "n1", "n2")}) == 1
    assert state["n2", "c"] == "new" and state["n0", "d"] == "other" and state["n0", "e"] == "ve"
    again, pushed = merkle.anti_entropy(once, pairs)
    assert [r.pushes for r in pushed.collect()] == [0, 0, 0] and again.count() == 15
    scoped, n = merkle.repair(df, "n0", "n1", F.col("key") == "c")
    assert n == 2 and {r.val for r in scoped.where("key = 'c'").collect()} == {"new"} and scoped.where("node = 'n1'").count() == 3
    trees = merkle.serialize(merkle.leaves(df))
    assert {r.n for r in trees.select(F.octet_length("tree").alias("n")).collect()} == {16384}
    assert sorted(rows(merkle.parse_trees(trees))) == sorted(rows(merkle.full_leaves(merkle.leaves(df))))
    with pytest.raises(PySparkException, match="a tree has 3 bytes"):
        merkle.parse_trees(spark.createDataFrame([("n", bytearray(b"abc"))], "node string, tree binary")).collect()
    assert merkle.roots(merkle.leaves(df.limit(0))).count() == 0


# --- quorums, gossip, faults


def test_a_write_steps_the_first_preferred_nodes_counter(spark):
    replies = spark.createDataFrame([("k", "a", True, {"a": 2}), ("k", "b", True, {"b": 1}), ("k", "c", False, {"c": 9}), ("j", "a", False, {"a": 5})], "key string, node string, ok boolean, clock map<string,bigint>")
    assert dict(rows(quorum.merged_clocks(replies, ["key"]))) == {"k": {"a": 2, "b": 1}, "j": {}}
    writes = spark.createDataFrame([("k", "v", 1, False, ["b", "c", "a", "d"]), ("new", "w", 2, True, ["a", "b", "c", "d"])], "key string, val string, ts bigint, deleted boolean, candidates array<string>")
    outcomes, sent, hints = quorum.quorum_write(writes, replies, "key", 3, 2, F.col("node") != "c")
    assert {r.key: (r.val, r.clock) for r in sent.collect()} == {"k": ("v", {"a": 2, "b": 2}), "new": (None, {"a": 1})}
    assert sorted(rows(outcomes)) == [("k", 3, 1, "ok"), ("new", 3, 1, "ok")]
    assert sorted((r.key, r.intended, r.holder, r.ts) for r in hints.collect()) == [("k", "c", "d", 1), ("new", "c", "d", 2)]
    assert quorum.check_cluster(["a"]) == (3, 2, 2) and quorum.check_cluster(["a", "b"], 1, 1, 1) == (1, 1, 1)
    for bad in (([],), (["a", "a"],), ([""],), (["a"], 2, 3, 1), (["a"], 2, 1, 3)):
        with pytest.raises(ValueError):
            quorum.check_cluster(*bad)


def test_gossip_spends_its_budget(spark):
    m = spark.createDataFrame([("a", 1, 0, 0, 2), ("b", 1, 0, 0, 1), ("c", 1, 0, 0, 0)], MEMBER)
    sent = 0
    for _ in range(5):
        sent += membership.gossip(m).where("id = 'a'").count()
        m = spark.createDataFrame(membership.gossip_round(m).select("id", "incarnation", "severity", "since", "left").collect(), MEMBER)
    assert sent == 2 and {r.left for r in m.collect()} == {0}
    one = membership.gossip_round(spark.createDataFrame([("a", 1, 0, 0, 1), ("b", 1, 0, 0, 1)], MEMBER), 1)
    assert dict(rows(one.select("id", "left"))) == {"a": 0, "b": 1}


def test_peers_and_rounds(spark):
    m = spark.createDataFrame([("s", 1, 0, 0, 0), ("a", 1, 0, 0, 0), ("b", 2, 0, 0, 0), ("c", 1, 2, 0, 0), ("d", 4, 1, 3, 0)], MEMBER)
    peers = membership.random_peers(m, "s", 10, "b", 3)
    assert {r.id for r in peers.collect()} == {"a", "d"} and membership.random_peers(m, "s", 1, None, 3).count() == 1
    orders = {tuple(r.id for r in membership.probe_order(m, "s", seed, 0).collect()) for seed in range(12)}
    assert len(orders) > 1 and all(sorted(o) == ["a", "b", "d"] for o in orders)
    cols = ["id", "incarnation", "severity", "since", "left"]
    failed = spark.createDataFrame([("a",), ("s",), ("c",), ("x",)], "id string")
    assert sorted(rows(membership.suspect(m, failed, "s", 9).select(cols)))[:3] == [("a", 1, 1, 9, 3), ("b", 2, 0, 0, 0), ("c", 1, 2, 0, 0)]
    everyone = ["s", "a", "b", "c", "d"]
    full = spark.createDataFrame([(x, y) for x in everyone for y in everyone if x != y], "src string, dst string")
    assert sorted(rows(membership.protocol_round(m, full, "s", 5, 1).select(cols))) == sorted(rows(m))
    target = membership.probe_order(m, "s", 1, 5).first().id
    # The direct way is cut, but two relays reach it; then nobody does.
    cut = full.where(f"not (src = 's' and dst = '{target}')")
    assert {r.id: r.severity for r in membership.protocol_round(m, cut, "s", 5, 1).collect()}[target] == m.where(f"id = '{target}'").first().severity
    lone = full.where(f"dst <> '{target}'")
    assert {r.id: r.severity for r in membership.protocol_round(m, lone, "s", 5, 1).collect()}[target] >= 1
    late = {r.id: (r.severity, r.left) for r in membership.protocol_round(m, full, "s", 7, 1).collect()}
    assert late["d"] == (2, 3) and late["c"] == (2, 0)


def test_faults_of_the_network(spark):
    calls = spark.createDataFrame([(i, f"n{i % 4}", f"n{i // 4 % 5}") for i in range(4000)], "id bigint, src string, dst string")
    out = history.gate(calls, ["n0"], ["n3"], ["n4"], 0.25, (10, 20), 18, seed=5).toPandas()
    assert (out[out.dst == "n4"].result == "skipped").all() and (out[(out.src == out.dst) & (out.dst != "n4")].result == "ok").all()
    assert (out[(out.src == "n0") & out.dst.isin(["n1", "n2", "n3"])].result == "unavailable").all()
    assert (out[out.src.isin(["n1", "n2"]) & (out.dst == "n3")].result == "timeout").all()
    rest = out[out.src.isin(["n1", "n2"]) & out.dst.isin(["n1", "n2"]) & (out.src != out.dst)]
    assert abs((rest.result == "unavailable").mean() - 0.25) < 0.06
    took = rest[rest.result == "ok"].latency
    assert took.between(10, 18).all() and took.nunique() == 9 and (rest.result == "timeout").any()
    again = history.gate(calls.repartition(7), ["n0"], ["n3"], ["n4"], 0.25, (10, 20), 18, seed=5).toPandas()
    assert again.set_index("id").result.sort_index().equals(out.set_index("id").result.sort_index())


# --- metrics, admin, settings


def test_histogram_has_sum_and_count(spark):
    df = spark.createDataFrame([("get", 0.005), ("get", 0.05), ("get", 5.0), ("get", None), ("idle", None)], "op string, v double")
    got = {(r.op, r.le): (r.n, round(r["sum"], 6), r["count"]) for r in metrics.histogram(df, ["op"], F.col("v"), [1.0, 0.01, 0.1]).collect()}
    assert [got["get", le] for le in ("0.01", "0.1", "1", "+Inf")] == [(1, 5.055, 3), (2, 5.055, 3), (2, 5.055, 3), (3, 5.055, 3)] and got["idle", "+Inf"] == (0, 0, 0)
    lines = [r.line for r in metrics.histogram_exposition(metrics.histogram(df.where("op = 'get'"), ["op"], F.col("v"), [0.01]), "s", "h", ["op"], [0.01]).collect()]
    assert lines == ["# HELP s h", "# TYPE s histogram", 's_bucket{op="get",le="0.01"} 1', 's_bucket{op="get",le="+Inf"} 3', 's_sum{op="get"} 5.055', 's_count{op="get"} 3']
    registry = metrics.Registry()
    registry.register("up", "Up.", "gauge", [])
    registry.register("s", "h", "histogram", ["op"])
    with pytest.raises(ValueError, match="registered already"):
        registry.register("up", "", "counter", [])
    with pytest.raises(ValueError, match="lacks the labels"):
        registry.expose({"s": spark.createDataFrame([("1", 1)], "le string, n bigint")})
    assert [r.line for r in registry.expose({"up": spark.createDataFrame([(1,)], "n bigint")}).collect()] == ["# HELP up Up.", "# TYPE up gauge", "up 1"]


def test_gauges(spark):
    data = [("a", "set", 5, 1), ("a", "add", 3, 2), ("a", "sub", 1, 3), ("a", "set", 10, 4), ("a", "add", 2, 5), ("b", "add", 7, 1), (None, "set", 1, 1)]
    df = spark.createDataFrame(data, "g string, op string, value bigint, at bigint")
    got = dict(rows(metrics.gauge_values(df, ["g"])))
    assert got == {"a": 12, "b": 7, None: 1}
    assert rows(metrics.gauge_values(df.where("g = 'b'"), []))[0] == (7,)


def test_views_of_nodes(spark):
    m = spark.createDataFrame([("b", 2, 1), ("a", 1, 0)], "id string, incarnation bigint, severity int")
    assert admin.members_json(m).first().json == '{"members":[{"id":"a","state":"alive","incarnation":1},{"id":"b","state":"suspect","incarnation":2}]}'
    assert admin.members_json(m.limit(0)).first().json == '{"members":[]}'
    assert admin.ring_json(spark, ring.Ring([], 4)).first().json == '{"vnodes":4,"size":0,"nodes":[]}'
    keys = spark.createDataFrame([("k",), ("",), (None,)], "key string")
    assert [r[0] for r in keys.select(admin.key_json(F.col("key"), ring.Ring([]), 2)).collect()] == ['{"key":"k","n":2,"preference_list":[]}', None, None]
    stats = changelog.stats(spark.createDataFrame([(4, "a", 1, "x", 0)], LOG + ", run int"))
    assert admin.status_json(stats, "n0", {"n": 3}, 12).first().json == '{"node_id":"n0","uptime_seconds":12,"config":{"n":3},"storage":{"memtable_keys":1,"approx_bytes":50,"next_seq":5,"sstables":1}}'
    nodes = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "place int, node string")
    answers = spark.createDataFrame([("x", 200, "abcdef"), ("y", 503, "no")], "node string, status int, body string")
    assert sorted(rows(admin.fan_out(nodes, answers, most=4))) == [(0, "x", True, None, "abcd"), (1, "y", False, "node returned status 503", None), (2, "z", False, "no answer", None)]


def test_settings():
    assert settings.parse_peers("P", " a=h:1, b=h:2,") == {"a": "h:1", "b": "h:2"}
    assert settings.parse_duration("D", "1h30m") == 5400 * 10**9 and settings.parse_duration("D", "-1.5ms") == -1_500_000 and settings.parse_duration("D", "0") == 0
    assert settings.parse_int("I", " 12 ") == 12 and settings.parse_bool("B", "T") and not settings.parse_bool("B", "0")
    for parse, bad in ((settings.parse_peers, "a=,b"), (settings.parse_peers, ""), (settings.parse_duration, "5"), (settings.parse_duration, "1x"), (settings.parse_int, "1.0"), (settings.parse_bool, "yes")):
        with pytest.raises(ValueError):
            parse("N", bad)
    got = settings.EngineSettings.read({"TIDEMARK_LOG_LEVEL": "WARN", "TIDEMARK_MAX_KEY_BYTES": "9", "TIDEMARK_SYNC_WRITES": "false", "OTHER": "1"})
    assert (got.log_level, got.max_key_bytes, got.sync_writes) == ("warn", 9, False)
    for name, bad in (("MAX_VALUE_BYTES", "0"), ("COMPACTION_MIN_THRESHOLD", "1"), ("LOG_FORMAT", "xml"), ("DATA_DIR", " ")):
        with pytest.raises(ValueError):
            settings.EngineSettings.read({"TIDEMARK_" + name: bad})


# --- rules in order, against plain loops


def test_rotation_equals_a_loop_over_writes(spark):
    r = random.Random(31)
    rows_ = [(e, q, f"k{r.randrange(30)}", 2 if r.random() < 0.2 else 1, "v" * r.randrange(200)) for e in (1, 2, 3) for q in range(4000)]
    want = []
    for e in (1, 2, 3):
        sizes, total, number, first, last = {}, 0, 0, None, None
        for _, q, k, kind, v in (x for x in rows_ if x[0] == e):
            n = len(v) if kind == 1 else 0
            total += n - sizes[k] if k in sizes else len(k) + n + 48
            sizes[k], first, last = n, q if first is None else first, q
            if total >= 3000:
                want.append((e, number, first, last, len(sizes), total, False))
                sizes, total, number, first = {}, 0, number + 1, None
        if first is not None:
            want.append((e, number, first, last, len(sizes), total, True))
    df = spark.createDataFrame(rows_, "engine bigint, seq bigint, key string, kind int, val string").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for batch in (before, "700"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        assert sorted(rows(changelog.rotations(df, 3000))) == sorted(want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert changelog.rotations(df.limit(0), 3000).count() == 0


def test_blocks_equal_a_loop_over_entries(spark):
    r = random.Random(32)
    data = [(t, f"key{i:06d}", r.choice([5, 40, 90, 5000])) for t in ("a", "b", None) for i in range(3000)]
    want = []
    for t in ("a", "b", None):
        block, total, n, first, last = 0, 0, 0, None, None
        for _, k, b in (x for x in data if x[0] == t):
            total, n, first, last = total + b, n + 1, k if first is None else first, k
            if total >= 4096:
                want.append((t, block, first, last, n, total))
                block, total, n, first = block + 1, 0, 0, None
        if n:
            want.append((t, block, first, last, n, total))
    df = spark.createDataFrame(data, "run string, key string, bytes bigint").repartition(4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    assert sorted(rows(changelog.blocks(df)), key=repr) == sorted(want, key=repr)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_freshness_equals_every_get_against_every_put(spark):
    r = random.Random(33)
    ops = []
    for i in range(700):
        key, at = f"k{r.choice([0, 0, 0, 1, 2])}", r.randrange(3000)
        put = r.random() < 0.5
        found = put or r.random() < 0.85
        ops.append((i, "put" if put else "get", key, f"v{i}" if put else (f"v{r.randrange(700)}" if found else None), found, r.random() < 0.9, at, at + r.choice([0, 1, 5, 300])))
    want = {}
    for i, kind, key, value, found, ok, s, e in ops:
        if kind != "get" or not ok:
            continue
        puts = sorted((x[6], x[0], x[3], x[7]) for x in ops if x[1] == "put" and x[5] and x[2] == key)
        done = max((n for n, p in enumerate(puts, 1) if p[3] < s), default=0)
        seen = max((n for n, p in enumerate(puts, 1) if p[0] < e), default=0)
        fine = any(p[2] == value for n, p in enumerate(puts, 1) if max(done, 1) <= n <= seen) if found else done == 0
        if not fine:
            want[i] = puts[done - 1][2] if done else None
    df = spark.createDataFrame(ops, "id bigint, kind string, key string, value string, found boolean, ok boolean, start_seq bigint, end_seq bigint").repartition(4)
    for width in (10, 500, 1 << 16):
        assert {x.id: x.expected for x in history.freshness_faults(df, width).collect()} == want
    assert history.freshness_faults(df.limit(0)).count() == 0
