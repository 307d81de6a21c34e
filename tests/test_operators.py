"""Operators on small hand-built tables: expected values, violations that have to be found, and order-freedom."""

import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import clocks
from tidemark.functions.hashing import fnv64_array, hash64_array, ordered, unsigned, unsigned_mod
from tidemark.operators import bloom, changelog, history, membership, merkle, metrics, quorum, resolve, ring
from tidemark.sources import text_metrics, wal
from tidemark.streaming import windows

CLOCK = "map<string,bigint>"
VERSION = f"val string, clock {CLOCK}, ts bigint, deleted boolean"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_scan_merges_tiers_and_drops_tombstones(spark):
    log = [(i + 1, k, 1, f"v-{k}") for i, k in enumerate("abcd")] + [(5, "b", 2, None), (6, "c", 1, "v-c2"), (7, "e", 1, "v-e")]
    df = spark.createDataFrame(log, "seq bigint, key string, kind int, val string")
    assert rows(changelog.live_scan(df).select("key", "val")) == [("a", "v-a"), ("c", "v-c2"), ("d", "v-d"), ("e", "v-e")]
    asked = spark.createDataFrame([("a",), ("b",), ("z",)], "key string")
    assert sorted(rows(changelog.multi_get(df, asked))) == [("a", True, "v-a"), ("b", False, None), ("z", False, None)]
    runs = df.withColumn("run", F.lit(0))
    assert "b" not in {r.key for r in changelog.compact(runs, [0], True).collect()}
    assert "b" in {r.key for r in changelog.compact(runs, [0], False).collect()}


def test_empty_log(spark):
    df = spark.createDataFrame([], "seq bigint, key string, kind int, val string, run int")
    assert rows(changelog.live_scan(df)) == []
    assert rows(changelog.stats(df)) == [(0, 0, 1, 0)]


@pytest.mark.parametrize(("threshold", "want"), [(3, [1, 2, 3]), (5, []), (1, [])])
def test_size_tiers(spark, threshold, want):
    df = spark.createDataFrame([(0, 1, 100), (0, 2, 110), (0, 3, 105), (0, 4, 10000)], "engine bigint, num bigint, size bigint")
    assert sorted(r.num for r in changelog.pick_buckets(df, threshold).collect()) == want


def test_rotation_counts_overwrites_by_value_only(spark):
    log = [(0, 1, "k", 1, "x" * 10), (0, 2, "k", 1, "x" * 30), (0, 3, "l", 1, "y" * 60), (0, 4, "m", 2, None)]
    df = spark.createDataFrame(log, "engine bigint, seq bigint, key string, kind int, val string")
    assert sorted(rows(changelog.rotations(df, 150))) == [(0, 0, 1, 3, 2, 1 + 48 + 30 + 1 + 48 + 60, False), (0, 1, 4, 4, 1, 49, True)]


def test_bloom(spark):
    bits, hashes = bloom.sizing(1000)
    assert (bits, hashes) == (9592, 7) and bloom.sizing(1) == (16, 11) and bloom.sizing(0, 5) == (16, 11)
    keys = spark.range(1000).select(F.concat(F.lit("present-"), F.col("id").cast("string")).alias("key"))
    asked = keys.unionByName(spark.range(10000).select(F.concat(F.lit("absent-"), F.col("id").cast("string")).alias("key")))
    got = bloom.probe(bloom.build(keys, bits, hashes), asked, bits, hashes).toPandas().set_index("key")["may_contain"]
    assert got[got.index.str.startswith("present")].all()
    assert got[got.index.str.startswith("absent")].mean() <= 0.05


def test_hashes():
    assert [int(x) for x in hash64_array([b"key-1", b"a#0"])] == [13690918013821086169, 599493276533224484]
    assert int(fnv64_array([b""])[0]) == 14695981039346656037


def test_unsigned_hashes(spark):
    df = spark.createDataFrame([(-1,), (0,), (5,), (-(2**63),)], "h bigint")
    got = rows(df.select(unsigned(F.col("h")).cast("string"), unsigned_mod(F.col("h"), 256), unsigned_mod(F.col("h"), 7)))
    assert got == [(str(x), x % 256, x % 7) for x in (2**64 - 1, 0, 5, 2**63)]
    assert [r.h for r in df.orderBy(ordered(F.col("h"))).collect()] == [0, 5, -(2**63), -1]


def test_ring(spark):
    keys = spark.range(30000).select(F.concat(F.lit("key-"), F.col("id").cast("string")).alias("key"))
    r = ring.Ring(["a", "b", "c"], 256)
    share = dict(rows(ring.distribution(keys.select(r.owner(F.col("key")).alias("node")))))
    assert set(share) == {"a", "b", "c"} and all(7500 <= n <= 12500 for n in share.values())
    assert {x.src for x in ring.moves(keys, r, ring.Ring(["a", "b"], 256)).collect()} == {"c"}
    assert {x.dst for x in ring.moves(keys, r, ring.Ring(["a", "b", "c", "d"], 256)).collect()} == {"d"}
    prefs = keys.limit(500).select(r.preference_list(F.col("key"), 10).alias("p"), r.owner(F.col("key")).alias("o")).collect()
    assert all(len(set(x.p)) == 3 and x.p[0] == x.o for x in prefs)
    assert ring.Ring([]).preferences(3) == []


CASES = [({}, {}, 0), ({"a": 1}, {"a": 1}, 0), ({"a": 1}, {"a": 2}, 1), ({"a": 2}, {"a": 1}, 2), ({"a": 1}, {"b": 1}, 3), ({}, {"a": 1}, 1), ({"a": 1, "b": 0}, {"a": 1}, 0), (None, {"a": 1}, 1)]


def test_clocks(spark):
    df = spark.createDataFrame(CASES, f"a {CLOCK}, b {CLOCK}, want int")
    assert all(r.got == r.want for r in df.select("want", clocks.compare(F.col("a"), F.col("b")).alias("got")).collect())
    got = df.select(clocks.show(clocks.merge(F.col("a"), F.col("b"))).alias("m"), clocks.show(clocks.increment(F.col("a"), F.lit("a"))).alias("i")).collect()
    assert [r.m for r in got] == ["", "a=1", "a=2", "a=2", "a=1,b=1", "a=1", "a=1", "a=1"]
    assert got[3].i == "a=3" and got[7].i == "a=1"


def test_pairwise_rule_keeps_the_order_of_arguments(spark):
    a, b = ("x", {"p": 1}, 100, False), ("y", {"p": 1}, 200, False)
    df = spark.createDataFrame([(a, b), (b, a), (a, ("y", {"q": 1}, 200, False)), (("l", {"p": 2}, 5, False), ("", {"p": 3}, 4, True))], f"a struct<{VERSION.replace(' string', ':string').replace(f' {CLOCK}', f':{CLOCK}').replace(' bigint', ':bigint', 1).replace(' boolean', ':boolean')}>, b struct<val:string,clock:{CLOCK},ts:bigint,deleted:boolean>")
    got = df.select(resolve.reconcile_pair(F.col("a"), F.col("b")).alias("r")).select("r.*").collect()
    assert [r.val for r in got] == ["x", "y", "y", ""] and got[2].clock == {"p": 1, "q": 1} and got[3].deleted


def test_group_fold_is_free_of_order(spark):
    rng = random.Random(5)
    groups = []
    for g in range(200):
        vs = [(str(rng.randint(0, 3)), {n: c for n in "pqr" if (c := rng.randint(0, 2))}, rng.randint(0, 5), rng.random() < 0.3) for _ in range(rng.randint(1, 4))]
        groups.append((g, vs))
    out = []
    for seed in range(2):
        random.Random(seed).shuffle(groups)
        data = [(g, *v) for g, vs in groups for v in random.Random(seed * 7 + g).sample(vs, len(vs))]
        df = spark.createDataFrame(data, f"g int, {VERSION}")
        out.append(sorted(rows(resolve.reconcile_group(df, ["g"]).select("g", "val", clocks.show(F.col("clock")), "ts", "deleted"))))
    assert out[0] == out[1] and len(out[0]) == 200
    skewed = spark.createDataFrame([(0, "a", {"x": 1}, 10, False), (0, "b", {"y": 1}, 20, False), (0, "c", {"y": 2}, 5, False)], f"g int, {VERSION}")
    assert rows(resolve.reconcile_group(skewed, ["g"]).select("val", clocks.show(F.col("clock")))) == [("a", "x=1,y=2")]


def test_hints(spark):
    data = [("h", "X", "k", "v1", {"p": 1}, 1, False), ("h", "X", "k", "v2", {"p": 2}, 2, False), ("h", "X", "k2", "a", {"p": 1}, 1, False), ("h", "Y", "k3", "b", {"p": 1}, 1, False)]
    pending = quorum.pending_hints(spark.createDataFrame(data, f"holder string, intended string, key string, {VERSION}"))
    assert sorted(rows(pending.select("key", "val"))) == [("k", "v2"), ("k2", "a"), ("k3", "b")]
    sent, kept = quorum.deliver(pending, spark.createDataFrame([("X",)], "node string"))
    assert sent.count() == 2 and rows(kept.select("key")) == [("k3",)]


def test_write_needs_a_quorum(spark):
    tried = [(1, 0, "a", True, True), (1, 1, "b", True, False), (1, 2, "c", True, False), (1, 3, "d", False, True), (2, 0, "a", True, False), (2, 1, "b", True, False), (2, 2, "c", True, True), (2, 3, "d", False, False)]
    df = spark.createDataFrame(tried, "w int, place int, node string, preferred boolean, ok boolean")
    assert sorted(rows(quorum.write_outcomes(df, "w", 2))) == [(1, 2, 1, "ok"), (2, 1, 0, "error")]
    assert rows(quorum.hint_plan(df, "w")) == [(1, "b", "d")]


def test_merkle_finds_what_differs(spark):
    base = [("n0", k, f"v{k}", {"p": 1}, 1, False) for k in "abc"]
    other = [("n1", "b", "vb", {"p": 1}, 1, False), ("n1", "c", "new", {"p": 2}, 2, False)]
    df = spark.createDataFrame(base + other, f"node string, key string, {VERSION}")
    pairs = spark.createDataFrame([("n0", "n1")], "a string, b string")
    want = {r.b for r in df.where("key in ('a', 'c')").select(merkle.bucket(F.col("key")).alias("b")).collect()}
    assert {r.bucket for r in merkle.differing(merkle.leaves(df), pairs).collect()} == want
    same = df.where("node = 'n0'")
    twin = same.unionByName(same.withColumn("node", F.lit("n1")))
    assert merkle.differing(merkle.leaves(twin), pairs).count() == 0 and len({r.root for r in merkle.roots(merkle.leaves(twin)).collect()}) == 1


def test_membership(spark):
    news = spark.createDataFrame([("a", 1, 0), ("a", 1, 2), ("a", 2, 0), ("s", 5, 1), ("b", 3, 1), ("b", 3, 1)], "id string, incarnation bigint, severity int")
    assert sorted(rows(membership.merge(news))) == [("a", 2, 0), ("b", 3, 1), ("s", 5, 1)]
    assert ("s", 6, 0) in rows(membership.apply_news(news, "s", 1))
    assert ("s", 9, 0) in rows(membership.apply_news(news, "s", 9))
    m = spark.createDataFrame([("a", 1, 1, 0, 2), ("b", 1, 0, 0, 0)], "id string, incarnation bigint, severity int, since bigint, left bigint")
    assert [membership.expire(m, t, 3).where("id = 'a'").first().severity for t in (2, 3)] == [1, 2]
    assert rows(membership.gossip(m).select("id")) == [("a",)]
    assert dict(rows(membership.state_counts(m))) == {"alive": 1, "suspect": 1, "dead": 0}


def test_histogram_and_exposition(spark):
    df = spark.createDataFrame([("get", 0.005), ("get", 0.05), ("get", 5.0)], "op string, v double")
    assert [(r.le, r.n) for r in metrics.histogram(df, ["op"], F.col("v"), [0.01, 0.1, 1.0]).collect()] == [("0.01", 1), ("0.1", 2), ("1", 2), ("+Inf", 3)]
    odd = spark.createDataFrame([('a"b\\c\nd', 2)], "path string, n bigint")
    assert [r.line for r in metrics.exposition(odd, "m", "h\\\n", "counter", ["path"]).collect()] == ["# HELP m h\\\\\\n", "# TYPE m counter", 'm{path="a\\"b\\\\c\\nd"} 2']


def test_metric_text(spark):
    lines = ["# HELP x", "", "up 1", 'a{k="v",q="a,b"} 2.5 1700000000', "bad", "worse x", "  pad   3 ", "b{} 4"]
    got = text_metrics.parse_samples(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [(r.name, dict(r.labels), r.value) for r in got] == [("up", {}, 1.0), ("a", {"k": "v", "q": "a,b"}, 2.5), ("pad", {}, 3.0), ("b", {}, 4.0)]
    assert spark.range(1).select(text_metrics.parse_labels(F.lit('state="a,b",kind="x", =z, n'))).first()[0] == {"state": "a,b", "kind": "x"}
    codes = spark.createDataFrame([("InvalidArgument",), ("Unavailable",), ("DeadlineExceeded",), ("Internal",)], "c string")
    assert [r[0] for r in codes.select(text_metrics.http_status(F.col("c"))).collect()] == [400, 503, 504, 502]


def op(id_, kind, key, value, found=True, ok=True, at=0, end=None):
    return (id_, kind, key, value, found, ok, at, at + 1 if end is None else end)


def test_histories(spark):
    schema = "id bigint, kind string, key string, value string, found boolean, ok boolean, start_seq bigint, end_seq bigint"
    data = [op(1, "put", "k", "v1", at=0), op(2, "put", "k", "v2", at=10), op(3, "get", "k", "v1", at=20), op(4, "get", "k", "v2", at=20), op(5, "get", "k", None, found=False, at=20), op(6, "get", "k", "ghost", at=20), op(7, "put", "k", "v3", at=30, end=40), op(8, "get", "k", "v3", at=35, end=36), op(9, "get", "j", None, found=False, at=1), op(10, "put", "j", "lost", ok=False, at=2), op(11, "get", "j", "lost", at=5)]
    df = spark.createDataFrame(data, schema)
    assert {r.id for r in history.freshness_faults(df).collect()} == {3, 5, 6, 11}
    assert {r.id for r in history.fabrications(df).collect()} == {6}
    state = spark.createDataFrame([("k", "a", True, False, "x"), ("k", "b", True, False, "y"), ("l", "a", False, None, None), ("l", "b", False, None, None), ("m", "a", True, False, "x")], "key string, node string, found boolean, deleted boolean, val string")
    assert [r.key for r in history.divergences(state).collect()] == ["k"]


def test_log_replay_stops_at_the_first_bad_frame(spark, tmp_path):
    good = [wal.frame(wal.encode_record(i, 1 + (i == 3), b"k%d" % i, b"" if i == 3 else b"v")) for i in (1, 2, 3)]
    (tmp_path / "000001.wal").write_bytes(b"".join(good))
    (tmp_path / "000002.wal").write_bytes(good[0] + struct.pack("<II", 1000, 12345) + b"short" + good[1])
    (tmp_path / "000003.wal").write_bytes(good[0] + good[1][:-1] + b"\xff" + good[2])
    (tmp_path / "notes.txt").write_bytes(b"x")
    got = sorted((r.segment, r.seq, r.kind) for r in wal.read_segments(spark, str(tmp_path)).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (1, 3, 2), (2, 1, 1), (3, 1, 1)]
    assert list(wal.replay(b"")) == [] and wal.decode_record(wal.encode_record(300, 2, b"k", b"")) == (300, 2, b"k", b"")
    frames = spark.createDataFrame([(0, 0, 1, zlib.crc32(b"a"), bytearray(b"a")), (0, 1, 5, 1, bytearray(b"b")), (0, 2, 1, zlib.crc32(b"a"), bytearray(b"a"))], "segment int, pos int, len int, crc bigint, payload binary")
    assert [r.pos for r in wal.valid_frames(frames).collect()] == [0]


def stream_of(spark, path, pdf, schema):
    spark.createDataFrame(pdf, schema).write.parquet(str(path))
    return spark.readStream.schema(schema).parquet(str(path))


def result_of(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return sorted(rows(spark.table(name)))


def test_streams_equal_batches(spark, tmp_path):
    ts = pd.to_datetime(np.arange(20) * 700, unit="ms")
    events = pd.DataFrame({"ts": ts, "event_type": ["a", "b"] * 10})
    schema = "ts timestamp, event_type string"
    batch = sorted(rows(windows.snapshots(spark.createDataFrame(events, schema))))
    assert result_of(spark, windows.snapshots(stream_of(spark, tmp_path / "e", events, schema)), "snaps", "complete") == batch
    news = pd.DataFrame({"id": ["a", "b", "a"], "incarnation": [1, 2, 3], "severity": [2, 1, 0]})
    schema = "id string, incarnation bigint, severity int"
    assert result_of(spark, windows.merged_members(stream_of(spark, tmp_path / "m", news, schema)), "members", "complete") == [("a", 3, 0), ("b", 2, 1)]
    ticks = pd.DataFrame({"id": ["a", "a", "b", "b", "b"], "tick": [1, 6, 1, 2, 9], "severity": [1, 1, 1, 0, 0]})
    schema = "id string, tick bigint, severity int"
    assert result_of(spark, windows.suspicions(stream_of(spark, tmp_path / "t", ticks, schema), 4), "dead", "append") == [("a", 5)]


def test_snapshots_are_sent_until_the_client_goes(spark, tmp_path):
    import time

    from pyspark.errors import StreamingQueryException

    events = pd.DataFrame({"ts": pd.to_datetime([0, 1, 2], unit="s"), "event_type": ["a", "b", "a"]})
    frames = windows.snapshots(stream_of(spark, tmp_path / "s", events, "ts timestamp, event_type string"), "1 hour")
    sent = []

    def send(frame, number):
        if sent:
            raise ConnectionError("gone")
        sent.append(sorted((r.event_type, r.n) for r in frame.collect()))

    query = windows.write_snapshots(frames, send, "1 second")
    try:
        for _ in range(300):
            if sent:
                break
            time.sleep(0.1)
        assert sent == [[("a", 2), ("b", 1)]]
        spark.createDataFrame(events.assign(event_type="c"), "ts timestamp, event_type string").write.mode("append").parquet(str(tmp_path / "s"))
        with pytest.raises(StreamingQueryException):
            query.awaitTermination(30)
    finally:
        query.stop()
