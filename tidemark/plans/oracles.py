"""SQL that says the same as the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from .views import HISTORY, LOG, NEWEST, RUMOUR, VERSIONS, clock_text, fnv, mix

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


LIVE = f"WITH {LOG}, {NEWEST}"
oracle("q01_live_scan", f"{LIVE} SELECT key, seq, val FROM newest WHERE kind <> 2")
oracle("q02_multi_get", f"{LIVE} SELECT 'user:' || c_custkey AS key, n.key IS NOT NULL AS found, n.val FROM customer c LEFT JOIN (SELECT * FROM newest WHERE kind <> 2) n ON n.key = 'user:' || c_custkey")
oracle("q03_compact_full", f"{LIVE} SELECT key, seq, kind, val FROM newest WHERE kind <> 2")
oracle("q04_compact_partial", f"WITH {LOG} SELECT key, max(seq) AS seq, arg_max(kind, seq) AS kind, arg_max(val, seq) AS val FROM log WHERE run IN (0, 1) GROUP BY key")
oracle("q05_tier_precedence", f"""WITH {LOG} SELECT key, run AS tier, seq, kind = 1 AS found FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY run DESC, seq DESC) AS rn FROM log WHERE seq % 5 <> 0 OR run < 2) WHERE rn = 1""")
oracle("q06_stats", f"""{LIVE} SELECT count(*) AS keys,
    CAST(sum(octet_length(encode(key)) + CASE WHEN kind = 1 THEN octet_length(encode(val)) ELSE 0 END + 48) AS BIGINT) AS approx_bytes,
    CAST((SELECT max(seq) + 1 FROM log) AS BIGINT) AS next_seq, (SELECT count(DISTINCT run) FROM log) AS runs FROM newest""")
oracle("q07_rotation", f"""WITH RECURSIVE {LOG},
w AS (SELECT user_id % 16 AS engine, seq, key, CASE WHEN kind = 1 THEN octet_length(encode(val)) ELSE 0 END AS size,
             row_number() OVER (PARTITION BY user_id % 16 ORDER BY seq) AS i FROM log),
step AS (
    SELECT engine, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS segment, CAST(0 AS BIGINT) AS bytes, CAST(NULL AS BIGINT) AS first_seq,
           CAST(NULL AS BIGINT) AS last_seq, CAST([] AS VARCHAR[]) AS ks, CAST([] AS BIGINT[]) AS ss, false AS sealed FROM (SELECT DISTINCT engine FROM w)
    UNION ALL
    SELECT engine, i, segment, total, first_seq, seq, list_append(ks, key), list_append(ss, size), total >= 2000 FROM (
        SELECT s.engine, w.i, CASE WHEN s.sealed THEN s.segment + 1 ELSE s.segment END AS segment, w.seq, w.key, CAST(w.size AS BIGINT) AS size,
               CASE WHEN s.sealed OR s.first_seq IS NULL THEN w.seq ELSE s.first_seq END AS first_seq,
               CASE WHEN s.sealed THEN CAST([] AS VARCHAR[]) ELSE s.ks END AS ks, CASE WHEN s.sealed THEN CAST([] AS BIGINT[]) ELSE s.ss END AS ss,
               CASE WHEN s.sealed THEN 0 ELSE s.bytes END
               + CASE WHEN NOT s.sealed AND list_contains(s.ks, w.key)
                      THEN w.size - s.ss[len(s.ks) + 1 - list_position(list_reverse(s.ks), w.key)]
                      ELSE octet_length(encode(w.key)) + w.size + 48 END AS total
        FROM step s JOIN w ON w.engine = s.engine AND w.i = s.i + 1)
)
SELECT engine, segment, max(first_seq) AS first_seq, max(last_seq) AS last_seq, CAST(len(list_distinct(arg_max(ks, i))) AS BIGINT) AS keys,
       arg_max(bytes, i) AS bytes, NOT arg_max(sealed, i) AS open FROM step WHERE i > 0 GROUP BY engine, segment""")
oracle("q08_size_tier", """WITH RECURSIVE t AS (SELECT num % 10 AS engine, num, CAST(pow(sum(l_linenumber), 2) AS BIGINT) AS size FROM (SELECT l_suppkey AS num, l_linenumber FROM lineitem) GROUP BY num),
r AS (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY size, num) AS i FROM t),
step AS (
    SELECT engine, i, num, CAST(size AS HUGEINT) AS total, CAST(1 AS BIGINT) AS members, CAST(0 AS BIGINT) AS grp FROM r WHERE i = 1
    UNION ALL
    SELECT r.engine, r.i, r.num, CASE WHEN fits THEN total + r.size ELSE r.size END, CASE WHEN fits THEN members + 1 ELSE 1 END, CASE WHEN fits THEN grp ELSE grp + 1 END
    FROM (SELECT *, greatest(1, total // members) * 1.5 AS top FROM step) s JOIN (SELECT *, i - 1 AS prior FROM r) r ON r.engine = s.engine AND r.prior = s.i
    CROSS JOIN LATERAL (SELECT r.size <= s.top AS fits)
), picked AS (SELECT engine, min(grp) AS grp FROM (SELECT engine, grp FROM step GROUP BY engine, grp HAVING count(*) >= 3) GROUP BY engine)
SELECT engine, num FROM step JOIN picked USING (engine, grp)""")
oracle("q09_bloom_probe", f"""WITH k AS (
    SELECT 'p' AS side, 'c-' || (o_custkey * 2) AS key FROM orders GROUP BY ALL UNION ALL SELECT 's', 'c-' || c_custkey FROM customer),
h AS (SELECT side, key, {fnv("key")} AS h FROM k),
b AS (SELECT side, key, unnest(range(7)) AS i, h % 4294967296::UHUGEINT AS lo, greatest(h >> 32, 1::UHUGEINT) AS hi FROM h),
bits AS (SELECT side, key, ((lo + i::UHUGEINT * hi) % 4294967296::UHUGEINT) % 16384::UHUGEINT AS bit FROM b)
SELECT key, bool_and(bit IN (SELECT bit FROM bits WHERE side = 's')) AS may_contain FROM bits WHERE side = 'p' GROUP BY key""")
oracle("q10_sparse_index", """WITH RECURSIVE e AS (
    SELECT p_brand AS run, printf('%s:%08d', p_name, p_partkey) AS key, octet_length(encode(printf('%s:%08d', p_name, p_partkey))) AS k, octet_length(encode(p_type)) AS v, p_partkey AS seq FROM part),
r AS (SELECT run, key, CAST(k + v + 1 + CASE WHEN k < 128 THEN 1 ELSE 2 END + CASE WHEN v < 128 THEN 1 ELSE 2 END
             + CASE WHEN seq < 128 THEN 1 WHEN seq < 16384 THEN 2 WHEN seq < 2097152 THEN 3 ELSE 4 END AS BIGINT) AS bytes,
             row_number() OVER (PARTITION BY run ORDER BY key) AS i FROM e),
step AS (
    SELECT run, key, i, bytes AS total, CAST(0 AS BIGINT) AS block FROM r WHERE i = 1
    UNION ALL
    SELECT r.run, r.key, r.i, CASE WHEN s.total >= 1024 THEN r.bytes ELSE s.total + r.bytes END, CASE WHEN s.total >= 1024 THEN s.block + 1 ELSE s.block END
    FROM step s JOIN r ON r.run = s.run AND r.i = s.i + 1)
SELECT run, block, min(key) AS first_key, max(key) AS last_key, count(*) AS entries, max(total) AS bytes FROM step GROUP BY run, block""")

RING = f"""nodes AS (SELECT 'node' || n_nationkey AS node FROM nation),
tok_ AS (SELECT node, unnest(range(32)) AS i FROM nodes),
tok AS (SELECT node, i, {mix("f")} AS h FROM (SELECT node, i, {fnv("(node || '#' || i)")} AS f FROM tok_)),
keys_ AS (SELECT o_orderkey, 'order:' || o_orderkey AS key FROM orders),
keyh AS (SELECT o_orderkey, key, {mix("f")} AS h FROM (SELECT *, {fnv("key")} AS f FROM keys_))"""
WALK = """walk AS (SELECT a.h, a.node, b.node AS other, min(CASE WHEN b.h >= a.h THEN b.h - a.h ELSE b.h + 18446744073709551616::UHUGEINT - a.h END) AS d
    FROM tok a, tok b GROUP BY ALL),
pref AS (SELECT h, list(other ORDER BY d, other) AS nodes FROM walk GROUP BY h),
ranked AS (SELECT h, nodes, row_number() OVER (ORDER BY h) AS i FROM pref),
placed AS (SELECT k.o_orderkey, k.key, coalesce(r.nodes, (SELECT nodes FROM ranked WHERE i = 1)) AS nodes FROM keyh k ASOF LEFT JOIN ranked r ON k.h <= r.h)"""
oracle("q11_tokens", f"WITH {RING} SELECT node, i, CAST(h AS VARCHAR) AS hash FROM tok")
oracle("q12_owner", f"WITH {RING}, {WALK} SELECT key, nodes[1] AS node FROM placed")
oracle("q13_pref_list", f"WITH {RING}, {WALK} SELECT key, array_to_string(nodes[1:3], ',') AS nodes FROM placed")
oracle("q14_distribution", f"WITH {RING}, {WALK} SELECT nodes[1] AS node, count(*) AS n FROM placed GROUP BY 1")
oracle("q15_moves", f"WITH {RING}, {WALK} SELECT nodes[1] AS src, nodes[2] AS dst, count(*) AS n FROM placed WHERE nodes[1] = 'node7' GROUP BY 1, 2")
oracle("q16_placement", f"""WITH {RING}, {WALK} SELECT key, nodes[2] AS node, 'missing' AS fault FROM placed WHERE o_orderkey % 97 = 0
UNION ALL SELECT key, 'stray', 'extra' FROM placed WHERE o_orderkey % 97 = 0""")
oracle("q30_scope", f"WITH {RING}, {WALK} SELECT key FROM placed WHERE list_contains(nodes[1:3], 'node1') AND list_contains(nodes[1:3], 'node2')")

less, more = (" OR ".join(f"x.c{k} {op} y.c{k}" for k in range(3)) for op in "<>")
PAIRS = f"""{VERSIONS},
pair AS (SELECT x.key, x.node AS a, y.node AS b, CASE WHEN ({less}) AND ({more}) THEN 3 WHEN {less} THEN 1 WHEN {more} THEN 2 ELSE 0 END AS relation,
    {', '.join(f'greatest(x.c{k}, y.c{k}) AS m{k}, x.c{k} AS xc{k}, y.c{k} AS yc{k}' for k in range(3))},
    x.val AS xval, y.val AS yval, x.ts AS xts, y.ts AS yts, x.deleted AS xd, y.deleted AS yd
    FROM version x JOIN version y ON x.key = y.key AND x.node < y.node)"""
oracle("q17_clock_compare", f"WITH {PAIRS} SELECT key, a, b, relation FROM pair")
oracle("q18_clock_merge", f"WITH {PAIRS} SELECT key, a, b, {clock_text('m')} AS merged, {clock_text('m').replace('m0 > 0', 'true').replace('|| m0', '|| (m0 + 1)')} AS next FROM pair")
FIRST = "(relation IN (0, 2) OR (relation = 3 AND (xts, xval, NOT xd) >= (yts, yval, NOT yd)))"
oracle("q19_reconcile_pair", f"""WITH {PAIRS} SELECT key, a, b, CASE WHEN {FIRST} THEN xval ELSE yval END AS val, CASE WHEN {FIRST} THEN xts ELSE yts END AS ts,
    CASE WHEN {FIRST} THEN xd ELSE yd END AS deleted,
    CASE WHEN relation = 3 THEN {clock_text('m')} WHEN {FIRST} THEN {clock_text('xc')} ELSE {clock_text('yc')} END AS clock FROM pair""")


def folded(source: str, keys: str) -> str:
    """The canonical fold of ``source``: CTE ``won`` with keys, val, ts, deleted and counters m0 to m2."""
    same = " AND ".join(f"o.{k.strip()} = v.{k.strip()}" for k in keys.split(","))
    dominated = " AND ".join(f"v.c{k} <= o.c{k}" for k in range(3))
    strictly = " OR ".join(f"v.c{k} < o.c{k}" for k in range(3))
    return f"""top AS (SELECT {keys}, max((ts, coalesce(val, ''), NOT deleted)) AS t FROM {source} v
        WHERE NOT EXISTS (SELECT 1 FROM {source} o WHERE {same} AND {dominated} AND ({strictly})) GROUP BY {keys}),
    joint AS (SELECT {keys}, max(c0) AS m0, max(c1) AS m1, max(c2) AS m2 FROM {source} GROUP BY {keys}),
    won AS (SELECT {', '.join('top.' + k.strip() for k in keys.split(','))}, t[1] AS ts, t[2] AS val, NOT t[3] AS deleted, m0, m1, m2 FROM top JOIN joint USING ({keys}))"""


REPLIES = f"""{VERSIONS},
reply AS (SELECT *, (ts + CAST(node[2] AS INT)) % 5 <> 0 AS ok, ts % 9 <> 0 AS found FROM version),
good AS (SELECT * FROM reply WHERE ok AND found), {folded("good", "key")}"""
oracle("q20_quorum_read", f"""WITH {REPLIES}, heard AS (SELECT key, count(*) FILTER (ok) AS answers FROM reply GROUP BY key),
out AS (SELECT h.key, CASE WHEN answers < 2 THEN 'error' WHEN w.ts IS NULL OR w.deleted THEN 'not_found' ELSE 'ok' END AS outcome, val, ts, m0, m1, m2 FROM heard h LEFT JOIN won w USING (key))
SELECT key, outcome, CASE WHEN outcome = 'ok' THEN val END AS val, CASE WHEN outcome = 'ok' THEN {clock_text('m')} END AS clock, CASE WHEN outcome = 'ok' THEN ts END AS ts FROM out""")
TRIED = """tried AS (SELECT event_id, user_id, place, (user_id + place) % 7 AS node, place < 3 AS preferred,
    (user_id + (user_id + place) % 7) % 6 <> 0 AND (event_id * 7 + ((user_id + place) % 7) * 13) % 100 <= 60 AS ok
    FROM events, (SELECT unnest(range(5)) AS place) WHERE event_type IN ('purchase', 'signup'))"""
oracle("q21_write_outcome", f"""WITH {TRIED}, c AS (SELECT event_id, count(*) FILTER (preferred AND ok) AS direct, least(count(*) FILTER (preferred AND NOT ok), count(*) FILTER (NOT preferred AND ok)) AS hints FROM tried GROUP BY event_id)
SELECT event_id, direct + hints AS acks, hints, CASE WHEN direct + hints >= 2 THEN 'ok' ELSE 'error' END AS outcome FROM c""")
oracle("q22_read_repair", f"""WITH {REPLIES} SELECT r.key, r.node FROM reply r JOIN won w USING (key)
WHERE r.ok AND (NOT r.found OR (r.c0 <= m0 AND r.c1 <= m1 AND r.c2 <= m2 AND (r.c0 < m0 OR r.c1 < m1 OR r.c2 < m2)))""")
oracle("q23_hint_plan", f"""WITH {TRIED}, f AS (SELECT event_id, node, row_number() OVER (PARTITION BY event_id ORDER BY place) AS n FROM tried WHERE preferred AND NOT ok),
u AS (SELECT event_id, node, row_number() OVER (PARTITION BY event_id ORDER BY place) AS n FROM tried WHERE NOT preferred AND ok)
SELECT f.event_id, CAST(f.node AS INT) AS intended, CAST(u.node AS INT) AS holder FROM f JOIN u USING (event_id, n)""")
HINTS = f"""{VERSIONS}, hint AS (SELECT 'h' || (ts % 2) AS holder, 't' || (length(key) % 2) AS intended, * FROM version), {folded("hint", "holder, intended, key")}"""
oracle("q24_hint_pending", f"WITH {HINTS} SELECT holder, intended, key, val, ts, deleted, {clock_text('m')} AS clock FROM won")
oracle("q25_hint_deliver", f"WITH {HINTS} SELECT holder, intended, CASE WHEN intended = 't1' THEN 'delivered' ELSE 'kept' END AS state, count(*) AS n FROM won GROUP BY ALL")
#: A version's stored form: JSON, without what is empty.
STORED = f"""'{{' || CASE WHEN val <> '' THEN '"v":"' || base64(encode(val)) || '",' ELSE '' END
    || CASE WHEN c0 + c1 + c2 > 0 THEN '"c":{{' || concat_ws(',', {', '.join(f"""CASE WHEN c{k} > 0 THEN '"n{k}":' || c{k} END""" for k in range(3))}) || '}},' ELSE '' END
    || '"t":' || ts || CASE WHEN deleted THEN ',"d":true' ELSE '' END || '}}'"""
MERKLE = f"""{VERSIONS},
hashed AS (SELECT *, CAST({mix("f")} % 256::UHUGEINT AS BIGINT) AS bucket FROM (SELECT *, {fnv("key")} AS f FROM version)),
leaf_ AS (SELECT node, bucket, sha256(unhex(string_agg(printf('%08X', octet_length(encode(key))) || hex(key) || upper(sha256({STORED})), '' ORDER BY key))) AS h FROM hashed GROUP BY node, bucket),
leaf AS (SELECT n.node, g.bucket, coalesce(h, sha256('')) AS h FROM (SELECT DISTINCT node FROM version) n CROSS JOIN (SELECT unnest(range(256)) AS bucket) g LEFT JOIN leaf_ l ON l.node = n.node AND l.bucket = g.bucket),
diff AS (SELECT x.node AS a, y.node AS b, bucket FROM leaf x JOIN leaf y USING (bucket) WHERE x.node < y.node AND x.h <> y.h)"""
levels, last = [], "leaf"
for k in range(8):
    levels.append(f"l{k} AS (SELECT node, bucket // 2 AS bucket, sha256(unhex(string_agg(h, '' ORDER BY bucket))) AS h FROM {last} GROUP BY node, bucket // 2)")
    last = f"l{k}"
oracle("q26_merkle", f"WITH {MERKLE}, {', '.join(levels)} SELECT node, h AS root FROM {last}")
oracle("q27_merkle_diff", f"WITH {MERKLE} SELECT a, b, bucket FROM diff")
oracle("q28_bucket_entries", f"WITH {MERKLE} SELECT node, bucket, key, ts FROM hashed WHERE bucket < 64")
oracle("q29_repair_plan", f"WITH {MERKLE} SELECT a, b, node AS src, count(*) AS pushes FROM diff JOIN hashed USING (bucket) WHERE node IN (a, b) GROUP BY ALL")

NEWS = f"{RUMOUR}, best AS (SELECT id, max((incarnation, severity, tick)) AS r FROM rumour GROUP BY id), member AS (SELECT id, r[1] AS incarnation, r[2] AS severity, r[3] AS since, r[3] % 4 AS left_ FROM best)"
oracle("q31_member_merge", f"WITH {NEWS} SELECT id, incarnation, severity FROM member")
oracle("q32_refute", f"""WITH {NEWS}, worst AS (SELECT max(incarnation) AS w FROM rumour WHERE id = 'm3' AND severity <> 0)
SELECT id, CASE WHEN id = 'm3' THEN CASE WHEN w >= 2 THEN w + 1 ELSE 2 END ELSE incarnation END AS incarnation, CASE WHEN id = 'm3' THEN 0 ELSE severity END AS severity FROM member, worst""")
oracle("q33_suspicion", f"WITH {NEWS} SELECT id, incarnation, CASE WHEN severity = 1 AND (SELECT max(event_id) FROM events) - since >= 50 THEN 2 ELSE severity END AS severity FROM member")
oracle("q34_gossip", f"""WITH {NEWS} SELECT id, incarnation, severity FROM (SELECT * FROM member WHERE left_ > 0 ORDER BY left_ DESC, id LIMIT 6)
UNION ALL SELECT id, incarnation, severity FROM member WHERE id = 'm3' UNION ALL SELECT id, incarnation, severity FROM member WHERE id = 'm5' AND severity <> 0""")
oracle("q35_fabrication", f"WITH {HISTORY} SELECT id, key, value FROM history g WHERE kind = 'get' AND ok AND found AND NOT EXISTS (SELECT 1 FROM history p WHERE p.kind = 'put' AND p.key = g.key AND p.value = g.value)")
oracle("q36_freshness", f"""WITH {HISTORY}, put AS (SELECT key, value, start_seq AS s, end_seq AS e, row_number() OVER (PARTITION BY key ORDER BY start_seq, id) AS n FROM history WHERE kind = 'put' AND ok),
bound AS (SELECT g.id, g.key, g.value, g.found, coalesce(max(n) FILTER (e < g.start_seq), 0) AS done, coalesce(max(n) FILTER (s < g.end_seq), 0) AS seen
    FROM history g LEFT JOIN put ON put.key = g.key WHERE g.kind = 'get' AND g.ok GROUP BY ALL)
SELECT b.id, b.key, b.value, p.value AS expected FROM bound b LEFT JOIN put p ON p.key = b.key AND p.n = b.done
WHERE CASE WHEN b.found THEN NOT EXISTS (SELECT 1 FROM put q WHERE q.key = b.key AND q.value = b.value AND q.n BETWEEN greatest(b.done, 1) AND b.seen) ELSE b.done > 0 END""")
oracle("q37_convergence", f"WITH {VERSIONS} SELECT key, count(*) AS replicas, count(DISTINCT (deleted, CASE WHEN NOT deleted THEN val END)) AS states FROM version GROUP BY key HAVING count(*) > 1 AND count(DISTINCT (deleted, CASE WHEN NOT deleted THEN val END)) > 1")
oracle("q38_workload", "SELECT 'k' || s_suppkey AS key, 'k' || s_suppkey || '#' || i AS value, CAST((i - 1) % 3 AS INT) AS via FROM supplier, (SELECT unnest(range(1, 21)) AS i)")
oracle("q39_histogram", "SELECT event_type, b.le, count(*) FILTER (value <= b.v) AS n, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS sum, count(value) AS count FROM events, (VALUES ('1', 1.0), ('5', 5.0), ('10', 10.0), ('25', 25.0), ('50', 50.0), ('100', 100.0), ('+Inf', 'Infinity'::DOUBLE)) b(le, v) GROUP BY ALL")
REQUESTS = """request AS (SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 'put' WHEN event_type = 'error' THEN 'delete' ELSE 'get' END AS op,
    CASE WHEN event_id % 19 = 0 THEN 'error' WHEN event_id % 5 = 0 AND event_type IN ('view', 'click') THEN 'not_found' ELSE 'ok' END AS result FROM events),
counter AS (SELECT op, result, count(*) AS n FROM request GROUP BY ALL),
latency AS (SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 'put' WHEN event_type = 'error' THEN 'delete' ELSE 'get' END AS op, event_id % 97 AS ms FROM events)"""
oracle("q40_counters", f"WITH {REQUESTS} SELECT * FROM counter")
oracle("q41_gauges", f"WITH {NEWS} SELECT s.state, count(m.id) AS n FROM (VALUES ('alive', 0), ('suspect', 1), ('dead', 2)) s(state, k) LEFT JOIN member m ON m.severity = s.k GROUP BY s.state")
oracle("q42_exposition", f"""WITH {REQUESTS} SELECT CAST(0 AS INT) AS line_no, '# HELP requests_total Requests by operation and result.' AS line UNION ALL SELECT 1, '# TYPE requests_total counter'
UNION ALL SELECT CAST(1 + row_number() OVER (ORDER BY op, result) AS INT), 'requests_total{{op="' || op || '",result="' || result || '"}} ' || n FROM counter
UNION ALL SELECT CAST((SELECT count(*) FROM counter) + 1 + row_number() OVER (ORDER BY g, op, k) AS INT), line FROM (
    SELECT 0 AS g, '' AS op, 0 AS k, '# HELP request_ms Latency by operation.' AS line UNION ALL SELECT 0, '', 1, '# TYPE request_ms histogram'
    UNION ALL SELECT 1, op, k, 'request_ms_bucket{{op="' || op || '",le="' || le || '"}} ' || count(*) FILTER (ms <= v) FROM latency, (VALUES (0, '1', 1.0), (1, '5', 5.0), (2, '10', 10.0), (3, '25', 25.0), (4, '50', 50.0), (5, '100', 100.0), (6, '+Inf', 'Infinity'::DOUBLE)) b(k, le, v) GROUP BY op, k, le, v
    UNION ALL SELECT 1, op, 7, 'request_ms_sum{{op="' || op || '"}} ' || CAST(sum(ms) AS BIGINT) FROM latency GROUP BY op
    UNION ALL SELECT 1, op, 8, 'request_ms_count{{op="' || op || '"}} ' || count(*) FROM latency GROUP BY op)""")
oracle("q43_parse_samples", "SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'plain' ELSE 'req' END AS name, CASE event_id % 6 WHEN 1 THEN CAST(event_id AS DOUBLE) ELSE event_id + 0.5::DOUBLE END AS value FROM events WHERE event_id % 6 NOT IN (0, 2)")
oracle("q44_parse_labels", "SELECT event_id, CASE event_id % 6 WHEN 1 THEN '' ELSE 'type=' || event_type || ',x,user=' || user_id END AS labels FROM events WHERE event_id % 6 NOT IN (0, 2)")
oracle("q45_aggregate", """SELECT n_nationkey, 'node' || n_nationkey AS node, c IS NOT NULL AND s_nationkey % 5 <> 0 AS ok,
    CASE WHEN c IS NULL THEN 'no answer' WHEN s_nationkey % 5 = 0 THEN 'node returned status 500' END AS error, CASE WHEN s_nationkey % 5 <> 0 THEN '{"suppliers":' || c || '}' END AS data
FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS c FROM supplier WHERE s_nationkey % 6 <> 0 GROUP BY 1) ON s_nationkey = n_nationkey""")
oracle("q46_failover", """WITH t AS (SELECT event_id, place, (event_id * 3 + place * 7) % 11 % 5 AS code FROM events, (SELECT unnest(range(3)) AS place))
SELECT event_id, CAST(min(place) FILTER (code = 0) AS INT) AS served_by, CASE WHEN min(place) FILTER (code = 0) IS NOT NULL THEN 200 ELSE CASE arg_max(code, place) WHEN 1 THEN 503 WHEN 2 THEN 504 WHEN 3 THEN 400 ELSE 502 END END AS status FROM t GROUP BY event_id""")
oracle("q47_value_json", """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '/w==' ELSE base64(encode(props)) END AS value_base64, CASE WHEN event_id % 11 <> 0 THEN props END AS value,
    CASE WHEN event_id % 5 IN (3, 4) THEN props END AS decoded,
    CASE event_id % 5 WHEN 0 THEN 'provide exactly one of value or value_base64' WHEN 1 THEN 'provide value or value_base64' WHEN 2 THEN 'value_base64 is not valid base64' END AS error FROM events""")
oracle("q48_snapshot", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01')) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
oracle("q49_wal_replay", """WITH f AS (SELECT event_id % 16 AS segment, event_id AS pos, event_id % 401 = 400 OR event_id % 577 = 576 AS bad FROM events),
b AS (SELECT segment, min(pos) FILTER (bad) AS first FROM f GROUP BY segment)
SELECT segment, count(*) AS frames, max(pos) AS last_pos FROM f JOIN b USING (segment) WHERE first IS NULL OR pos < first GROUP BY segment""")
oracle("q50_recovery", f"""WITH {LOG}, s AS (SELECT *, seq // 1000 AS segment FROM log), top AS (SELECT max(segment) AS top FROM s WHERE segment > 3),
tiers AS (SELECT s.*, CAST(CASE WHEN segment <= 3 THEN 0 WHEN segment = top THEN 2 ELSE 1 END AS INT) AS tier FROM s LEFT JOIN top ON true)
SELECT key, tier, seq, kind, CAST(greatest(4000, (SELECT max(seq) FROM s WHERE segment > 3)) + 1 AS BIGINT) AS next_seq
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier DESC, seq DESC) AS rn FROM tiers) WHERE rn = 1""")
oracle("q51_config", """SELECT s_suppkey, 'a' || s_suppkey AS id, '10.0.0.1:' || s_suppkey AS grpc, '10.0.0.2:9' AS admin FROM supplier
UNION ALL SELECT s_suppkey, 'c', 'h:1', 'h:2' FROM supplier WHERE s_suppkey % 2 = 0""")
oracle("q52_validate", """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'empty key' WHEN length('doc:' || doc_id) > 7 THEN 'key too large'
    WHEN doc_id % 7 <> 0 AND octet_length(encode(coalesce(text, ''))) > 2000 THEN 'value too large' ELSE 'ok' END AS result FROM documents""")
oracle("q53_reachability", "SELECT x.n_nationkey AS a, y.n_nationkey AS b, x.n_nationkey = y.n_nationkey OR (x.n_regionkey = 2) = (y.n_regionkey = 2) AS reachable FROM nation x, nation y")
oracle("q54_upsert", f"""WITH {VERSIONS}, cur AS (SELECT * FROM version WHERE node = 'n0' AND ts % 5 <> 0), inc AS (SELECT * FROM version WHERE node = 'n1' AND ts % 7 <> 0),
pair AS (SELECT coalesce(x.key, y.key) AS key, x.key IS NULL AS nox, y.key IS NULL AS noy,
    CASE WHEN ({less}) AND ({more}) THEN 3 WHEN {less} THEN 1 WHEN {more} THEN 2 ELSE 0 END AS relation,
    {', '.join(f'greatest(x.c{k}, y.c{k}) AS m{k}, x.c{k} AS xc{k}, y.c{k} AS yc{k}' for k in range(3))},
    x.val AS xval, y.val AS yval, x.ts AS xts, y.ts AS yts, x.deleted AS xd, y.deleted AS yd FROM inc x FULL JOIN cur y ON x.key = y.key),
chosen AS (SELECT *, noy OR (NOT nox AND {FIRST}) AS first FROM pair)
SELECT key, CASE WHEN first THEN xval ELSE yval END AS val, CASE WHEN first THEN xts ELSE yts END AS ts, CASE WHEN first THEN xd ELSE yd END AS deleted,
    CASE WHEN NOT nox AND NOT noy AND relation = 3 THEN {clock_text('m')} WHEN first THEN {clock_text('xc')} ELSE {clock_text('yc')} END AS clock FROM chosen""")
oracle("q55_gauge_values", """WITH g AS (SELECT user_id, event_type, event_id % 50 AS v, event_id, max(event_id) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS last FROM events)
SELECT user_id, CAST(sum(CASE WHEN event_id = last THEN v WHEN last IS NOT NULL AND event_id < last THEN 0 WHEN event_type IN ('purchase', 'signup') THEN v ELSE -v END) AS BIGINT) AS value FROM g GROUP BY user_id""")
oracle("q56_replica_scan", f"WITH {VERSIONS} SELECT key, val, {clock_text()} AS clock, ts, deleted FROM version WHERE node = 'n1' AND NOT key LIKE '%3'")
oracle("q57_replica_read", f"""WITH {VERSIONS} SELECT 'user:' || c_custkey AS key, v.key IS NOT NULL AS found, val, CASE WHEN v.key IS NOT NULL THEN {clock_text()} END AS clock, ts, deleted
FROM customer LEFT JOIN (SELECT * FROM version WHERE node = 'n1') v ON v.key = 'user:' || c_custkey""")
oracle("q58_write", f"""WITH {LOG}, w AS (SELECT -doc_id AS place, CASE WHEN doc_id % 10 = 0 THEN '' ELSE 'doc:' || doc_id END AS key, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS kind, CASE WHEN doc_id % 7 <> 0 THEN source END AS val FROM documents),
c AS (SELECT *, CASE WHEN key = '' THEN 'empty key' WHEN length(key) > 7 THEN 'key too large' ELSE 'ok' END AS result FROM w)
SELECT seq, key, kind, val, 'ok' AS result FROM log
UNION ALL SELECT (SELECT max(seq) FROM log) + row_number() OVER (ORDER BY place), key, kind, val, result FROM c WHERE result = 'ok'
UNION ALL SELECT NULL, key, kind, val, result FROM c WHERE result <> 'ok'""")
oracle("q59_flush", f"""WITH {LOG}, s AS (SELECT *, seq // 1000 AS segment FROM log) SELECT segment AS run, key, seq, kind, val
FROM (SELECT *, row_number() OVER (PARTITION BY segment, key ORDER BY seq DESC) AS rn FROM s WHERE segment % 3 <> 1) WHERE rn = 1""")
REPAIRED = f"""{VERSIONS}, two AS (SELECT key, val, ts, deleted, c0, c1, c2 FROM version WHERE node IN ('n0', 'n1')), {folded("two", "key").replace("top AS", "top_ AS").replace("joint AS", "joint_ AS").replace("won AS", "won_ AS").replace("FROM top JOIN joint", "FROM top_ JOIN joint_").replace("'top.'", "'top_.'").replace("top.key", "top_.key")},
three AS (SELECT key, val, ts, deleted, m0 AS c0, m1 AS c1, m2 AS c2 FROM won_ UNION ALL SELECT key, val, ts, deleted, c0, c1, c2 FROM version WHERE node = 'n2'), {folded("three", "key")}"""
oracle("q60_repair", f"WITH {REPAIRED} SELECT key, 'n' || i AS node, val, ts, deleted, {clock_text('m')} AS clock FROM won, (SELECT unnest(range(3)) AS i)")
oracle("q61_repair_again", "SELECT a, b, CAST(0 AS BIGINT) AS pushes FROM (VALUES ('n0', 'n1'), ('n1', 'n2')) p(a, b)")
oracle("q62_new_versions", f"""WITH {VERSIONS}, heard AS (SELECT key, max(c0) AS c0, max(c1) AS c1, max(c2) AS c2 FROM version WHERE (ts + CAST(node[2] AS INT)) % 5 <> 0 GROUP BY key),
w AS (SELECT 'user:' || c_custkey AS key, {', '.join(f"coalesce(c{k}, 0) + CASE WHEN c_custkey % 3 = {k} THEN 1 ELSE 0 END AS m{k}" for k in range(3))}, c_name, c_custkey FROM customer LEFT JOIN heard ON heard.key = 'user:' || c_custkey)
SELECT key, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS val, c_custkey AS ts, c_custkey % 5 = 0 AS deleted, {clock_text('m')} AS clock FROM w""")
oracle("q63_faults", """WITH c AS (SELECT event_id AS id, user_id % 5 AS s, event_id % 7 AS d FROM events)
SELECT id, CASE WHEN d = 6 THEN 'skipped' WHEN s = d THEN 'ok' WHEN (s < 2) <> (d < 2) THEN 'unavailable' WHEN d = 3 THEN 'timeout' ELSE 'ok' END AS result FROM c""")
oracle("q64_suspect", f"""WITH {NEWS}, s AS (SELECT *, id IN ('m1', 'm2', 'm4') AND severity = 0 AS now FROM member)
SELECT id, incarnation, CAST(CASE WHEN now THEN 1 ELSE severity END AS INT) AS severity, CASE WHEN now THEN 77 ELSE since END AS since, CASE WHEN now THEN 3 ELSE left_ END AS "left" FROM s""")
oracle("q65_gossip_round", f"""WITH {NEWS}, one AS (SELECT id, left_ - CASE WHEN left_ > 0 AND row_number() OVER (ORDER BY CASE WHEN left_ > 0 THEN 0 ELSE 1 END, left_ DESC, id) <= 6 THEN 1 ELSE 0 END AS l FROM member)
SELECT id, l - CASE WHEN l > 0 AND row_number() OVER (ORDER BY CASE WHEN l > 0 THEN 0 ELSE 1 END, l DESC, id) <= 6 THEN 1 ELSE 0 END AS "left" FROM one""")
oracle("q66_log_files", f"WITH {LOG} SELECT seq // 1000 AS segment, seq, CAST(kind AS INT) AS kind, key, val FROM log")
oracle("q67_table_files", f"WITH {LOG} SELECT run, seq, CAST(kind AS INT) AS kind, key, val FROM (SELECT *, row_number() OVER (PARTITION BY run, key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1")
oracle("q68_cache_hits", """WITH r AS (SELECT user_id % 4 AS engine, event_id AS at, user_id AS block, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT r.engine, r.at, r.before IS NOT NULL AND (SELECT count(DISTINCT o.block) FROM r o WHERE o.engine = r.engine AND o.at > r.before AND o.at < r.at) < 5 AS hit FROM r""")
oracle("q69_table_sets", """WITH t AS (SELECT s_suppkey % 10 AS engine, s_suppkey AS num, s_suppkey % 3 <> 0 OR s_suppkey % 10 < 4 AS picked FROM supplier), e AS (SELECT engine, bool_and(picked) AS every FROM t GROUP BY engine HAVING bool_or(picked))
SELECT t.engine, num, every FROM t LEFT JOIN e ON e.engine = t.engine WHERE NOT picked UNION ALL SELECT engine, NULL, every FROM e""")
tree = " UNION ALL ".join(f"SELECT node, {9 - k} AS level, bucket, h FROM {'leaf' if k == 0 else f'l{k - 1}'}" for k in range(9))
oracle("q70_merkle_bytes", f"""WITH {MERKLE}, {', '.join(levels)}, tree AS ({tree})
SELECT node, CAST(32 + 32 * count(*) AS INT) AS n, sha256(unhex(repeat('0', 64) || string_agg(h, '' ORDER BY level, bucket))) AS digest, CAST(256 AS BIGINT) AS leaves FROM tree GROUP BY node""")
oracle("q71_key_json", f"""WITH {RING}, {WALK} SELECT key, '{{"key":"' || key || '","n":3,"preference_list":["' || array_to_string(nodes[1:3], '","') || '"]}}' AS json FROM placed""")
oracle("q72_members_json", f"""WITH {NEWS} SELECT '{{"members":[' || string_agg('{{"id":"' || id || '","state":"' || ['alive', 'suspect', 'dead'][severity + 1] || '","incarnation":' || incarnation || '}}', ',' ORDER BY id) || ']}}' AS json FROM member""")
oracle("q73_result_class", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'error' WHEN event_type IN ('view', 'click') AND event_id % 4 = 0 THEN 'not_found' ELSE 'ok' END AS result FROM events")
oracle("q74_known_members", f"""WITH {NEWS} SELECT id, incarnation, severity FROM member WHERE (id IN ('m5', 'm6') AND severity <> 0) OR id = 'm7'
UNION ALL SELECT 'alive', count(*) FILTER (severity = 0), NULL FROM member""")
