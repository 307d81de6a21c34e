"""Near-duplicate documents by ProbMinHash on word shingles, banding, and verification.

A document is the set of its shingles of five words (lower case), however often each occurs: verification is by plain
Jaccard similarity, so signatures estimate the same. Every shingle is a Poisson process whose rate is its weight (one):
its arrivals, drawn from its own hash, each hit one slot of the signature, and a slot keeps the shingle that arrives
first. A shingle stops as soon as its next arrival is later than every slot's, so most draw once or twice. Two signatures
agree in a slot with the probability Jaccard similarity of the weighted sets, which for weights of one is the plain one.

Texts that are equal word by word are one node, whatever ids their rows have. Bands of a signature put nodes into
buckets. A first pass finds most components at little cost: buckets are range-sorted by slots outside the band, each
node is compared by signature with its neighbours there, and of all buckets only its best partner with a smaller number
is verified by the Jaccard similarity of the shingles. So a node brings one link, and a group of near copies as many
links as nodes. The second pass is whole: in every bucket that still holds more than one component, all pairs of
different components are compared, block by block, and those near the threshold are verified in the same place, so that
no list of pairs is ever shuffled. Classes are the components of verified links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, map_arrow, release, salted_lookup, slices, staged

WORDS, THRESHOLD = 5, 0.8
#: Slots of a signature, of one byte; the first BANDS * ROWS are the bands. Slots that sort a bucket; nodes before it in
#: its bucket that a node is compared with by the first pass. What lies outside is left to the second pass.
SLOTS, BANDS, ROWS, TAIL, BEFORE = 240, 24, 5, 8, 64
#: Of the second pass: nodes of a block of a large bucket (on average), and nodes that meet the others at once.
BLOCK, TILE = 2048, 64
#: Pairs whose estimate is this much below the threshold are not verified: 4.6 standard errors, which at the threshold is
#: 1 pair in 140,000. The first pass only prepares the second, and verifies estimates of a narrower margin.
MARGIN, FIRST_MARGIN = 0.12, 0.065
ROWS_SCHEMA = "doc_id bigint, mark bigint, content binary, signature binary"
SETS_SCHEMA = "node bigint, shingles binary"
_MIX, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of texts: each distinct shingle's text and 48-bit hash, how often it occurs there, and the texts' contents
    (their words, joined by spaces). A text of fewer than five words has one shingle of them all, without words none."""
    contents = [" ".join(x.lower().split()).encode("utf-8", "surrogatepass") for x in texts]
    data = np.frombuffer(b" ".join(contents) + b" ", np.uint8)
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]] if len(sizes) else np.zeros(0, np.int64)
    ends = np.flatnonzero(data == 32)
    begins = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    real = ends > begins
    ends, begins = ends[real], begins[real]
    # Hashes of words from differences of a running polynomial, which is made independent of the place.
    power = np.cumprod(np.full(len(data), _BASE, np.uint64)) if len(data) else np.zeros(0, np.uint64)
    back = np.cumprod(np.full(len(data), _INVERSE, np.uint64)) if len(data) else power
    running = np.r_[np.uint64(0), np.cumsum(_BYTES[data] * power, dtype=np.uint64)]
    word = mix((running[ends] - running[begins]) * back[begins]) if len(ends) else np.zeros(0, np.uint64)
    owner = np.searchsorted(starts, begins, "right") - 1
    number = np.bincount(owner, minlength=len(texts))
    h = word.copy()
    for k in range(1, WORDS):
        nxt = np.r_[word[k:], np.zeros(min(k, len(word)), np.uint64)][: len(word)]
        same = np.r_[owner[k:] == owner[: len(owner) - k], np.zeros(min(k, len(owner)), bool)][: len(word)]
        h = np.where(same, mix(h * _STEP + nxt), h)
    first = np.cumsum(number) - number
    place = np.arange(len(word)) - first[owner] if len(word) else np.zeros(0, np.int64)
    whole = (place + WORDS <= number[owner]) | (place == 0) if len(word) else np.zeros(0, bool)
    key = np.sort((owner[whole].astype(np.uint64) << np.uint64(48)) | (h[whole] >> np.uint64(16)))
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[new, len(key)])
    key = key[new]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), count, contents


def slot_bytes(name: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """The byte that stands for a shingle in a slot; chance agreements of two shingles are independent between slots."""
    return (mix(name + slot.astype(np.uint64) * _STEP) >> np.uint64(56)).astype(np.uint8)


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """ProbMinHash signatures of ``n`` texts from their weighted shingles, sorted by text; slots hold a byte of a hash.

    A shingle's rate is one plus the logarithm of its weight, so weights of one make the plain set."""
    weight = 1 + np.log(weight)
    earliest = np.full(n * SLOTS, np.inf)
    holder = np.zeros(n * SLOTS, np.uint8)
    name = mix(shingle * _STEP)
    seed = mix(shingle ^ np.uint64(0x5851F42D4C957F2D))
    time = np.zeros(len(text))
    alone = np.bincount(text, minlength=n) == 1
    single = alone[text]
    every = np.arange(SLOTS)
    holder.reshape(n, SLOTS)[text[single]] = slot_bytes(name[single][:, None], every[None, :])
    active, turn = np.flatnonzero(~single), 0
    while len(active):
        turn += 1
        draw = mix(seed[active] + np.uint64(turn * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        time[active] -= np.log(((draw >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / weight[active]
        slot = text[active] * SLOTS + (mix(draw ^ _BASE) % np.uint64(SLOTS)).astype(np.int64)
        now = time[active]
        np.minimum.at(earliest, slot, now)
        won = earliest[slot] == now
        holder[slot[won]] = slot_bytes(name[active[won]], slot[won] % SLOTS)
        # A shingle goes on while its text has a slot that is empty or was hit later than its last arrival.
        docs = np.unique(text[active])
        latest = np.zeros(n)
        latest[docs] = earliest.reshape(n, SLOTS)[docs].max(1)
        active = active[now < latest[text[active]]]
    return holder.reshape(n, SLOTS)


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets of shingles, each as its sorted 40-bit hashes."""
    x, y = members(a), members(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def members(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 5)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :5] = raw
    return np.unique(wide.view("<u8").ravel())


def digest(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16).digest()


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that temporary arrays stay small and numbers of texts fit their part of a key."""
    for batch in batches:
        for part in slices(batch, limit=1_000_000):
            for at in range(0, part.num_rows, 60_000):
                yield part.slice(at, 60_000)


def document_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, content, signature`` of rows (doc_id, mark, text) with an id and a word."""
    schema = arrow_schema(ROWS_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in parts(batches):
            text, shingle, count, contents = shingles([x or "" for x in piece.column("text").to_pylist()])
            signed = signatures(text, shingle, np.ones_like(count), len(contents))
            has = [i for i, c in enumerate(contents) if c]
            at = pa.array(has, pa.int64())
            yield batch_of(schema, [piece.column("doc_id").take(at), piece.column("mark").take(at), [digest(contents[i]) for i in has], [signed[i].tobytes() for i in has]])

    return map_arrow(docs.where(F.col("doc_id").isNotNull()), run, ROWS_SCHEMA)


def shingle_sets(texts: DataFrame) -> DataFrame:
    """``node, shingles`` of rows (node, content, text) whose text has that content: 40-bit hashes, of which two of a text
    seldom agree, in order."""
    schema = arrow_schema(SETS_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in parts(batches):
            text, shingle, _, contents = shingles([x or "" for x in piece.column("text").to_pylist()])
            edges = np.searchsorted(text, np.arange(len(contents) + 1)).tolist()
            raw = (shingle >> np.uint64(8)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
            # Rows of an id that comes with several texts also meet the nodes of its other texts.
            own = [i for i, (c, want) in enumerate(zip(contents, piece.column("content").to_pylist(), strict=True)) if digest(c) == want]
            yield batch_of(schema, [piece.column("node").take(pa.array(own, pa.int64())), [raw[5 * edges[i] : 5 * edges[i + 1]] for i in own]])

    return map_arrow(texts, run, SETS_SCHEMA)


def bucket_mates(signed: DataFrame) -> DataFrame:
    """``bucket, tail, node`` of nodes (node, signature) for each of their buckets that may hold another node.

    The rows are range-sorted, and rows without a neighbour in their bucket go; those at a task's ends always stay.
    """
    bands = F.array(*(F.struct(F.xxhash64(F.lit(b), F.expr(f"substring(signature, {b * ROWS + 1}, {ROWS})")).alias("bucket"), F.expr(f"substring(signature, {BANDS * ROWS + b * TAIL % (SLOTS - BANDS * ROWS - TAIL + 1) + 1}, {TAIL})").alias("tail")) for b in range(BANDS)))
    rows = signed.select("node", F.inline(bands)).select("bucket", "tail", "node")
    n = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shared = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            bucket = table.column("bucket").to_numpy()
            same = bucket[1:] == bucket[:-1]
            keep = np.r_[shared, same] | np.r_[same, True]
            # The last row waits for the next batch, which tells whether it has a neighbour.
            yield table.slice(0, len(bucket) - 1).filter(pa.array(keep[:-1]))
            held, shared = table.slice(len(bucket) - 1), bool(len(same) and same[-1])
        if held is not None:
            yield held

    return map_arrow(rows.repartitionByRange(n, "bucket", "tail", "node").sortWithinPartitions("bucket", "tail", "node"), run, "bucket bigint, tail binary, node bigint")


def matches(mates: DataFrame, signed: DataFrame, least: float) -> DataFrame:
    """``a, b`` with ``a < b``: for each node its best partner of all buckets among the nodes with smaller numbers.

    A partner's signature agrees in at least the share ``least`` of slots, and is among the ``BEFORE`` nodes on either side
    in a sorted bucket. Equally good partners are told apart by a hash, so that no node is everybody's partner for its
    number alone. What lies outside the window or across a task's end is left to `cross_links`.
    """
    rows = mates.join(signed.hint("merge"), "node")
    n = int(mates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("bucket", "tail", "node", "signature").repartitionByRange(n, "bucket", "tail", "node").sortWithinPartitions("bucket", "tail", "node").drop("tail")
    schema = arrow_schema("a bigint, b bigint, agree int")
    enough = int(np.ceil(least * SLOTS - 1e-9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            bucket, node = (batch.column(c).to_numpy() for c in ("bucket", "node"))
            sign = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(-1, SLOTS)
            old = 0
            if held is not None:
                old = len(held[0])
                bucket, node, sign = (np.concatenate(x) for x in zip(held, (bucket, node, sign), strict=True))
            best, partner = np.full(len(bucket), -1), np.zeros(len(bucket), np.int64)
            for k in range(1, BEFORE + 1):
                at = np.arange(max(old, k), len(bucket))
                at = at[bucket[at] == bucket[at - k]]
                if not len(at):
                    break
                for start in range(0, len(at), 20_000):
                    x = at[start : start + 20_000]
                    agree = (sign[x] == sign[x - k]).sum(1)
                    # The larger number of the two has the other as a partner.
                    later = node[x] > node[x - k]
                    for child, other, of in ((x[later], x[later] - k, agree[later]), (x[~later] - k, x[~later], agree[~later])):
                        good = (of >= enough) & (of > best[child])
                        best[child[good]], partner[child[good]] = of[good], other[good]
            x = np.flatnonzero(best >= 0)
            yield batch_of(schema, [node[partner[x]], node[x], best[x]])
            held = tuple(c[-BEFORE:] for c in (bucket, node, sign))

    found = map_arrow(rows, run, "a bigint, b bigint, agree int")
    return found.groupBy("b").agg(F.max_by("a", F.struct("agree", F.xxhash64("a", "b"))).alias("a")).select("a", "b")


def block_links(node: np.ndarray, label: np.ndarray, side: np.ndarray, sign: np.ndarray, sets: list[bytes], least: float, threshold: float) -> list[tuple[int, int]]:
    """Verified links between nodes of different labels and, where there are two sides, of different sides.

    Each pair whose signatures agree in at least that share of slots is verified, unless verified links that are already
    found join its labels; so the links have the same components as all links would.
    """
    _, component, size = np.unique(label, return_inverse=True, return_counts=True)
    if len(size) < 2:
        return []
    # The largest labels first: most tiles have one label, and meet only the nodes of others.
    order = np.lexsort((component, -size[component]))
    component, columns = component[order], np.ascontiguousarray(sign[order].T)
    side, node = side[order], node[order]
    two = side.min() != side.max()
    left = np.flatnonzero(side == side.min()) if two else np.arange(len(order))
    right = np.flatnonzero(side != side.min()) if two else left
    enough, links, coded = int(np.ceil(least * SLOTS - 1e-9)), [], None
    for start in range(0, len(left), TILE):
        tile = left[start : start + TILE]
        other = right if two else right[start:]
        if component[tile[0]] == component[tile[-1]] and (component[tile] == component[tile[0]]).all():
            other = other[component[other] != component[tile[0]]]
        for begin in range(0, len(other), 4096):
            part = other[begin : begin + 4096]
            mine, theirs = columns[:, tile], columns[:, part]
            agree = np.zeros((len(tile), len(part)), np.uint8)
            for k in range(SLOTS):
                agree += mine[k][:, None] == theirs[k]
            near = (agree >= enough) & (component[tile][:, None] != component[part])
            for i in np.flatnonzero(near.any(1)).tolist():
                x, y = tile[i], part[near[i]]
                y = y[component[y] != component[x]]
                if not len(y):
                    continue
                if coded is None:
                    decoded = [members(sets[j]) for j in order.tolist()]
                    sizes = np.array([len(d) for d in decoded], np.int64)
                    firsts = np.cumsum(sizes) - sizes
                    coded = np.unique(np.concatenate(decoded), return_inverse=True)[1]
                    marked = np.zeros(len(coded) + 1, bool)
                own = coded[firsts[x] : firsts[x] + sizes[x]]
                marked[own] = True
                ends = np.cumsum(sizes[y])
                at = np.arange(ends[-1]) + np.repeat(firsts[y] - (ends - sizes[y]), sizes[y])
                both = np.add.reduceat(marked[coded[at]].astype(np.int64), ends - sizes[y])
                marked[own] = False
                y = y[both / (sizes[x] + sizes[y] - both) >= threshold]
                for c in np.unique(component[y]).tolist():
                    partner = y[component[y] == c][0]
                    links.append((min(int(node[x]), int(node[partner])), max(int(node[x]), int(node[partner]))))
                found = np.unique(component[y])
                component[np.isin(component, found)] = component[x]
    return links


def cross_links(mates: DataFrame, signed: DataFrame, sets: DataFrame, labels: DataFrame, least: float, threshold: float) -> DataFrame:
    """Verified links ``a < b`` that join all components of labels (node, label) that any pair of bucket mates links.

    Buckets with nodes of one component only are left out. All others are compared whole: a bucket of more than
    ``BLOCK`` nodes is dealt into blocks, and each two blocks, and each by itself, meet in a group of their own, so no
    task holds more than two blocks at a time and no pair depends on a sort order or on where a task ends.
    """
    rows = mates.select("bucket", "node").join(labels.hint("merge"), "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    rows = staged(rows, "labelled")
    mixed = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("bucket", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = salted_lookup(rows, mixed, ["bucket"], ["node"], 8, "n", rows.count()).where(F.col("blocks").isNotNull())
    rows = rows.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("bucket", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "node", "label")
    rows = rows.join(signed.hint("merge"), "node").join(sets.hint("merge"), "node").select("bucket", "lo", "hi", "side", "node", "label", "signature", "shingles")
    n = int(mates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    schema = arrow_schema("a bigint, b bigint")

    def group(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        node, label, side = (table.column(c).to_numpy() for c in ("node", "label", "side"))
        sign = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, SLOTS)
        # A group of two blocks leaves the pairs inside either block to that block's own group.
        found = block_links(node, label, side, sign, table.column("shingles").to_pylist(), least, threshold)
        return batch_of(schema, [[x[0] for x in found], [x[1] for x in found]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("bucket", "lo", "hi")], 1)
            edges = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys)].tolist()
            for a, b in zip(edges, edges[1:], strict=False):
                this = tuple(keys[a].tolist())
                if parts and this != key:
                    yield group(parts)
                    parts = []
                key = this
                parts.append(batch.slice(a, b - a))
        if parts:
            yield group(parts)

    return staged(map_arrow(rows, run, "a bigint, b bigint").distinct(), "links")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets are at least as similar as the threshold."""
    side = lambda end: sets.select(F.col("node").alias(end), F.col("shingles").alias(f"s{end}")).hint("merge")
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
    schema = arrow_schema("a bigint, b bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(a, b) for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True) if similarity(x, y) >= threshold]
            yield batch_of(schema, [[x[0] for x in kept], [x[1] for x in kept]])

    return map_arrow(joined, run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each linked node's component.

    Large and small stars alternate: each node links its larger neighbours to the smallest node that it knows, then its
    smaller neighbours and itself, until the links are stars. A step never makes more links than there are, and the number of
    steps grows with the logarithm of a component's size, also for long chains.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    size = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = staged(small, "edges")
        # A sum over the links that is the same twice: nothing has moved.
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        release(edges)
        edges = new
        if now == size or not now[0]:
            out = edges.groupBy("u").agg(F.min("v").alias("label"))
            return staged(out.select(F.col("u").alias("node"), "label").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), "labels")
        size = now


def wordless(text: str) -> Column:
    return ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\s\x1c-\x1f\x85\p{Z}]")


def classified_rows(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, mark, class_id, leads`` of each row of ``docs`` (doc_id, mark, text) with an id and a word.

    ``leads`` says that a row is of the class's smallest doc_id and, if that comes with several of the class's texts, has
    the one whose digest is smallest; only repeated rows of a class can lead together.
    """
    rows = staged(document_rows(docs), "signatures")
    nodes = rows.groupBy("content").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"), F.count("*").alias("copies"))
    # Numbers of nodes are kept in the table, so that they never depend on how its files are read back.
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    signed = nodes.select("node", "signature")
    mates = staged(bucket_mates(signed), "mates")
    # The nodes can be as many as the documents, so they are never broadcast; the plan is the same at every size.
    involved = nodes.select("node", "doc_id", "content").hint("merge").join(mates.select("node").distinct(), "node", "left_semi")
    texts = docs.select("doc_id", "text").hint("merge").join(involved.hint("merge"), "doc_id").select("node", "content", "text")
    sets = staged(shingle_sets(texts).dropDuplicates(["node"]), "sets")
    links = staged(verified(matches(mates, signed, threshold - FIRST_MARGIN), sets, threshold), "links")
    labels = components(links)
    more = cross_links(mates, signed, sets, labels, threshold - MARGIN, threshold)
    for used in (mates, sets):
        release(used)
    if more.take(1):
        release(labels)
        labels = components(links.unionByName(more))
    for used in (links, more):
        release(used)
    # Only nodes with links have a class other than their own.
    linked = nodes.select("node", "content", "doc_id").hint("merge").join(labels.hint("merge"), "node")
    heads = linked.groupBy("label").agg(F.min(F.struct("doc_id", "content")).alias("head"), F.count("*").alias("members"))
    known = salted_lookup(linked, heads, ["label"], ["node"], count="members", total=labels.count()).select("node", F.col("head.doc_id").alias("class_id"), (F.col("head.content") == F.col("content")).alias("leads"))
    found = nodes.select("node", "content", "copies", F.col("doc_id").alias("_own")).hint("merge").join(known.hint("merge"), "node", "left")
    found = found.select("content", "copies", F.coalesce("class_id", "_own").alias("class_id"), F.coalesce("leads", F.lit(True)).alias("leads")).where("copies > 1 or not leads or class_id is null")
    out = salted_lookup(rows.select("doc_id", "mark", "content"), found, ["content"], ["doc_id", "mark"], count="copies", total=rows.count())
    return out.select("doc_id", "mark", F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("leads", F.lit(True)) & (F.coalesce("class_id", "doc_id") == F.col("doc_id"))).alias("leads"))


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id`` of each row of ``docs`` (doc_id, text); ``class_id`` is the smallest doc_id of its class.

    Rows are of one class if their words are equal, or a chain of verified links joins their texts. Rows that share an id
    are classed each by its own text, so both texts of an id keep all their links. Null, empty and wordless texts make no
    links and are classes of their own; rows without an id have no class. Repeated rows are returned as often as they
    come. Texts of fewer than five words are alike only if equal. Long texts are compared whole. An empty table has no
    class. Other columns of ``docs`` are not read.
    """
    docs = marked(docs)
    rest = docs.where(F.col("doc_id").isNull() | wordless("text")).select("doc_id", F.col("doc_id").alias("class_id"))
    return classified_rows(docs, threshold).select("doc_id", "class_id").unionByName(rest)


def marked(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, text``, where the mark tells apart the texts of an id."""
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")


def first_of_each_class(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of near duplicates of ``docs`` (doc_id, text and any other columns), all columns as they are.

    The row of a class's smallest doc_id stays; of several texts of that id the one whose digest is smallest; of rows
    equal in id and text any one. Rows without an id or without a word have no duplicates and all stay.
    """
    leaders = classified_rows(marked(docs), threshold).where("leads").groupBy("doc_id", "mark").agg(F.count("*").alias("copies"))
    leaders = staged(leaders, "leaders")
    names = [f"_{k}" for k in range(len(docs.columns))]
    # Under other names, no column of docs clashes with those of the join.
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)))
    key, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    rows = rows.withColumns({"doc_id": F.col(key), "mark": F.xxhash64(text)})
    lone = F.col(key).isNull() | wordless(text)
    joined = rows.hint("merge").join(leaders.hint("merge"), ["doc_id", "mark"], "left")
    kept = joined.where(lone | (F.col("copies") == 1)).select(names)
    if leaders.where("copies > 1").take(1):
        again = rows.where(~lone).join(leaders.where("copies > 1").hint("merge"), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])
        kept = kept.unionByName(again.select(names))
    return kept.toDF(*docs.columns)
