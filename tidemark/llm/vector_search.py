"""Nearest vectors by cosine: a robust-pruned directed graph per shard, and beam search in every shard.

Equal vectors are one point, with the few smallest ids that any result could need. Points are dealt to shards by a hash.
In a shard each point in turn searches the graph greedily from the entry points; of the points that the search met, it
keeps the nearest, and then only those that no kept one is much nearer to (the relaxed distance rule), which leaves edges
in diverse directions. Edges are returned, and a point with too many prunes them by the same rule. Many points search
and prune at once, as rows of arrays. Queries are read in blocks by each shard's task, so neither shards nor queries are
ever gathered in one place; the best of each shard are rescored in double precision and merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, map_arrow, on_store, share_code, staged

#: Points of a shard, out-degree, beam of building and of queries, and the relaxation of the pruning rule.
SHARD_POINTS, DEGREE, BUILD_BEAM, QUERY_BEAM, RELAX = 8192, 24, 20, 200, 1.4
#: Points that search and prune at once while a graph is built; queries that a task searches at once; entry points.
BUILD_BLOCK, QUERY_BLOCK, ENTRIES = 2048, 256, 16
INDEX = "shard bigint, dim int, ids binary, first binary, vectors binary, edges binary, entries binary"
FOUND = "query_id bigint, vec_id bigint, score double"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in single precision; scaled first, so no square over- or underflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def beam_search(points: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest points that greedy search meets, for each query: ids (-1: none) and distances (1 - cosine), nearest first."""
    n, width = len(queries), beam + edges.shape[1]
    ids = np.full((n, width), -1, np.int32)
    far = np.full((n, width), np.inf, np.float32)
    done = np.zeros((n, width), bool)
    met = np.zeros((n, len(points)), bool)
    m = min(len(entries), beam)
    ids[:, :m] = entries[:m]
    far[:, :m] = 1 - queries @ points[entries[:m]].T
    met[:, entries[:m]] = True
    active = np.arange(n)
    while len(active):
        waiting = np.where(done[active, :beam], np.inf, far[active, :beam])
        k = waiting.argmin(1)
        going = np.isfinite(waiting[np.arange(len(active)), k])
        active, k = active[going], k[going]
        if not len(active):
            break
        at = ids[active, k]
        done[active, k] = True
        near = edges[at]
        new = near >= 0
        new &= ~met[active[:, None], np.maximum(near, 0)]
        met[np.broadcast_to(active[:, None], near.shape)[new], near[new]] = True
        distance = np.full(near.shape, np.inf, np.float32)
        row, column = np.nonzero(new)
        distance[row, column] = 1 - np.einsum("nd,nd->n", points[near[row, column]], queries[active[row]])
        ids[active, beam:], far[active, beam:], done[active, beam:] = near, distance, False
        order = np.argsort(far[active], 1, kind="stable")
        ids[active] = np.take_along_axis(ids[active], order, 1)
        far[active] = np.take_along_axis(far[active], order, 1)
        done[active] = np.take_along_axis(done[active], order, 1)
    return ids[:, :beam], far[:, :beam]


def robust_prune(points: np.ndarray, of: np.ndarray, ids: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """At most ``degree`` of each row's candidates ``ids`` (-1: none): the nearest first, each of which drops those that
    are ``relax`` times nearer to it than to the row's point."""
    ids = np.where(ids == of[:, None], -1, ids)
    ranked = np.sort(ids, 1)
    ids = np.where(np.c_[np.zeros(len(ids), bool), ranked[:, 1:] == ranked[:, :-1]], -1, ranked)
    vectors = points[np.maximum(ids, 0)]
    squared = np.maximum(2 - 2 * np.einsum("ncd,nd->nc", vectors, points[of]), 0)
    squared[ids < 0] = np.inf
    between = np.maximum(2 - 2 * vectors @ vectors.transpose(0, 2, 1), 0)
    out = np.full((len(of), degree), -1, np.int32)
    rows, left = np.arange(len(of)), squared.copy()
    for k in range(degree):
        best = left.argmin(1)
        live = np.isfinite(left[rows, best])
        if not live.any():
            break
        out[live, k] = ids[rows, best][live]
        left[(relax * relax * between[rows, best] <= squared) & live[:, None]] = np.inf
        left[rows, best] = np.inf
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Edges (-1: none) and entry points of the graph over unit vectors."""
    n = len(points)
    rng = np.random.default_rng(seed)
    entries, nearest = [int((points @ points.mean(0)).argmax())], None
    for _ in range(min(ENTRIES, n) - 1):
        distance = 1 - points @ points[entries[-1]]
        nearest = distance if nearest is None else np.minimum(nearest, distance)
        entries.append(int(nearest.argmax()))
    entries = np.unique(np.array(entries, np.int32))  # points in one place are met once
    edges = np.full((n, degree), -1, np.int32)
    if n > 1:
        some = rng.integers(0, n - 1, (n, min(degree // 2, n - 1)), dtype=np.int32)
        edges[:, : some.shape[1]] = some + (some >= np.arange(n, dtype=np.int32)[:, None])
    order = rng.permutation(n)
    for start in range(0, n, BUILD_BLOCK):
        part = order[start : start + BUILD_BLOCK]
        ids, _ = beam_search(points, edges, entries, points[part], beam)
        edges[part] = robust_prune(points, part, np.concatenate([ids, edges[part]], 1), degree, relax)
        # The other direction: each point that was chosen gets an edge back, and prunes if it has too many.
        source = np.repeat(part, degree)[edges[part].ravel() >= 0].astype(np.int32)
        target = edges[part].ravel()[edges[part].ravel() >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        while len(target):
            lead = np.r_[True, target[1:] != target[:-1]]
            begin = np.maximum.accumulate(np.where(lead, np.arange(len(target)), 0))
            place = np.arange(len(target)) - begin
            now = place < degree
            chosen = target[lead]
            back = np.full((len(chosen), degree), -1, np.int32)
            back[np.cumsum(lead)[now] - 1, place[now]] = source[now]
            edges[chosen] = robust_prune(points, chosen, np.c_[edges[chosen], back], degree, relax)
            source, target = source[~now], target[~now]
    return edges, entries


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct ``vec_id, embedding`` of vectors with a direction: not null, not empty, all components finite, not zero."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists(e, lambda x: x != 0)).select(F.col("vec_id").cast("bigint").alias("vec_id"), e.alias("embedding"))


def build_index(vectors: DataFrame, keep: int, shard_points: int = SHARD_POINTS) -> DataFrame:
    """The index of all vectors as a staged table: a row per shard with its points and graph.

    ``keep``: how many of the smallest ids of equal vectors a result can hold. Vectors of different sizes are in
    different shards. The number of shards follows the number of distinct vectors.
    """
    first = W.partitionBy("embedding").orderBy("vec_id")
    ranked = usable(vectors).withColumn("_n", F.dense_rank().over(first)).where(F.col("_n") <= keep)
    points = staged(ranked.groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), "points")
    shards = max(1, -(-points.count() // shard_points))
    points = points.withColumn("dim", F.size("embedding")).withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)))
    share_code(vectors.sparkSession)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ids", key=lambda c: c.map(lambda x: x[0]))
        original = np.array(rows["embedding"].tolist(), np.float64)
        edges, entries = build_graph(unit(original))
        counts = np.array([len(x) for x in rows["ids"]], np.int64)
        return pd.DataFrame([(int(rows["shard"].iloc[0]), int(rows["dim"].iloc[0]), np.concatenate(rows["ids"].tolist()).astype("<i8").tobytes(), np.r_[0, np.cumsum(counts)].astype("<i8").tobytes(), original.tobytes(), edges.tobytes(), entries.tobytes())], columns=["shard", "dim", "ids", "first", "vectors", "edges", "entries"])

    # A range for each shard, so that no task builds two graphs where others have none to build.
    return staged(points.repartitionByRange(shards, "shard").groupBy("shard", "dim").applyInPandas(build, INDEX), "index")


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = QUERY_BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query (vec_id, embedding) the ``k`` nearest of the index but itself.

    Every shard's task reads the staged queries in blocks. Ties go to the smaller vec_id. Fewer than ``k`` rows come
    back where there are fewer candidates; an empty index or query table gives no rows.
    """
    queries = staged(usable(queries).distinct().withColumnRenamed("vec_id", "query_id"), "queries")
    where, folder = on_store(queries.sparkSession, queries.staged_path)
    uri = folder.makeQualified(where).toString()
    schema = arrow_schema(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for shard in batch.to_pylist():
                original = np.frombuffer(shard["vectors"], np.float64).reshape(-1, shard["dim"])
                ids, first = np.frombuffer(shard["ids"], "<i8"), np.frombuffer(shard["first"], "<i8")
                edges, entries = np.frombuffer(shard["edges"], np.int32).reshape(len(original), -1), np.frombuffer(shard["entries"], np.int32)
                points = unit(original)
                for block in ds.dataset(path, filesystem=store, format="parquet").to_batches(batch_size=QUERY_BLOCK):
                    asked = [(q, v) for q, v in zip(block.column("query_id").to_pylist(), block.column("embedding").to_pylist(), strict=True) if len(v) == shard["dim"]]
                    if not asked:
                        continue
                    own = np.array([q for q, _ in asked], np.int64)
                    vectors = np.array([v for _, v in asked], np.float64)
                    # All points that the beam ends with are scored in double precision, which tells the nearly equal apart.
                    near, _ = beam_search(points, edges, entries, unit(vectors), beam)
                    row, column = np.nonzero(near >= 0)
                    point = near[row, column]
                    score = cosine(vectors[row], original[point])
                    # Each point stands for its ids; a query keeps the best k but itself.
                    many = first[point + 1] - first[point]
                    row, score = np.repeat(row, many), np.repeat(score, many)
                    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    found = ids[np.repeat(first[point], many) + place]
                    other = found != own[row]
                    row, score, found = row[other], score[other], found[other]
                    order = np.lexsort((found, -score, row))
                    row, score, found = row[order], score[order], found[order]
                    begin = np.searchsorted(row, row)
                    best = np.arange(len(row)) - begin < k
                    yield batch_of(schema, [own[row[best]], found[best], score[best]])

    shards = max(1, index.count())
    found = map_arrow(index.repartition(shards), run, FOUND)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vector whose id is divisible by ``every``, its ``k`` nearest others.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id.
    Repeated rows count once; equal vectors with different ids are different candidates with equal scores. Other
    columns are not read.
    """
    index = build_index(vectors, k + 1)
    return search(index, vectors.where(F.col("vec_id") % every == 0), k)
