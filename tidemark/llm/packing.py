"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous rounds.

Documents are tokenised where they lie; only their pieces' lengths and checksums go on. Pieces are range-sorted by length,
which gives each its rank: longer pieces first. Pieces of more than half a sequence open sequences of their own; the others
follow in classes of lengths, the longest first, and each class in rounds. A round range-sorts the class's pieces together
with the gaps that could hold them, and each task sweeps its range downwards: a piece takes its successor, the smallest gap
of the range that holds it, and what is left of a gap stays in the sweep. Pieces without a successor in their range meet in
the gaps of higher ranges, where the higher rank wins: of each task's sweep only the numbers of such pieces and gaps go to
the driver, and a table of intervals, a few for each task, tells every loser which gap comes next for it. Then the gaps are
updated, and the round is repeated as long as many pieces still find one. In the last round of a class, pieces that no gap of
their range holds open new sequences. Where all pieces fit one task, its sweep is best-fit decreasing.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, map_arrow, release, slices, staged

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"
#: What a sweep returns: placed pieces, pieces that are left, and gaps. ``at`` is the place among those of its task that
#: may meet others' (pieces the longest first, gaps the smallest first), -1 for gaps below the task's range.
SWEPT = "kind int, rank bigint, seq bigint, size bigint, offset bigint, part int, at bigint"
GAP, PIECE, PLACED = 0, 1, 2
#: Pieces of a task, in a class of lengths that is worth more than one; classes halve the length this often.
TASK_PIECES, CLASSES = 25_000, 3
#: A class goes on to the next round while at least this share of the pieces that are left meets gaps of other ranges; then
#: its last sweep opens new sequences for what no gap holds.
MEETING_SHARE = 0.125
#: Fixed values of the vocabulary's format: how it splits words, and the id that ends a document here.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END_ID = 0
#: Words that an encoder keeps between slices of texts.
HELD_WORDS = 500_000


class WordEncoder:
    """Ids of texts as the vocabulary's own library gives them, with a cache of words.

    White space separates the vocabulary's words, so a text's ids are its words' ids. That holds for texts of Latin
    letters, digits and punctuation without the special tokens' strings; the library itself encodes any other text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.plain = re.compile("[\x00-\x1b\x20-\u024f]*").fullmatch
        self.split = regex.compile(PATTERN).findall
        self.bytes_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.cache: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        tokenize, ids = self.library.model.tokenize, []
        for part in (word,) if word.isalpha() else self.split(word):  # a word of letters is one part
            if not (part.isascii() and part.isprintable()):  # other bytes have stand-ins
                part = "".join(mapped for mapped, _ in self.bytes_level.pre_tokenize_str(part))
            ids += [t.id for t in tokenize(part)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, without any that the library would add."""
        if len(self.cache) > HELD_WORDS:
            self.cache.clear()
        texts = list(texts)
        split = [x.lower().split() if self.plain(x) and not any(s in x for s in self.special) else None for x in texts]
        for word in set().union(*filter(None, split)).difference(self.cache):
            self.cache[word] = self._word(word)
        other = [x for x, words in zip(texts, split, strict=True) if words is None]
        slow = iter(self.library.encode_batch(other, add_special_tokens=False) if other else ())
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) if words is not None else np.array(next(slow).ids, "<u4").tobytes() for words in split]


@lru_cache(1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def document_pieces(docs: DataFrame, vocabulary: str, size: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and the end id, cut after every ``size`` ids."""
    schema = arrow_schema(PIECES)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(x or "" for x in part.column("text").to_pylist()), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        data = ids[at : at + 4 * size]
                        rows.append((doc_id, k, at // 4, len(data) // 4, zlib.crc32(data)))
                yield batch_of(schema, [list(c) for c in zip(*rows, strict=True)])
        # The worker goes on to sweeps, which need the memory.
        encoder(vocabulary).cache.clear()

    return map_arrow(docs.select("doc_id", "text"), run, PIECES)


def sweep_range(kind: np.ndarray, ident: np.ndarray, size: np.ndarray, sequence: int, opens: bool) -> tuple[list, list, list]:
    """Best fit of a range's pieces into its gaps, both longest first and gaps before pieces of equal size.

    Pieces of equal length and gaps of equal size go as runs. A run of pieces meets the run of the smallest gaps that hold
    one; each gap takes as many as fit one after the other, for what is left of it is then the smallest that still fits. Where
    no gap holds them, pieces open sequences, named after their first piece, or are left. Returns placed pieces (ranks,
    sequences, offsets), left ones (ranks, length) and gaps (sequences, size), as lists of runs.
    """
    placed, left = [], []
    sizes: list[int] = []  # of gaps, ascending
    runs: dict[int, list[np.ndarray]] = {}

    def keep(gap: int, holders: np.ndarray) -> None:
        if gap and len(holders):
            if gap not in runs:
                insort(sizes, gap)
                runs[gap] = []
            runs[gap].append(holders)

    cuts = np.flatnonzero((size[1:] != size[:-1]) | (kind[1:] != kind[:-1])) + 1
    for start, stop in zip(np.r_[0, cuts].tolist() if len(size) else (), [*cuts.tolist(), len(size)], strict=False):
        length, run = int(size[start]), ident[start:stop]
        if kind[start] == GAP:
            keep(length, run)
            continue
        fresh = []
        while len(run):
            k = bisect_left(sizes, length)
            if k < len(sizes):
                gap = sizes[k]
                holders = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], sizes[k]
                each = gap // length
            elif opens:
                gap, each = sequence, sequence // length
                full = len(run) // each
                # The first layer of pieces names the sequences; a last one may be filled in part.
                holders = np.r_[run[:full], run[full * each : full * each + 1]]
            else:
                left.append((run, length))
                break
            full = min(len(holders), len(run) // each)
            rest = min(len(run) - full * each, each - 1) if full < len(holders) else 0
            for groups, per in ((full, each), (int(rest > 0), rest)):
                if groups:
                    placed += [(run[j * groups : (j + 1) * groups], holders[:groups], sequence - gap + j * length) for j in range(per)]
                    fresh.append((gap - per * length, holders[:groups]))
                    run, holders = run[groups * per :], holders[groups:]
            fresh.append((gap, holders))
        for gap, holders in fresh:
            keep(gap, holders)
    return placed, left, [(holders, gap) for gap in sizes for holders in runs[gap]]


def swept(rows: DataFrame, sequence: int, n: int, opens: bool) -> DataFrame:
    """One sweep over ``kind, id, size`` of gaps and pieces by ``n`` tasks, as a staged table; ``opens``: pieces that no gap of
    their range holds open new sequences."""
    order = [F.desc("size"), "kind", "id"]
    schema = arrow_schema(SWEPT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        columns = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not columns:
            return
        kind, ident, size = (np.concatenate(c) for c in zip(*columns, strict=True))
        placed, left, gaps = sweep_range(kind, ident, size, sequence, opens)
        lowest = int(size[-1])
        join = lambda runs, k: np.concatenate([r[k] if isinstance(r[k], np.ndarray) else np.full(len(r[0]), r[k], np.int64) for r in runs]).astype(np.int64) if runs else np.zeros(0, np.int64)

        def out(kind: int, rank, seq, size, offset, at) -> pa.RecordBatch:
            n = len(at)
            fill = lambda x: pa.nulls(n, pa.int64()) if x is None else x
            return batch_of(schema, [np.full(n, kind, np.int32), fill(rank), fill(seq), fill(size), fill(offset), np.full(n, part, np.int32), at])

        if placed:
            yield out(PLACED, join(placed, 0), join(placed, 1), None, join(placed, 2), np.full(sum(len(r[0]) for r in placed), -1))
        if left:
            ranks = join(left, 0)
            yield out(PIECE, ranks, None, join(left, 1), None, np.arange(len(ranks)))
        if gaps:
            sizes = join(gaps, 1)
            below = int((sizes < lowest).sum())
            yield out(GAP, None, join(gaps, 0), sizes, None, np.r_[np.full(below, -1), np.arange(len(sizes) - below)])

    return staged(map_arrow(rows.select("kind", "id", "size").repartitionByRange(n, *order).sortWithinPartitions(*order), run, SWEPT), "sweep")


def meetings(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Who meets whom between ranges: ``first pair, piece's task, first piece, gap's task, first gap, pairs``.

    ``counts``: of each task, in the order of its range from the highest, how many pieces it has left and how many gaps
    others may use. The pieces of a task take the gaps of the nearest higher range first, its smallest gap first; those
    of higher rank have chosen before. So of each task, the first pieces and the first gaps meet others.
    """
    out, pair = [], 0
    open_: list[list[int]] = []  # task, first gap that is free, gaps
    for task, pieces, gaps in counts:
        first = 0
        while first < pieces and open_:
            holder, used, many = open_[-1]
            n = min(pieces - first, many - used)
            out.append((pair, task, first, holder, used, n))
            pair, first = pair + n, first + n
            open_[-1][1] += n
            if open_[-1][1] == many:
                open_.pop()
        if gaps:
            open_.append([task, 0, gaps])
    return out


def taken(pairs: list[tuple], task: int, first: int) -> Column:
    """How many of the first pieces, or gaps, of the task ``part`` meet others: a number for each task, looked up by it."""
    most = max((p[task] for p in pairs), default=0)
    number = [0] * (most + 1)
    for p in pairs:
        number[p[task]] = max(number[p[task]], p[first] + p[5])
    table = F.split(F.lit(",".join(map(str, number))), ",").cast("array<bigint>")
    return F.coalesce(F.get(table, F.col("part")), F.lit(0))


def matched(spark: SparkSession, out: DataFrame, pairs: list[tuple], sequence: int) -> DataFrame:
    """The pieces and gaps of different ranges that meet, as a staged table: rank, seq, offset, and the gap's new size."""
    # A few intervals for each task.
    side = lambda task, first: F.broadcast(spark.createDataFrame([(p[0], p[task], p[first], p[first] + p[5]) for p in pairs], "pair bigint, part int, lo bigint, hi bigint"))

    def numbered(kind: int, table: DataFrame) -> DataFrame:
        rows = out.where((F.col("kind") == kind) & (F.col("at") >= 0)).select("rank", "seq", "size", F.col("part").alias("_part"), "at")
        met = rows.join(table, (F.col("_part") == F.col("part")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
        return met.withColumn("pair", F.col("pair") + F.col("at") - F.col("lo"))

    pieces, gaps = numbered(PIECE, side(1, 2)), numbered(GAP, side(3, 4))
    met = pieces.select("pair", "rank", F.col("size").alias("length")).hint("merge").join(gaps.select("pair", "seq", "size").hint("merge"), "pair")
    return staged(met.select("rank", "seq", (F.col("size") - F.col("length")).alias("size"), (F.lit(sequence) - F.col("size")).alias("offset")), "met")


def place(pieces: DataFrame, sequence: int) -> DataFrame:
    """``rank, seq, offset`` of all pieces (rank, length), by rounds of best fit."""
    spark = pieces.sparkSession
    # At most one row for each length.
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(lengths.values()) // TASK_PIECES)))
    alone = pieces.where(F.col("length") * 2 > sequence)
    placed = [alone.select("rank", F.col("rank").alias("seq"), F.lit(0).cast("bigint").alias("offset"))]
    gaps = alone.where(F.col("length") < sequence).select(F.col("rank").alias("seq"), (F.lit(sequence) - F.col("length")).cast("bigint").alias("size"))
    bounds = [b for b in dict.fromkeys(sequence // 2 ** (k + 1) for k in range(CLASSES if n > 1 else 1)) if b]
    as_rows = lambda df, kind, ident: df.select(F.lit(kind).alias("kind"), F.col(ident).alias("id"), F.col("size").cast("bigint").alias("size"))
    for high, low in zip(bounds, [*bounds[1:], 0], strict=False):
        if not any(low < length <= high for length in lengths):
            continue
        left = pieces.where((F.col("length") <= high) & (F.col("length") > low)).select("rank", F.col("length").alias("size"))
        idle = gaps.where(F.col("size") <= low)
        gaps = gaps.where(F.col("size") > low)
        last, tasks = n == 1, n
        while True:
            out = swept(as_rows(left, PIECE, "rank").unionByName(as_rows(gaps, GAP, "seq")), sequence, tasks, last)
            placed.append(out.where(F.col("kind") == PLACED).select("rank", "seq", "offset"))
            piece, gap = F.col("kind") == PIECE, F.col("kind") == GAP
            if last:
                gaps = out.where(gap).select("seq", "size")
                break
            # One row for each task.
            told = out.where("kind < 2").groupBy("part").agg(F.count_if(piece).alias("pieces"), F.count_if(gap & (F.col("at") >= 0)).alias("gaps"), F.count("*").alias("n")).orderBy("part").collect()
            waiting = sum(r["pieces"] for r in told)
            pairs = meetings([(r["part"], r["pieces"], r["gaps"]) for r in told])
            left = out.where(piece & (F.col("at") >= taken(pairs, 1, 2))).select("rank", "size")
            gaps = out.where(gap & ((F.col("at") < 0) | (F.col("at") >= taken(pairs, 3, 4)))).select("seq", "size")
            if pairs:
                met = matched(spark, out, pairs, sequence)
                placed.append(met.select("rank", "seq", "offset"))
                gaps = gaps.unionByName(met.where("size > 0").select("seq", "size"))
            met_others = sum(p[5] for p in pairs)
            if met_others == waiting:
                break
            last = met_others < MEETING_SHARE * waiting
            # Each task leaves a sequence that is filled in part, so no more of them sweep than rows need.
            tasks = max(1, min(n, -(-(sum(r["n"] for r in told) - met_others) // TASK_PIECES)))
        gaps = staged(gaps.unionByName(idle), "gaps")
    out = placed[0]
    for part in placed[1:]:
        out = out.unionByName(part)
    return out


def pack(docs: DataFrame, vocabulary: str, size: int = 2048) -> DataFrame:
    """Each piece of every row of ``docs`` (doc_id, text) with its place: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``.

    Null and empty texts are the end id alone. Only documents of more than ``size`` ids are cut. Repeated rows are
    packed as often as they come, null ids too. Pieces of equal length are ranked by id, piece and checksum; rows equal
    in all of these are alike, so their order does not matter. An empty table has no sequence. Other columns are not read.
    """
    pieces = staged(document_pieces(docs, vocabulary, size), "pieces")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("length"), "doc_id", "piece", "ids_crc32"]
    # The rank is kept in the table, so that it never depends on how the files are read back.
    ranked = staged(pieces.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id()), "ranked")
    release(pieces)
    where = place(ranked.select("rank", "length"), size)
    joined = ranked.hint("merge").join(where.hint("merge"), "rank")
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), "offset")
