"""Byte-level pair encoding and decoding with a segment tree over byte positions.

Each pre-token's bytes are the leaves of a segment tree whose nodes hold the smallest (rank, position) of the pairs
below them. The root names the next merge: the lowest rank, leftmost on ties. A merge rewrites three leaves (the merged
pair, its left neighbour and the one that vanishes) and their paths to the root, so it costs a logarithm of the
length. Live positions are linked as neighbours. The trees of many pre-tokens of like length are rows of one array and
step together.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import CACHE_WORDS, PairTable, arrow_schema, batch_of, map_arrow, slices

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: Cells of the trees that step together.
CELLS = 4_000_000
NONE = np.iinfo(np.int64).max
#: Unicode white space, which the rank files' library means by \s (Python's own class has four control characters more).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def portable(pattern: str) -> str:
    r"""``pattern`` with \s and \S spelt out as Unicode white space."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


class ByteCodec:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.split = regex.compile(portable(pattern)).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.symbol = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for whole, rank in ranks.items():
            for cut in range(1, len(whole)):
                a, b = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = (rank, rank)
        self.table = PairTable(pairs)
        self.cache: dict[str, bytes] = {}
        self.first: dict[str, bytes | None] = {}
        self.later: dict[str, bytes | None] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteCodec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.table.rank[self.table.find(left, right)].astype(np.int64)

    def _merge(self, data: list[bytes], width: int) -> list[bytes]:
        """Ids of pre-tokens of at most ``width`` (a power of two) bytes, as little-endian unsigned 32-bit integers."""
        rows = np.arange(len(data))
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        symbols = np.full((len(data), width + 1), -1, np.int32)
        inside = np.arange(width + 1) < lengths[:, None]
        symbols[inside] = self.symbol[np.frombuffer(b"".join(data), np.uint8)]
        index = np.int32 if width < 2**30 else np.int64
        after = np.minimum(np.arange(1, width + 2, dtype=index), lengths[:, None].astype(index))
        before = np.broadcast_to(np.arange(-1, width, dtype=index), after.shape).copy()
        tree = np.full((len(data), 2 * width), NONE, np.int64)
        row, at = np.nonzero(inside[:, 1:])
        rank = self._rank(symbols[row, at], symbols[row, at + 1])
        known = rank < PairTable.MISS
        tree[row[known], width + at[known]] = rank[known] * width + at[known]
        level = width
        while level > 1:
            half = level >> 1
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half

        def put(r: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + width
            tree[r, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        def value(left: np.ndarray, right: np.ndarray, leaf: np.ndarray) -> np.ndarray:
            rank = self._rank(left, right)
            return np.where(rank < PairTable.MISS, rank * width + leaf, NONE)

        while True:
            root = tree[rows, 1]
            rows = rows[live := root < NONE]
            if not len(rows):
                break
            rank, left = np.divmod(root[live], width)
            right = after[rows, left].astype(np.int64)
            beyond = after[rows, right].astype(np.int64)
            symbols[rows, left] = rank
            symbols[rows, right] = -1
            after[rows, left] = beyond
            inner = beyond < lengths[rows]
            before[rows[inner], beyond[inner]] = left[inner]
            put(rows, right, np.full(len(rows), NONE))
            put(rows, left, np.where(inner, value(symbols[rows, left], symbols[rows, beyond], left), NONE))
            prior = before[rows, left].astype(np.int64)
            outer = prior >= 0
            if outer.any():
                r, p = rows[outer], prior[outer]
                put(r, p, value(symbols[r, p], symbols[r, left[outer]], p))
        alive = symbols >= 0
        ends = np.cumsum(alive.sum(1)) * 4
        out = symbols[alive].astype("<u4").tobytes()
        starts = np.r_[0, ends[:-1]].tolist()
        return [out[a:b] for a, b in zip(starts, ends.tolist(), strict=True)]

    def encode_pretokens(self, words: list[str]) -> list[bytes]:
        """Ids of each pre-token. One that is itself in the vocabulary is its own id, as in the rank files' library."""
        out: list[bytes] = [b""] * len(words)
        classes: dict[int, list[int]] = {}
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        for i, b in enumerate(data):
            rank = self.ranks.get(b)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif b:
                classes.setdefault((len(b) - 1).bit_length(), []).append(i)
        for bits, members in classes.items():
            step = max(1, CELLS >> (bits + 1))
            for start in range(0, len(members), step):
                part = members[start : start + step]
                for i, ids in zip(part, self._merge([data[i] for i in part], 1 << bits), strict=True):
                    out[i] = ids
        return out

    def _learn(self, known: dict[str, bytes | None], words: list[str], lead: str) -> None:
        """Ids of words that stood between single spaces; None for those whose surroundings decide how they split."""
        split = [self.split(lead + w) if w and not (w[0].isspace() or w[-1].isspace()) else None for w in words]
        if len(self.cache) > CACHE_WORDS // 3:
            self.cache.clear()
        new = list(set().union(*filter(None, split)).difference(self.cache))
        self.cache.update(zip(new, self.encode_pretokens(new), strict=True))
        get = self.cache.__getitem__
        known.update((w, None if x is None else b"".join(map(get, x))) for w, x in zip(words, split, strict=True))

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text. No match of the pattern spans a single space between two other characters but at its start."""
        if len(self.later) + len(self.first) > CACHE_WORDS:
            self.later.clear()
            self.first.clear()
        split = [x.split(" ") for x in texts]
        self._learn(self.first, list({x[0] for x in split}.difference(self.first)), "")
        self._learn(self.later, list(set().union(*(x[1:] for x in split)).difference(self.later)), " ")
        get, out = self.later.__getitem__, []
        for words in split:
            try:
                ids = self.first[words[0]] + b"".join(map(get, words[1:]))
            except TypeError:
                whole = self.split(" ".join(words))
                new = list(set(whole).difference(self.cache))
                self.cache.update(zip(new, self.encode_pretokens(new), strict=True))
                ids = b"".join(map(self.cache.__getitem__, whole))
            out.append(ids)
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(1)
def codec(path: str, pattern: str) -> ByteCodec:
    return ByteCodec.load(path, pattern)


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row of ``docs`` (doc_id, text); a map without a shuffle.

    Null and empty texts have no ids, and the digests of nothing. Repeated rows and null ids are kept, one row out for
    each in. Long texts, and long stretches without a break, are encoded whole. Other columns are not read.
    """
    schema = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(ranks, pattern)
        for batch in batches:
            for part in slices(batch):
                ids = code.encode(x or "" for x in part.column("text").to_pylist())
                yield batch_of(schema, [part.column("doc_id"), [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(code.decode(x)).hexdigest() for x in ids]])

    return map_arrow(docs.select("doc_id", "text"), run, SCHEMA)
