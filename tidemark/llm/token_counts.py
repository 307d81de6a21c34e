"""Token counts of a piece vocabulary by rank-synchronous array merging.

Texts become pre-tokens: a run of word-start marks with the characters up to the next mark, or a line break. No piece
of the vocabulary spans two of them, which is checked when it is loaded, so their counts add up. The pre-tokens that a
worker has not met yet are held as one ragged numpy array of symbols; in each step every sequence applies its
lowest-rank pair at once, and symbols that survive are counted. Long pre-tokens, as texts without spaces have, are linked
arrays instead, whose places wait in an agenda by rank: a step takes the places of the lowest rank of all, which is the
lowest of each sequence that has it, so the work grows with the number of merges and not with their product with the
length. Characters outside the vocabulary count as their UTF-8 bytes, as byte fallback does.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import CACHE_WORDS, PairTable, arrow_schema, batch_of, map_arrow, slices

#: Fixed values of the vocabulary's format: the mark of a space, and the kinds of pieces that text can become.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: A pre-token.
PRETOKEN = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
FAR = np.iinfo(np.int64).max
#: Characters from which a pre-token is long; such ones are not cached.
LONG = 200


class PieceCounter:
    """Counts the tokens of texts as the vocabulary's own library does, without begin, end or other special tokens."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        crossing = [p.piece for p in model.pieces if p.type == NORMAL and len(PRETOKEN.findall(p.piece)) > 1]
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or kinds & {USER, UNUSED} or crossing:
            raise ValueError(f"{path}: not a byte-fallback pair vocabulary without normalisation")
        del SentencePieceProcessor
        pieces = {p.piece: (-p.score, i) for i, p in enumerate(model.pieces) if p.type == NORMAL}
        order = {piece: rank for rank, piece in enumerate(sorted(pieces, key=lambda x: pieces[x]))}
        self.symbols = np.full(0x110000, -1, np.int32)
        for piece, (_, i) in pieces.items():
            if len(piece) == 1:
                self.symbols[ord(piece)] = i
        # Equal scores are taken leftmost first, whatever the pair: such pieces share a rank.
        ranks, last, rank = {}, None, -1
        for piece in order:
            rank += pieces[piece][0] != last
            last = pieces[piece][0]
            ranks[piece] = rank
        pairs = {}
        for piece, (_, i) in pieces.items():
            for cut in range(1, len(piece)):
                a, b = pieces.get(piece[:cut]), pieces.get(piece[cut:])
                if a and b:
                    pairs[a[1], b[1]] = (ranks[piece], i)
        self.table = PairTable(pairs)
        # A merge can be done at all places of a sequence at once if what it makes only takes part in later merges.
        made = {}
        for (a, b), (r, i) in pairs.items():
            for part in (a, b):
                made[part] = min(made.get(part, r), r)
        self.at_once = np.zeros(len(model.pieces), bool)
        for piece, (_, i) in pieces.items():
            self.at_once[i] = made.get(i, 1 << 30) > ranks[piece]
        self.cache: dict[str, int] = {}

    def symbols_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols of pre-tokens (-1: outside the vocabulary), their owners, and each owner's bytes of the symbols
        outside beyond the first."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.symbols[points]
        owner = np.repeat(np.arange(len(words)), lengths)
        unknown = sym < 0
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        return sym, owner, np.bincount(owner[unknown], width[unknown] - 1, len(words)).astype(np.int64)

    def count_long(self, words: list[str]) -> np.ndarray:
        """The number of tokens of each long pre-token."""
        sym, owner, counts = self.symbols_of(words)
        n = len(sym)
        counts += np.bincount(owner, minlength=len(words))
        edge = owner[1:] != owner[:-1]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[-1:] = -1
        after[:-1][edge], before[1:][edge] = -1, -1
        rank, into = np.full(n, PairTable.MISS, np.int32), np.full(n, -1, np.int32)
        agenda: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def wait(at: np.ndarray) -> None:
            """Put places, whose pairs may be new, into the agenda."""
            nxt = after[at]
            found = self.table.find(sym[at], sym[nxt])
            rank[at] = np.where(nxt < 0, PairTable.MISS, self.table.rank[found])
            into[at] = self.table.merged[found]
            at = at[rank[at] < PairTable.MISS]
            at = at[np.argsort(rank[at], kind="stable")]
            ranks = rank[at]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, places in zip(ranks[np.r_[0, cuts]].tolist() if len(at) else (), np.split(at, cuts), strict=len(at) > 0):
                if r not in agenda:
                    agenda[r] = []
                    heapq.heappush(queue, r)
                agenda[r].append(places)

        wait(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            places = agenda.pop(r)
            at = places[0] if len(places) == 1 else np.unique(np.concatenate(places))
            at = at[rank[at] == r]
            if not len(at):
                continue
            # Of overlapping places, as in a run of one symbol, every second is taken from the left.
            index = np.arange(len(at))
            begin = np.maximum.accumulate(np.where(np.r_[True, at[1:] != after[at[:-1]]], index, 0))
            every, at = at, at[(index - begin) & 1 == 0]
            made = into[at]
            if not self.at_once[made].all():
                # What a place makes may merge again before the places to its right: they wait until it is known.
                left, right = before[at], after[after[at]]
                touching = np.r_[False, left[1:] == at[:-1]]
                beside = np.where(touching, np.r_[0, made[:-1]], sym[left])
                low = (left >= 0) & (self.table.rank[self.table.find(beside, made)] <= r)
                low |= (right >= 0) & (self.table.rank[self.table.find(made, sym[right])] <= r)
                if low.any():
                    stop = int(low.argmax()) + 1
                    at, made = at[:stop], made[:stop]
                    if every[-1] > at[-1]:
                        agenda[r] = [every[every > at[-1]]]
                        heapq.heappush(queue, r)
            gone = after[at]
            sym[at] = made
            rank[gone] = PairTable.MISS
            following = after[gone]
            after[at] = following
            before[following[following >= 0]] = at[following >= 0]
            np.subtract.at(counts, owner[at], 1)
            left = before[at]
            wait(np.unique(np.r_[at, left[left >= 0]]))
        return counts

    def count_sequences(self, words: list[str]) -> np.ndarray:
        """The number of tokens of each pre-token."""
        sym, owner, counts = self.symbols_of(words)
        while len(sym) > 1:
            at = self.table.find(sym[:-1], sym[1:])
            rank = self.table.rank[at].astype(np.int64)
            rank[owner[1:] != owner[:-1]] = PairTable.MISS
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            key = np.append((rank << 32) | np.arange(len(rank)), FAR)
            best = np.minimum.reduceat(key, starts)
            live = (best >> 32) < PairTable.MISS
            if not live.any():
                break
            # Sequences without a pair left are finished: their symbols are counted and taken out.
            size = np.diff(np.append(starts, len(sym)))
            np.add.at(counts, owner[starts[~live]], size[~live])
            first = best[live] & 0xFFFFFFFF
            chosen = np.zeros(len(sym), bool)
            chosen[first] = True
            merged_first = self.table.merged[at[first]]
            wide = self.at_once[merged_first]
            if wide.any():
                target = np.repeat(np.where(live, np.where(live, best >> 32, -1), -1), size)
                allowed = np.zeros(len(live), bool)
                allowed[np.flatnonzero(live)[wide]] = True
                same = np.append(rank, -1) == target
                same &= np.repeat(allowed, size)
                # The same rank means the same pair, but for pieces of equal score and pairs that make one piece.
                lead = np.zeros(len(live), np.int64)
                lead[live] = first
                lead = np.repeat(lead, size)
                same[:-1] &= (sym[:-1] == sym[lead[:-1]]) & (sym[1:] == sym[np.minimum(lead[:-1] + 1, len(sym) - 1)])
                chosen |= same
                # Of overlapping places, as in a run of one symbol, every second is taken from the left.
                run = chosen & np.r_[False, chosen[:-1]]
                if run.any():
                    index = np.arange(len(sym))
                    begin = np.maximum.accumulate(np.where(chosen & ~run, index, -1))
                    chosen &= ((index - begin) & 1) == 0
            where = np.flatnonzero(chosen)
            sym[where] = self.table.merged[at[where]]
            keep = np.repeat(live, size)
            keep[where + 1] = False
            sym, owner = sym[keep], owner[keep]
        np.add.at(counts, owner, 1)
        return counts

    def pretokens(self, text: str) -> list[str]:
        return PRETOKEN.findall(MARK + text.replace(" ", MARK)) if text else []

    def counts(self, texts: Iterable[str]) -> list[int]:
        split = [self.pretokens(x) for x in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = list(set().union(*split).difference(self.cache)) if split else []
        long = [w for w in new if len(w) >= LONG]
        if long:
            new = [w for w in new if len(w) < LONG]
        self.cache.update(zip(new, self.count_sequences(new).tolist(), strict=True) if new else ())
        if not long:
            get = self.cache.__getitem__
            return [sum(map(get, words)) for words in split]
        own = dict(zip(long, self.count_long(long).tolist(), strict=True))
        return [sum(own[w] if len(w) >= LONG else self.cache[w] for w in words) for words in split]


@lru_cache(1)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row of ``docs`` (doc_id, text); a map over rows, without a shuffle.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids are kept, one row out for each in. Very
    long texts are counted whole, in linear memory. Other columns of ``docs``, whatever their names, are not read.
    """
    schema = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).counts
        for batch in batches:
            for part in slices(batch):
                texts = [x or "" for x in part.column("text").to_pylist()]
                n = np.array(count(texts), np.int64)
                size = np.fromiter((len(x.encode("utf-8", "surrogatepass")) for x in texts), np.int64, len(texts))
                yield batch_of(schema, [part.column("doc_id"), size, n, n > limit])

    return map_arrow(docs.select("doc_id", "text"), run, SCHEMA)
