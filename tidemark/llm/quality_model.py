"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Documents with the same votes are alike to
the label model, so it works on the counts of vote patterns over the whole corpus: expectation-maximisation estimates
how often each labellers votes what for good and for bad documents, and what follows for each pattern. The posterior
labels of a bounded sample train a linear scorer on hashed features (words, and pairs of neighbouring word shapes), which
then scores every document, also those that the labellers say nothing about.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHE_WORDS, SAMPLE_BYTES, arrow_schema, batch_of, fetched_texts, map_arrow, sampled_ids, slices

#: Buckets of hashed words and of hashed shape pairs, and of shapes themselves.
WORD_BUCKETS, PAIR_BUCKETS, SHAPES = 1 << 13, 1 << 14, 1 << 10
#: Words of a block in which repeated words are counted.
BLOCK = 2000
#: Votes.
NOTHING, BAD, GOOD = 0, 1, 2


_NOISE = re.compile(r"[#*$%&<>~^|]+").findall
_SYMBOLS = re.compile(r"[^\w\s.,;:'()-]").findall
_BARS = re.compile(r"\s[|»›]\s").findall
_SENTENCE_ENDS = re.compile(r"[^!?.][.?](?:\s|$)").findall


def capitals(text: str) -> tuple[int, int]:
    """How many capitals and how many letters with two cases a text has."""
    points = lambda s: np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    low, up = text.lower(), text.upper()
    if len(low) != len(text) or len(up) != len(text):  # some letters change their length with their case
        return sum(map(str.isupper, text)), sum(c.lower() != c.upper() for c in text)
    a, b, c = points(text), points(low), points(up)
    return int((a != b).sum()), int((b != c).sum())


def votes(text: str | None) -> str:
    """Each labeller's vote on a text, as a string of digits; all of them abstain where they have too little to go by.

    The labellers, in order: noise characters by word, symbols by character, capitals by letter, double bangs by word,
    words that repeat the one before, words that occurred before in their block of ``BLOCK`` words (which makes long texts
    comparable with short ones), bars between words, sentence ends by word.
    """
    text = text or ""
    words = text.split()
    n = len(words)
    if n < 5:
        return str(NOTHING) * 8
    upper, letters = capitals(text)
    shares = (
        (len(_NOISE(text)) / n, 0.15, 0.03, True),
        (len(_SYMBOLS(text)) / len(text), 0.06, 0.01, True),
        (upper / max(1, letters), 0.5, 0.2, True),
        (text.count("!!") / n, 0.1, 0.01, True),
        (sum(map(str.__eq__, words, words[1:])) / n, 0.2, 0.03, True),
        (1 - sum(len(set(words[k : k + BLOCK])) for k in range(0, n, BLOCK)) / n, 0.9, 0.6, True),
        (len(_BARS(text)) / n, 0.1, 0.01, True),
        (1 - 10 * len(_SENTENCE_ENDS(text)) / n, 0.99, 0.9, n >= 30),
    )
    return "".join(str(NOTHING if not enough else BAD if x > bad else GOOD if x <= good else NOTHING) for x, bad, good, enough in shares)


def voted(docs: DataFrame) -> DataFrame:
    """``votes`` of each row of ``docs`` (text) that has a text."""
    schema = arrow_schema("votes string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(schema, [[votes(x) for x in batch.column("text").to_pylist()]])

    return map_arrow(docs.where(F.col("text").isNotNull()).select("text"), run, "votes string")


@dataclass
class LabelModel:
    """``table[labeller, class, vote]``: probabilities of votes; ``prior``: share of good documents."""

    table: np.ndarray
    prior: float

    def posterior(self, patterns: Sequence[str]) -> np.ndarray:
        """The probability that a document with these votes is good."""
        if not len(patterns):
            return np.zeros(0)
        v = np.array([[int(c) for c in p] for p in patterns])
        logs = np.log(self.table)[np.arange(v.shape[1])[None, :], :, v].sum(1)
        z = logs[:, 1] - logs[:, 0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_labels(patterns: Sequence[str], counts: Sequence[int], steps: int = 2000) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts, begun at the majority of the votes.

    Labellers that abstain say nothing: abstaining has the same probability in both classes. Without patterns, every
    document is as likely good as bad.
    """
    if not len(patterns):
        return LabelModel(np.full((1, 2, 3), 1 / 3), 0.5)
    v, n = np.array([[int(c) for c in p] for p in patterns]), np.array(counts, np.float64)
    bad, good = (v == BAD).sum(1), (v == GOOD).sum(1)
    # One bad vote weighs as much as several good ones to begin with: most texts are good in most respects.
    q = np.where(bad + good == 0, 0.5, (good + 0.5) / (good + 4 * bad + 1))
    model = LabelModel(np.ones((v.shape[1], 2, 3)) / 3, 0.5)
    for _ in range(steps):
        weight = np.stack([n * (1 - q), n * q], 1)
        table = np.stack([np.stack([(weight * (v == k)[:, [j]]).sum(0) for k in range(3)], 1) for j in range(v.shape[1])])
        idle = table[:, :, NOTHING].sum(1) / table.sum((1, 2))
        speaking = table[:, :, 1:] + 1.0
        speaking /= speaking.sum(2, keepdims=True)
        table = np.concatenate([np.repeat(idle[:, None, None], 2, 1), speaking * (1 - idle)[:, None, None]], 2)
        model = LabelModel(np.clip(table, 1e-9, 1), float(np.clip((n * q).sum() / n.sum(), 0.02, 0.98)))
        new = model.posterior(patterns)
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    return model


_RUNS = re.compile(r"[^\W\d_]+|\d+|(.)\1*", re.S)


def shape(word: str) -> str:
    """A word's make-up: runs of capitals, of small letters and of digits as one sign each, others as they are, once."""
    out = []
    for m in _RUNS.finditer(word):
        run = m.group()
        if run[0].isdigit():
            out.append("0")
        elif run[0].isalpha():
            out.append("A" if run.isupper() and len(run) > 1 else "Aa" if run[0].isupper() else "a")
        else:
            out.append(run[:2])
    return "".join(out)[:12]


@dataclass
class QualityScorer:
    """Logistic regression on the mean of hashed features."""

    words: np.ndarray
    pairs: np.ndarray
    bias: float
    cache: dict[str, int] = field(default_factory=dict, repr=False)

    def _code(self, word: str) -> int:
        return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) << 10 | zlib.crc32(shape(word).encode("utf-8", "surrogatepass")) % SHAPES

    def features(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word buckets and pair buckets of all tokens, and each text's number of tokens."""
        split = [x.split() for x in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        for w in set().union(*split).difference(self.cache):
            self.cache[w] = self._code(w)
        sizes = np.array([len(s) for s in split], np.int64)
        get = self.cache.__getitem__
        code = np.fromiter((get(w) for s in split for w in s), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(split)), sizes)
        word, kind = code >> 10, code & (SHAPES - 1)
        before = np.r_[np.full(min(1, len(code)), -1), np.where(owner[1:] == owner[:-1], kind[:-1], -1)]
        same = np.r_[np.zeros(min(1, len(code)), bool), (owner[1:] == owner[:-1]) & (word[1:] == word[:-1])]
        pair = ((before + 1) * 2654435761 + kind * 40503 + same * 7919) % 4294967291 % PAIR_BUCKETS
        return word % WORD_BUCKETS, pair, sizes

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        """The probability that each text is good; texts without a word have the bias alone."""
        word, pair, sizes = self.features(texts)
        sums = np.r_[0.0, np.cumsum(self.words[word] + self.pairs[pair])]
        ends = np.cumsum(sizes)
        z = self.bias + (sums[ends] - sums[ends - sizes]) / np.maximum(sizes, 1)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_scorer(texts: Sequence[str], target: Sequence[float], epochs: int = 25, rate: float = 4.0, ridge: float = 1e-5, seed: int = 1) -> QualityScorer:
    """Fit to soft labels by gradient steps with a scale for each weight. Without texts, every score is one half."""
    scorer = QualityScorer(np.zeros(WORD_BUCKETS), np.zeros(PAIR_BUCKETS), 0.0)
    y = np.array(target, np.float64)
    if not len(y):
        return scorer
    word, pair, sizes = scorer.features(texts)
    ends = np.cumsum(sizes)
    rng = np.random.default_rng(seed)
    seen_w, seen_p, seen_b = np.full(WORD_BUCKETS, 1e-6), np.full(PAIR_BUCKETS, 1e-6), 1e-6
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            at = np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in part])
            row = np.repeat(np.arange(len(part)), sizes[part])
            share = 1 / np.maximum(sizes[part], 1)
            z = scorer.bias + np.bincount(row, scorer.words[word[at]] + scorer.pairs[pair[at]], len(part)) * share
            error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[part]) / len(part)
            each = (error * share)[row]
            gw, gp, gb = np.bincount(word[at], each, WORD_BUCKETS) + ridge * scorer.words, np.bincount(pair[at], each, PAIR_BUCKETS) + ridge * scorer.pairs, error.sum()
            seen_w, seen_p, seen_b = seen_w + gw * gw, seen_p + gp * gp, seen_b + gb * gb
            scorer.words -= rate * 0.05 * gw / np.sqrt(seen_w)
            scorer.pairs -= rate * gp / np.sqrt(seen_p)
            scorer.bias -= rate * 0.1 * gb / np.sqrt(seen_b)
    scorer.cache.clear()
    return scorer


def fit_quality(docs: DataFrame, sample: int = 3000, sample_bytes: int = SAMPLE_BYTES) -> QualityScorer:
    """Fit labels on the vote patterns of all documents, and the scorer on at most ``sample`` of them, the first by a hash of
    the id, and at most ``sample_bytes`` of text.

    Patterns are at most three to the power of the labellers, so their counts are small, whatever the corpus.
    """
    counts = voted(docs).groupBy("votes").agg(F.count("*").alias("n")).toPandas().sort_values("votes")
    model = fit_labels(counts["votes"].tolist(), counts["n"].tolist())
    rows = fetched_texts(docs, sampled_ids(docs.where(F.col("text").isNotNull()), sample), sample_bytes)
    texts = [text for _, text in sorted(rows)]
    return fit_scorer(texts, model.posterior([votes(x) for x in texts]))


def score_quality(docs: DataFrame, scorer: QualityScorer, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``quality_score`` (0 to 1, higher: better) and ``accepted`` (at least ``threshold``) after its columns.

    Null, empty and wordless texts get the bias's score and are not accepted. Repeated rows are scored alike, long texts
    whole; a column of ``docs`` with an added name is replaced. A map over rows, without a shuffle.
    """
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in {"quality_score", "accepted"}))
    out = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for batch in batches:
            for part in slices(batch, text):
                texts = [x or "" for x in part.column(at).to_pylist()]
                score = scorer.scores(texts)
                good = (score >= threshold) & np.fromiter(map(bool, map(str.strip, texts)), bool, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array(good)], names=[*part.schema.names, "quality_score", "accepted"])

    return map_arrow(docs, run, out)
