"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's vector is the mean of the embeddings of its hashed character n-grams, and a linear softmax over that mean
gives the language. Both are trained together by stochastic gradient descent in numpy, on a bounded sample of texts per
language. For prediction the embedding and the softmax are multiplied out: the mean of one row of logits per n-gram is
the same number, so a text costs one gather per n-gram. A temperature fitted on texts that training left out calibrates
the probabilities, and the lowest calibrated score that keeps the wanted share of those texts is the rejection
threshold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SAMPLE_BYTES, arrow_schema, batch_of, fetched_texts, map_arrow, slices

SCHEMA = "doc_id bigint, lang_pred string, score double, rejected boolean"
#: What a text without a letter is.
UNDETERMINED = "und"
#: Hash buckets, embedding size, n-gram sizes in bytes.
BUCKETS, SIZE, GRAMS = 1 << 16, 16, (2, 3, 4)


#: Runs of letters (and numerals, which `prepared` sorts out).
WORDS = re.compile(r"[^\W\d_]+").findall


def grams(data: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the n-grams that begin at each byte, one array for each size."""
    wide = data.astype(np.uint64)
    for n in GRAMS:
        if len(wide) < n:
            continue
        key = np.full(len(wide) - n + 1, n, np.uint64)
        for k in range(n):
            key = (key << np.uint64(8)) | wide[k : len(wide) - n + 1 + k]
        yield ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def prepared(text: str) -> bytes:
    """Lower case, with every run of other characters than letters as one space; empty if there is no letter."""
    words = WORDS(text.lower())
    if words and not words[0].isalpha():  # numerals such as superscripts are word characters, but no letters
        words = [x for x in ("".join(filter(str.isalpha, w)) for w in words) if x]
    return f" {' '.join(words)} ".encode("utf-8", "surrogatepass") if words else b""


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


@dataclass
class LanguageModel:
    """``logits``: a row of logits per bucket; ``threshold``: scores below it are rejected."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def scores(self, data: Sequence[bytes]) -> np.ndarray:
        """Calibrated probabilities of each prepared text, which has to have a letter."""
        joined = np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum([len(x) for x in data])
        starts = np.r_[0, ends[:-1]]
        total, count = np.zeros((len(data), len(self.languages))), np.zeros(len(data))
        for n, bucket in zip(GRAMS, grams(joined), strict=False):
            # n-grams that span two texts are left out: of each text only the places up to its end minus n count.
            a, b = np.minimum(starts, len(bucket)), np.clip(ends - n + 1, 0, len(bucket))
            b = np.maximum(a, b)
            for k in range(len(self.languages)):
                sums = np.r_[0.0, np.cumsum(self.logits[bucket, k], dtype=np.float64)]
                total[:, k] += sums[b] - sums[a]
            count += b - a
        z = total / np.maximum(count, 1)[:, None] + self.bias
        return softmax(z / self.temperature)


def train(texts: Sequence[str], languages: Sequence[str], epochs: int = 5, rate: float = 0.5, keep: float = 0.99, window: int = 300, batch: int = 16, seed: int = 7) -> LanguageModel:
    """Fit on labelled texts. Windows of ``window`` bytes cover the whole of each text and are the examples, so short inputs
    are met in training.

    Gradient steps take ``batch`` examples at once. Texts without a letter are left out. Without any example there is no
    language, and every text is undetermined.
    """
    names = sorted(set(languages))
    rng = np.random.default_rng(seed)
    examples: list[tuple[np.ndarray, int, bool]] = []
    for i, (text, lang) in enumerate(zip(texts, languages, strict=True)):
        data = prepared(text)
        if not data:
            continue
        # The last window ends with the text, so it may overlap the one before.
        for start in sorted({*range(0, max(1, len(data) - window), window), max(0, len(data) - window)}):
            part = np.frombuffer(data[start : start + window], np.uint8)
            if len(part) >= max(GRAMS):
                examples.append((np.concatenate(list(grams(part))), names.index(lang), i % 5 == 0))
    if not examples:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    table = rng.normal(0, 0.1, (BUCKETS, SIZE))
    out, bias = np.zeros((SIZE, len(names))), np.zeros(len(names))
    fit = [x for x in examples if not x[2]] or examples
    held = [x for x in examples if x[2]] or examples
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(fit))
        for start in range(0, len(order), batch):
            part = [fit[k] for k in order[start : start + batch]]
            sizes = np.array([len(ids) for ids, _, _ in part])
            ids, starts = np.concatenate([ids for ids, _, _ in part]), np.cumsum(sizes) - sizes
            mean = np.add.reduceat(table[ids], starts) / sizes[:, None]
            error = softmax(mean @ out + bias)
            error[np.arange(len(part)), [y for _, y, _ in part]] -= 1
            back = error @ out.T
            out -= step * mean.T @ error
            bias -= step * 0.1 * error.sum(0)
            # Rows that several n-grams of the batch share get the sum of their steps.
            rows, place = np.unique(ids, return_inverse=True)
            each = np.repeat(back / sizes[:, None], sizes, axis=0)
            change = np.stack([np.bincount(place, each[:, k], len(rows)) for k in range(SIZE)], 1)
            table[rows] -= step * 4 * change
    model = LanguageModel(names, table @ out, bias)
    z = np.array([model.logits[ids].mean(0) + bias for ids, _, _ in held])
    y = np.array([y for _, y, _ in held])
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    model.threshold = float(np.quantile(softmax(z / model.temperature).max(1), 1 - keep))
    return model


def training_ids(docs: DataFrame, of: Column, per_language: int, most_languages: int) -> list[tuple[int, str]]:
    """Ids and languages of rows where ``of`` holds: the first ``per_language`` ids of each language by a hash.

    A first pass estimates each language's ids; the second drops those whose hash is too large to be among the first, so
    that about twice as many as wanted come to the driver. Of more than ``most_languages`` languages, those with the
    most ids are learned.
    """
    hashed = F.xxhash64("doc_id")
    ids = docs.where(of & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    counted = ids.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    share = F.least(F.lit(1.0), (2 * per_language + 100) / F.col("n"))
    found = ids.join(F.broadcast(counted), "lang").where((hashed / F.lit(2.0**64) + 0.5) <= share).select("lang", hashed.alias("h"), "doc_id").distinct()
    taken: dict[str, int] = {}
    out = []
    for r in sorted(found.collect()):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= per_language:
            out.append((r["doc_id"], r["lang"]))
    return out


def fit_languages(docs: DataFrame, of: Column, per_language: int = 300, sample_bytes: int = SAMPLE_BYTES, most_languages: int = 200, **options) -> LanguageModel:
    """Train on at most ``per_language`` texts of each language, of ``sample_bytes`` in all at most, in at most
    ``most_languages`` languages. An id with rows in several languages counts for each."""
    chosen = training_ids(docs, of, per_language, most_languages)
    ids = docs.sparkSession.createDataFrame(chosen, "doc_id bigint, lang string")
    rows = sorted(fetched_texts(docs.where(of & F.col("lang").isNotNull()), ids, sample_bytes, ("lang",)))
    return train([r[2] for r in rows], [r[1] for r in rows], **options)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of each row of ``docs`` (doc_id, text); a map over whole texts.

    Null texts, empty ones and those without a letter are ``und`` with score 0 and rejected. Others get a learned
    language, with its calibrated probability; ``rejected`` says that it is below the model's threshold. Ties go to the
    language that sorts first. Repeated rows and null ids are kept, one row out for each in; other columns are not read.
    """
    schema = arrow_schema(SCHEMA)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, limit=1_000_000):
                data = [prepared(x or "") for x in part.column("text").to_pylist()]
                if not model.languages:
                    data = [b""] * len(data)
                has = [i for i, x in enumerate(data) if x]
                names, best = [UNDETERMINED] * len(data), np.zeros(len(data))
                if has:
                    p = model.scores([data[i] for i in has])
                    best[has] = p.max(1)
                    for i, k in zip(has, p.argmax(1).tolist(), strict=True):
                        names[i] = model.languages[k]
                yield batch_of(schema, [part.column("doc_id"), names, best, best < max(model.threshold, 1e-300)])

    return map_arrow(docs.select("doc_id", "text"), run, SCHEMA)
