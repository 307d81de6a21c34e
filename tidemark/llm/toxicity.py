"""Toxicity: a support vector machine on a subsequence string kernel, with Nystroem landmarks.

A unit is a word in lower case without its punctuation, or a run of single characters joined ("i d i o t"); long words
become overlapping windows. The kernel of two units counts the subsequences of three symbols that they share, each
weighted by ``DECAY`` to the power of the span it covers in either, and is normalised: inserted characters and gaps
cost some weight but not the match. Landmarks are units that toxic texts have far more often than others, and units of
clean texts; kernels to them, whitened by the landmarks' own kernel matrix, are the features of a linear support vector
machine. Labels belong to whole texts, so training alternates: toxic texts' most toxic units are the positive examples
of the next round. A text scores by its most toxic unit, through a logistic curve fitted on training texts.

The kernel is evaluated by its explicit feature map (one coordinate for each triple of symbols). As the machine is
linear in it, the landmarks' weights add up to one weight per coordinate for scoring, which gives the same number as
the sum over landmarks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, SAMPLE_BYTES, arrow_schema, batch_of, fetched_texts, map_arrow, sampled_ids, slices

SCHEMA = "doc_id bigint, score double, predicted int"
#: Weight of a symbol of span, longest span of a subsequence, longest unit and step of the windows of longer words.
DECAY, SPAN, LONGEST, STEP = 0.6, 8, 24, 12
#: Symbols: 26 letters, 13 classes that other characters fall into, and the mark of either end of a unit.
ALPHABET = 40
END = 39
DIMENSIONS = ALPHABET**3
#: Units by which near copies among the training texts are told: the longest of a text.
MARKS = 24


def units_of(words: Sequence[str]) -> list[str]:
    """Units of a text's words, in lower case. Runs of single characters are joined into a unit of their own."""
    out, run = [], []
    for w in words:
        core = w if w.isalnum() else "".join(filter(str.isalnum, w))
        if len(core) == 1:
            run.append(core)
            continue
        if len(run) > 2:
            out.append("".join(run))
        run = []
        if core:
            out.append(core)
    if len(run) > 2:
        out.append("".join(run))
    return out


def windows(unit: str) -> list[str]:
    if len(unit) <= LONGEST:
        return [unit]
    return [unit[i : i + LONGEST] for i in range(0, len(unit) - LONGEST + STEP, STEP)]


def triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the subsequences of a unit with that length, and their weights."""
    found = [(i, j, k) for i in range(length) for j, k in combinations(range(i + 1, min(length, i + SPAN)), 2)]
    places = np.array(found, np.int64).reshape(-1, 3)
    return places, DECAY ** (places[:, 2] - places[:, 0] + 1 if len(places) else np.zeros(0))


_TRIPLES = [triples(n) for n in range(LONGEST + 3)]


def features(units: Sequence[str], cells: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For units of each length: their positions, the coordinates of their subsequences, and each one's weight over
    the length of the unit's whole feature vector. Units have at most LONGEST characters."""
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    for n in np.unique(lengths).tolist():
        places, weight = _TRIPLES[n + 2]
        if not n:
            continue
        every = np.flatnonzero(lengths == n)
        for start in range(0, len(every), step := max(1, cells // len(places))):
            at = every[start : start + step]
            chars = np.frombuffer("".join(units[i] for i in at.tolist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.int32)
            sym = np.full((len(at), n + 2), END)
            sym[:, 1:-1] = np.where((chars >= 97) & (chars <= 122), chars - 97, 26 + chars % 13)
            code = (sym[:, places[:, 0]] * ALPHABET + sym[:, places[:, 1]]) * ALPHABET + sym[:, places[:, 2]]
            # The norm: equal coordinates of a unit add up before they are squared.
            order = np.argsort(code, 1, kind="stable")
            ranked, each = np.take_along_axis(code, order, 1), weight[order]
            new = np.c_[np.ones(len(at), bool), ranked[:, 1:] != ranked[:, :-1]]
            sums = np.add.reduceat(each.ravel(), np.flatnonzero(new.ravel()))
            owner = np.nonzero(new)[0]
            norm = np.sqrt(np.bincount(owner, sums**2, len(at)))
            yield at, code, weight[None, :] / norm[:, None]


def feature_matrix(units: Sequence[str]):
    """Rows of normalised features, as a dense matrix: for landmarks and training units only."""
    out = np.zeros((len(units), DIMENSIONS), np.float32)
    for at, code, weight in features(units):
        np.add.at(out, (np.repeat(at, code.shape[1]), code.ravel()), weight.ravel())
    return out


@dataclass
class ToxicityModel:
    """``weights``: the machine's normal in the kernel's feature space; ``slope`` and ``middle``: of the logistic curve."""

    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    middle: float = 0.0
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def margins(self, units: Sequence[str]) -> np.ndarray:
        """The machine's margin of each unit; an empty unit has the bias alone."""
        flat, owner = [], []
        for i, u in enumerate(units):
            for w in windows(u):
                flat.append(w)
                owner.append(i)
        got = np.full(len(flat), self.bias)
        for at, code, weight in features(flat):
            got[at] = self.bias + (self.weights[code] * weight).sum(1)
        out = np.full(len(units), -np.inf)
        np.maximum.at(out, np.array(owner, np.int64), got)
        return out

    def text_margins(self, texts: Sequence[str]) -> list[float]:
        """The largest margin of each text's units, or the bias if there is none."""
        split = [set(units_of(x.lower().split())) for x in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = list(set().union(*split).difference(self.cache))
        self.cache.update(zip(new, self.margins(new).tolist(), strict=True))
        get = self.cache.__getitem__
        return [max(map(get, s), default=self.bias) for s in split]

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(-self.slope * (margin - self.middle), -500, 500)))


def machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-4, steps: int = 30) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge loss) by Newton's method on its primal form."""
    x = np.c_[x, np.ones(len(x))]
    w, total = np.zeros(x.shape[1]), cost.sum()
    inside = np.ones(len(y), bool)
    for _ in range(steps):
        part, c = x[inside], cost[inside] / total
        w = np.linalg.solve((part * c[:, None]).T @ part + ridge * np.eye(x.shape[1]), part.T @ (c * y[inside]))
        now = y * (x @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w[:-1], float(w[-1])


def originals(bags: Sequence[Sequence[str]]) -> list[int]:
    """Positions of the bags that are no near copies of an earlier one: fewer than half of their ``MARKS`` longest units,
    which chance seldom repeats, are among those of any earlier bag that was kept."""
    seen: dict[str, list[int]] = {}
    out = []
    for k, bag in enumerate(bags):
        marks = sorted(bag, key=lambda u: (-len(u), u))[:MARKS]
        shared = Counter(m for u in marks for m in seen.get(u, ()))
        if len(marks) >= 8 and shared and shared.most_common(1)[0][1] >= len(marks) / 2:
            continue
        for u in marks:
            seen.setdefault(u, []).append(k)
        out.append(k)
    return out


def pieces(unit: str, size: int = 4) -> set[str]:
    unit = f"^{unit}$"
    return {unit[k : k + size] for k in range(len(unit) - size + 1)}


def train(texts: Sequence[str], toxic: Sequence[int], prior: float | None = None, landmarks: int = 320, clean_units: int = 8000, rounds: int = 3, seed: int = 11) -> ToxicityModel:
    """Fit on labelled texts. With one class only, or without units, the score of every text is the share of label 1.

    Near copies of a text count once, so their chance words do not look telling. Of the texts, a third fits the logistic
    curve alone; ``prior`` is the share of label 1 that it assumes (the sample's own by default).
    """
    rng = np.random.default_rng(seed)
    bags = [sorted({w for u in set(units_of(x.lower().split())) for w in windows(u) if len(w) > 2}) for x in texts]
    kept = originals(bags)
    bags, y = [bags[k] for k in kept], np.array([toxic[k] for k in kept], np.int64)
    prior = float(np.clip(y.mean() if prior is None and len(y) else prior or 0, 1e-3, 1 - 1e-3))
    constant = ToxicityModel(np.zeros(DIMENSIONS), 0.0, 1.0, float(np.log(1 / prior - 1)))
    held = np.arange(len(y)) % 3 == 0
    bad, good = ([b for b, t, h in zip(bags, y, held, strict=True) if t == v and not h] for v in (1, 0))
    if not bad or not good:
        return constant
    counts_bad, counts_good = Counter(u for b in bad for u in b), Counter(u for b in good for u in b)
    share = len(bad) / (len(bad) + len(good))

    def ratio(a: int, b: int) -> float:
        """How much more often toxic texts have something than chance allows: a likelihood ratio."""
        if a < 2 or a / len(bad) <= 8 * b / len(good):
            return 0.0
        return 2 * (a * np.log(a / ((a + b) * share)) + (b * np.log(b / ((a + b) * (1 - share))) if b else 0))

    # Units can be rare one by one and yet alike: what tells is a part that many of them share.
    parts_bad, parts_good = (Counter(q for b in group for q in set().union(*map(pieces, b))) for group in (bad, good))
    odds = {u: max(ratio(n, counts_good[u]), 0.0 if counts_good[u] else max(ratio(parts_bad[q], parts_good[q]) for q in pieces(u))) for u, n in counts_bad.items()}
    bound = 2 * np.log(max(10, len(parts_bad))) + 2
    telling = sorted((u for u, r in odds.items() if r > bound), key=lambda u: (-odds[u], u))
    clean = sorted(counts_good)
    if not telling or not clean:
        return constant
    # Of telling units, those least like the landmarks chosen before come first, so that every family has one.
    pool = feature_matrix(telling[:landmarks])
    picked, nearest = [0], pool @ pool[0]
    while len(picked) < min(landmarks // 2, len(pool)) and nearest.min() < 0.99:
        picked.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, pool @ pool[picked[-1]])
    common = [u for u, _ in counts_good.most_common(clean_units // 4)]
    negative = sorted({*common, *rng.choice(clean, min(len(clean), clean_units), replace=False).tolist()})
    # The other landmarks are clean units: those most like the telling ones, and some at random.
    like = ToxicityModel(pool[picked].sum(0).astype(np.float64)).margins(clean)
    close = [clean[k] for k in np.argsort(-like)[: landmarks // 3] if clean[k] not in telling]
    marks = [telling[k] for k in picked] + close + [negative[k] for k in rng.permutation(len(negative))[: landmarks // 4]]
    del pool
    marks = list(dict.fromkeys(marks))
    columns = np.ascontiguousarray(feature_matrix(marks).T)
    values, vectors = np.linalg.eigh((columns.T @ columns).astype(np.float64))
    whiten = vectors[:, values > 1e-4] / np.sqrt(values[values > 1e-4])

    def mapped(units: Sequence[str]) -> np.ndarray:
        """Nystroem features: kernels to the landmarks, whitened."""
        kernel = np.zeros((len(units), len(marks)))
        for at, code, weight in features(units, 20_000):
            kernel[at] = np.einsum("nt,ntm->nm", weight.astype(np.float32), columns[code])
        return kernel @ whiten

    model, positive = ToxicityModel(np.zeros(DIMENSIONS)), dict.fromkeys(telling, 1.0)
    for _ in range(rounds):
        x = np.concatenate([mapped(list(positive)), mapped(negative)])
        sign = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
        cost = np.r_[np.array(list(positive.values())) * len(negative) / sum(positive.values()) * 0.5, np.ones(len(negative))]
        w, model.bias = machine(x, sign, cost)
        model.weights = (columns @ (whiten @ w).astype(np.float32)).astype(np.float64)
        every = sorted(counts_bad)
        margin = dict(zip(every, model.margins(every).tolist(), strict=True))
        # The most toxic units of each toxic text, weighted by the texts that they occur in; telling ones stay.
        tops = Counter(u for b in bad for u in sorted(b, key=margin.get)[-3:] if margin[u] > 0.5 and not counts_good[u])
        positive = {u: float(np.sqrt(max(tops[u], counts_bad[u]))) for u in {*tops, *telling}}
        # The clean units that look most toxic are examples of the next round too.
        seen = model.margins(clean)
        negative = sorted({*negative, *(clean[k] for k in np.argsort(-seen)[:1500])} - positive.keys())
    top = np.array([max(model.margins(b).tolist(), default=model.bias) if b else model.bias for b, h in zip(bags, held, strict=True) if h])
    y = y[held]
    weight = np.where(y > 0, prior / max(1, (y > 0).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    model.slope, model.middle = logistic(top, y, weight)
    return model


def logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and middle of the likeliest logistic curve, with each text's weight."""
    scale = max(margin.std(), 1e-6)
    best = (np.inf, 1.0, 0.0)
    for middle in np.linspace(margin.min() - 0.1, margin.max() + 0.1, 120).tolist():
        for slope in np.geomspace(0.5, 30, 14) / scale:
            z = np.clip(slope * (margin - middle), -30, 30)
            best = min(best, (float((weight * (np.logaddexp(0, z) - y * z)).sum()), float(slope), middle))
    return best[1], best[2]


def labelled_ids(labels: DataFrame, of: Column, per_class: int) -> DataFrame:
    """``doc_id, toxic`` of rows where ``of`` holds: the ``per_class`` first ids of label 1 by their hash, and twice as many of
    label 0. An id with both labels counts for both."""
    labels = labels.where(of & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    parts = [sampled_ids(labels.where(F.col("toxic") == value), per_class * (2 - value)).withColumn("toxic", F.lit(value)) for value in (0, 1)]
    return parts[0].unionByName(parts[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, of: Column, per_class: int = 1200, sample_bytes: int = SAMPLE_BYTES, **options) -> ToxicityModel:
    """Train on at most ``per_class`` texts of label 1 and twice as many of label 0, of ``sample_bytes`` in all at most."""
    rows = sorted(fetched_texts(docs, labelled_ids(labels, of, per_class), sample_bytes, ("toxic",)))
    of_class = dict(labels.where(of & F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect())
    prior = of_class.get(1, 0) / max(1, sum(of_class.values()))
    return train([r[2] for r in rows], [int(r[1]) for r in rows], prior, **options)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score, predicted`` of each row of ``docs`` (doc_id, text); a map over whole texts, without a shuffle.

    Null and empty texts have no unit and get the score of the machine's bias alone. Repeated rows and null ids are
    kept, one row out for each in. Long words are scored in overlapping windows. Other columns are not read.
    """
    schema = arrow_schema(SCHEMA)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                margin = model.text_margins([x or "" for x in part.column("text").to_pylist()])
                score = model.probability(np.array(margin, np.float64))
                yield batch_of(schema, [part.column("doc_id"), score, (score >= 0.5).astype(np.int32)])

    return map_arrow(docs.select("doc_id", "text"), run, SCHEMA)
