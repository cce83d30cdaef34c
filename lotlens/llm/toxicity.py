"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

P(grade >= k) = sigmoid(w . x - t_k) for ordered thresholds t_1 < t_2 < t_3 that share the weights w. The features are
whole words and words' beginnings (3 to 7 letters), kept if they go with the label in the training sample; x is
log(1 + words that have the feature). A label of 0 is grade 0; labelled toxic texts are graded 1 to 3 by the terciles
of their marker words, so that the model's expected severity follows how much there is.

The fit takes about SAMPLE labelled rows, drawn by a hash of the id (a documented bound); all rows are scored, each
by itself, without a shuffle. What goes to the tasks is at most FEATURES weights.

Cases: null and wordless texts are grade 0 by the thresholds alone; rows without a label are scored like the others; no
training rows or but one class give the share of the label to all; an id with several labels counts once for each;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, small_batches, table

SAMPLE = 6000
FEATURES = 2000
GRADES = 3
THRESHOLD = 0.3  # of P(grade >= 1), for predicted
WORDS = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    return [f"={word}", *(word[:k] for k in range(3, 8) if len(word) >= k)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    place: dict[str, int]  # of a feature among the weights
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self):
        self._known: dict[str, tuple[int, ...]] = {}

    def row(self, text: str) -> Counter:
        known, out = self._known, Counter()
        for w, n in Counter(WORDS.findall(text.lower())).items():
            if (at := known.get(w)) is None:
                if len(known) > 300_000:
                    known.clear()
                at = known[w] = tuple(self.place[f] for f in features_of(w) if f in self.place)
            for f in at:
                out[f] += n
        return out

    def at_least(self, text: str) -> list[float]:
        """P(grade >= k) for k = 1, 2, 3."""
        x = sum(self.weights[f] * np.log1p(n) for f, n in sorted(self.row(text).items()))
        return sigmoid(x - self.thresholds).tolist()


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_features: int, steps: int = 600, rate: float = 0.1, l2: float = 3e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds; rows hold (feature, value) pairs. Adam on the sum of the thresholds' log losses."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate([*rows, np.zeros((0, 2))])
    feature, value = flat[:, 0].astype(np.int64), flat[:, 1]
    over = (grades[:, None] >= np.arange(1, GRADES + 1)).astype(float)
    share = np.clip(over.mean(axis=0), 1e-3, 1 - 1e-3)
    theta = np.zeros(n_features + GRADES)
    theta[n_features] = np.log((1 - share[0]) / share[0])
    theta[n_features + 1 :] = -2.0  # logs of the gaps between thresholds
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, gaps = theta[:n_features], np.exp(theta[n_features + 1 :])
        t = theta[n_features] + np.concatenate(([0.0], np.cumsum(gaps)))
        x = np.bincount(doc, w[feature] * value, len(rows))
        d = (sigmoid(x[:, None] - t) - over) / len(rows)
        grad = np.empty_like(theta)
        grad[:n_features] = np.bincount(feature, value * d.sum(axis=1)[doc], n_features) + l2 * w
        by_t = -d.sum(axis=0)
        grad[n_features] = by_t.sum()
        grad[n_features + 1 :] = np.cumsum(by_t[:0:-1])[::-1] * gaps
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:n_features], theta[n_features] + np.concatenate(([0.0], np.cumsum(np.exp(theta[n_features + 1 :]))))


def fit_texts(texts: list[str], toxic: list[int], least: int = 5) -> Ordinal:
    y = np.array(toxic, np.int64)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return Ordinal({}, np.zeros(0), np.log((1 - share) / share) + np.arange(GRADES, dtype=float))
    words = [set(WORDS.findall(t.lower())) for t in texts]
    sets = lambda ws: {f for w in ws for f in features_of(w)}
    bad: Counter = Counter()
    for ws, t in zip(words, toxic, strict=True):
        if t:
            bad.update(sets(ws))
    bad = Counter({f: n for f, n in bad.items() if n >= least})
    good: Counter = Counter()
    for ws, t in zip(words, toxic, strict=True):
        if not t:
            good.update(f for f in sets(ws) if f in bad)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    z = {f: (bad[f] / n1 - good[f] / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12) for f in bad for p in [(bad[f] + good[f] + 1) / (len(y) + 2)]}
    chosen = sorted((f for f in z if z[f] > 4), key=lambda f: (-z[f], f))[:FEATURES]
    model = Ordinal({f: i for i, f in enumerate(chosen)}, np.zeros(len(chosen)), np.zeros(GRADES))
    markers = {f for f in chosen if good[f] <= 0.02 * n0 * bad[f] / n1}
    amount = np.array([sum(any(f in markers for f in features_of(w)) for w in ws) for ws in words])
    cuts = np.quantile(amount[y == 1], [1 / 3, 2 / 3])
    grades = np.where(y == 1, 1 + (amount > cuts[0]) + (amount > cuts[1]), 0)
    rows = [np.array([(f, np.log1p(n)) for f, n in sorted(model.row(t).items())], float).reshape(-1, 2) for t in texts]
    model.weights, model.thresholds = fit_ordinal(rows, grades, len(chosen))
    return model


def sampled_labels(docs: DataFrame, labels: DataFrame, label: str, size: int, key: str = "doc_id", text: str = "text") -> list:
    """(text, label) of about size labelled documents by a hash of the id, at most twice as many.

    The drawn labels are broadcast, bounded so, and the texts are not shuffled.
    """
    rows = labels.filter((fold(key) != 0) & F.col(label).isNotNull()).select(key, F.col(label).cast("int").alias("__label"))
    n = rows.count()
    if n > size:
        rows = rows.filter(F.pmod(F.xxhash64(key, F.lit("label")), F.lit(1_000_000)) < int(1e6 * size / n) + 1)
    drawn = F.broadcast(rows.limit(2 * size))
    return docs.select(key, text).join(drawn, key).orderBy(F.xxhash64(key), "__label").select(F.coalesce(text, F.lit("")), "__label").collect()


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    got = sampled_labels(docs, labels, "toxic", sample)
    return fit_texts([r[0] for r in got], [r[1] for r in got])


def score(docs: DataFrame, model: Ordinal, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, expected_severity (0 to 3), severity (the likeliest grade), p_toxic, predicted."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.array([model.at_least(t or "") for t in b.column("__text").to_pylist()]).reshape(-1, GRADES)
            shares = -np.diff(np.concatenate((np.ones((len(p), 1)), p, np.zeros((len(p), 1))), axis=1), axis=1)
            columns = [pa.array(p.sum(axis=1)), pa.array(shares.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0]), pa.array((p[:, 0] >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(key), *columns], names=[key, "expected_severity", "severity", "p_toxic", "predicted"])

    return docs.select(key, F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {kind}, expected_severity double, severity int, p_toxic double, predicted int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).withColumn("held_out", fold() == 0)
