"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded from what it looks like (shares of kinds of
characters, lengths of words, words and word triples repeated within the passage or from earlier ones), then
h = tanh(W x + b); gated attention a = softmax(q . (tanh(V h) * sigmoid(U h))) weighs the passages, z = sum a h is the
document, and sigmoid(c . z + d) its score. All of it is learned from document labels alone.

The fit takes about SAMPLE labelled rows, drawn by a hash of the id (a documented bound); all rows are scored, each by
itself, without a shuffle. The model is some thousand numbers.

Cases: null, empty and wordless texts have one passage without words; documents of one word to a million get as many
passages as they need; no training rows or but one class give the share of the label to all; rows without a label are
scored like the others; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, mix64, small_batches, table
from .toxicity import sampled_labels, sigmoid

SAMPLE = 4000
PASSAGE = 64
HIDDEN, GATE = 16, 8
THRESHOLD = 0.3
#: Kinds of bytes whose shares are features; all others are one more kind.
_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!", "?", "*", "$", "%", "&", "#", "|", "<>{}[]()=", "-_/\\:;", "\"'")
_KIND = np.full(256, len(_KINDS), np.int64)
for _i, _k in enumerate(_KINDS):
    _KIND[list(_k.encode())] = _i
_KIND[128:] = len(_KINDS) + 1
N_KINDS = len(_KINDS) + 2
N_FEATURES = N_KINDS + 8
_BASE = np.uint64(0x9E3779B97F4A7C15)


def encode_passages(text: str) -> np.ndarray:
    """A row of features for each passage of PASSAGE words of the text, words as white space divides them."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    blank = np.concatenate(([True], (raw == 32) | ((raw >= 9) & (raw <= 13)), [True]))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edges[::2], edges[1::2]
    n = max(1, -(-len(start) // PASSAGE))
    first = np.arange(n) * PASSAGE
    bounds = np.concatenate(([0], start[first[1:]] if n > 1 else [], [len(raw)])).astype(np.int64)
    size = np.diff(bounds)
    which = np.repeat(np.arange(n), size)
    out = np.zeros((n, N_FEATURES))
    out[:, :N_KINDS] = np.bincount(which * N_KINDS + _KIND[raw], minlength=n * N_KINDS).reshape(n, N_KINDS)
    out[:, :N_KINDS] = np.sqrt(out[:, :N_KINDS] / np.maximum(size, 1)[:, None])
    if len(start):
        length = (end - start).astype(float)
        passage = np.arange(len(start)) // PASSAGE
        words = np.bincount(passage, minlength=n).astype(float)
        mean = np.bincount(passage, length, n) / words
        low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint64)
        with np.errstate(over="ignore"):  # a word's hash: the sum of its mixed bytes by place, enough to tell repeats
            begun = np.zeros(len(raw), np.int64)
            begun[start] = start
            place = (np.arange(len(raw)) - np.maximum.accumulate(begun)).astype(np.uint64)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(low + place * _BASE), dtype=np.uint64)))
            h = sums[end] - sums[start]
            triple = h.copy()
            triple[1:] = triple[1:] * _BASE + h[:-1]
            triple[2:] = triple[2:] * _BASE + h[:-2]
        again = np.ones(len(h), bool)
        again[np.unique(triple, return_index=True)[1]] = False
        within = np.ones(len(h), bool)
        within[np.unique(h ^ mix64(passage.astype(np.uint64) + np.uint64(1)), return_index=True)[1]] = False
        out[:, N_KINDS] = np.bincount(passage, again, n) / words
        out[:, N_KINDS + 1] = np.bincount(passage, within, n) / words
        out[:, N_KINDS + 2] = np.log1p(mean)
        out[:, N_KINDS + 3] = np.log1p(np.sqrt(np.maximum(np.bincount(passage, length**2, n) / words - mean**2, 0)))
        out[:, N_KINDS + 4] = np.bincount(passage, length == 1, n) / words
        out[:, N_KINDS + 5] = np.bincount(passage, (raw[start] >= 65) & (raw[start] <= 90), n) / words
        out[:, N_KINDS + 6] = words / PASSAGE
    out[:, N_KINDS + 7] = np.log1p(n) / 5
    return out


SHAPES = (("W", (N_FEATURES, HIDDEN)), ("b", (HIDDEN,)), ("V", (HIDDEN, GATE)), ("U", (HIDDEN, GATE)), ("q", (GATE,)), ("c", (HIDDEN,)), ("d", (1,)))


@dataclass
class Attention:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        """x: standardised passages of all bags, start: where each bag starts."""
        p, bag = self.p, np.repeat(np.arange(len(start)), np.diff(np.append(start, len(x))))
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * g) @ p["q"]
        e = np.exp(e - np.maximum.reduceat(e, start)[bag])
        a = e / np.add.reduceat(e, start)[bag]
        z = np.add.reduceat(a[:, None] * h, start)
        return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "y": sigmoid(z @ p["c"] + p["d"])}

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        bags = [encode_passages(t) for t in texts]
        n = np.array([len(b) for b in bags])
        return self.forward((np.concatenate(bags) - self.mean) / self.scale, np.cumsum(n) - n)["y"]


def gradient(model: Attention, x: np.ndarray, start: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss."""
    p, f = model.p, model.forward(x, start)
    bag, h, a = f["bag"], f["h"], f["a"]
    d = (f["y"] - y) / len(y)
    dz = d[:, None] * p["c"]
    da = (h * dz[bag]).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, start)[bag])
    dt, dg = de[:, None] * p["q"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["q"] * f["t"] * f["g"] * (1 - f["g"])
    dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
    return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "q": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ d, "d": np.array([d.sum()])}


def fit_texts(texts: list[str], labels: list[int], epochs: int = 30, batch: int = 64, rate: float = 0.01, l2: float = 1e-4, seed: int = 7) -> Attention:
    y = np.array(labels, float)
    rng = np.random.default_rng(seed)
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in SHAPES}
    p["b"][:] = p["d"][:] = 0
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    if not len(y) or y.min() == y.max():
        p["c"][:], p["d"][:] = 0, np.log(share / (1 - share))
        return Attention(np.zeros(N_FEATURES), np.ones(N_FEATURES), p)
    bags = [encode_passages(t) for t in texts]
    everything = np.concatenate(bags)
    model = Attention(everything.mean(axis=0), everything.std(axis=0) + 1e-3, p)
    bags = [np.clip((b - model.mean) / model.scale, -20, 20) for b in bags]
    m, v, step = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            n = np.array([len(bags[i]) for i in some])
            step += 1
            for key, g in gradient(model, np.concatenate([bags[i] for i in some]), np.cumsum(n) - n, y[some]).items():
                g = g + l2 * p[key]
                m[key], v[key] = 0.9 * m[key] + 0.1 * g, 0.999 * v[key] + 0.001 * g**2
                p[key] -= rate * (1 - epoch / epochs) * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Attention:
    got = sampled_labels(docs, labels, "quality", sample)
    return fit_texts([r[0] for r in got], [r[1] for r in got])


def score(docs: DataFrame, model: Attention, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("__text").to_pylist()]
            got = [s for k in range(0, len(texts), 50) for s in model.score(texts[k : k + 50]).tolist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(got, pa.float64())], names=[key, "score"])

    return docs.select(key, F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {kind}, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model).withColumn("score", F.round("score", 12))  # equal texts score alike, whatever batch they are in
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
