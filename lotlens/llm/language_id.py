"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1. A letter n-gram is the product (binding) of its letters' vectors,
each rotated by its place in the n-gram; a document is the sum (bundle) of its n-grams, words' edges included; a
language's prototype is the bundle of its training documents at unit length, then moved by those that it got wrong.
A document gets the language of the prototype with the largest cosine.

The documents' vectors come from a matrix product: counts of the n-grams that a few hundred documents have, times
these n-grams' vectors. Letters beyond the Latin blocks share 60 vectors by their code.

The fit takes a sample of at most about SAMPLE rows, drawn by a hash of the id; all rows are scored. Prototypes are
a few thousand numbers. Cases: null or letterless texts are "und" with score 0; equal cosines go to the first
language by name; if no training row exists, all are "und"; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, pieces, small_batches, table

WIDTH = 1024
GRAM = 3
SAMPLE = 4000
UNDETERMINED = "und"
_CLASSES = 256


def _letter_classes() -> np.ndarray:
    """Class of each code point: 0 for all but letters, small and capital letters alike."""
    out = np.zeros(0x110000, np.uint8)
    latin = sorted({ord(chr(c).lower()) for c in range(0x180) if chr(c).isalpha() and len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 0x180})
    place = {c: i + 1 for i, c in enumerate(latin)}
    assert len(place) < _CLASSES - 61
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        if (ch := chr(c)).isalpha():
            low = ord(ch.lower()[0])
            out[c] = place.get(low, _CLASSES - 60 + low % 60)
    return out


_TABLES: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    if "classes" not in _TABLES:
        _TABLES["classes"] = _letter_classes()
        bits = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2, (_CLASSES, WIDTH), np.int8) * 2 - 1
        for k in range(GRAM):
            _TABLES[f"turned{k}"] = np.roll(bits, k, axis=1).astype(np.float32)
        _TABLES["seen"] = np.zeros(_CLASSES**GRAM, np.int32)
    return _TABLES["classes"]


def bundle(texts: list[str]) -> np.ndarray:
    """One vector for each text; zero if it has no letter."""
    classes = letters()
    n = np.array([len(t) + 2 for t in texts], np.int64)
    raw = classes[np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "replace"), np.uint32)].astype(np.int64)
    doc, keep = np.repeat(np.arange(len(texts)), n), np.ones(len(raw), bool)
    keep[1:] = (raw[1:] > 0) | (raw[:-1] > 0) | (doc[1:] != doc[:-1])  # a run of non-letters in a text is one break
    doc, raw = doc[keep], raw[keep]
    if len(raw) < GRAM:  # nothing but empty texts
        return np.zeros((len(texts), WIDTH), np.float32)
    code, whole = np.zeros(len(raw) - GRAM + 1, np.int64), np.ones(len(raw) - GRAM + 1, bool)
    for k in range(GRAM):
        part = raw[k : len(raw) - GRAM + 1 + k]
        code = code * _CLASSES + part
        whole &= (part > 0) if 0 < k < GRAM - 1 else True  # a break only at either end
    whole &= doc[: len(code)] == doc[GRAM - 1 :]
    code, doc = code[whole], doc[: len(whole)][whole]
    seen = _TABLES["seen"]
    seen[code] = 1
    grams = code[_first(seen, code)]
    seen[grams] = np.arange(len(grams))
    at = doc * len(grams) + seen[code]
    counts = np.bincount(at, minlength=len(texts) * len(grams)).reshape(len(texts), len(grams)).astype(np.float32)
    seen[grams] = 0
    vectors = np.ones((len(grams), WIDTH), np.float32)
    for k in range(GRAM):
        vectors *= _TABLES[f"turned{k}"][grams // _CLASSES ** (GRAM - 1 - k) % _CLASSES]
    return counts @ vectors


def _first(seen: np.ndarray, code: np.ndarray) -> np.ndarray:
    """One place of each distinct code."""
    seen[code] = np.arange(len(code))
    return np.flatnonzero(seen[code] == np.arange(len(code)))


def unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return np.divide(v, norm, out=np.zeros(v.shape, np.float64), where=norm > 0)


@dataclass
class Profiles:
    langs: list[str]
    prototypes: np.ndarray  # unit length, a row for each language

    def cosines(self, texts: list[str]) -> np.ndarray:
        return unit(bundle(texts)) @ self.prototypes.T

    def predict(self, texts: list[str], sharpness: float = 20.0, chars: int = 1_000_000) -> Iterator[tuple[str, float, float]]:
        """(language, share of the softmax over sharpened cosines, cosine) of each text."""
        for part in pieces([(t,) for t in texts], chars):
            if not self.langs:
                yield from ((UNDETERMINED, 0.0, 0.0) for _ in part)
                continue
            c = self.cosines([t for (t,) in part])
            best, e = c.argmax(axis=1), np.exp(sharpness * (c - c.max(axis=1, keepdims=True)))
            share = e.max(axis=1) / e.sum(axis=1)
            for i, (t,) in enumerate(part):
                yield (self.langs[best[i]], float(share[i]), float(c[i, best[i]])) if c[i].any() else (UNDETERMINED, 0.0, 0.0)


def fit_profiles(texts: list[str], langs: list[str], rounds: int = 10) -> Profiles:
    names = sorted(set(langs))
    vectors = np.concatenate([unit(bundle([t for (t,) in p])) for p in pieces([(t,) for t in texts], 1_000_000)]) if texts else np.zeros((0, WIDTH))
    y = np.array([names.index(x) for x in langs], np.int64)
    sums = np.zeros((len(names), WIDTH))
    np.add.at(sums, y, vectors)
    for _ in range(rounds):  # move prototypes to the documents that they missed and away from those they took
        got = (vectors @ unit(sums).T).argmax(axis=1) if len(names) else y
        wrong = np.flatnonzero(got != y)
        if not len(wrong):
            break
        np.add.at(sums, y[wrong], vectors[wrong])
        np.add.at(sums, got[wrong], -vectors[wrong])
    return Profiles(names, unit(sums))


def sample_rows(rows: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """About size rows by a hash of the key, all if there are fewer; at most twice as many. The count reads no text."""
    n = rows.count()
    if n > size:
        rows = rows.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1_000_000)) < int(1e6 * size / n) + 1).limit(2 * size)
    return rows


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Profiles:
    """Profiles from a bounded sample of the rows where train holds and the language is known."""
    rows = docs.filter(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key), F.col(text), F.col(lang))
    got = sample_rows(rows, sample, key).select(text, lang).collect()
    return fit_profiles([r[0] for r in got], [str(r[1]) for r in got])


def predict(docs: DataFrame, profiles: Profiles, keys: list[str], text: str = "text") -> DataFrame:
    """keys, lang_pred, score and cosine of every row."""
    small_batches(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(profiles.predict([t or "" for t in b.column("__text").to_pylist()]))
            columns = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], *columns], names=[*keys, "lang_pred", "score", "cosine"])

    return docs.select(*keys, F.col(text).alias("__text")).mapInArrow(run, f"{fields}, lang_pred string, score double, cosine double")


def recognised(profiles: Profiles, text: Column) -> Column:
    """Whether a language was found: there is a letter, and the best prototype isn't at a right angle or beyond."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([lang != UNDETERMINED and cosine > 0 for lang, _, cosine in profiles.predict([t or "" for t in texts])], dtype=bool)

    return run(text)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = fit(docs, fold() != 0)
    return predict(docs, profiles, ["doc_id"]).select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", "cosine")
