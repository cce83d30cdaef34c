"""Whitening against exact fractions and NumPy on the whole matrix."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from lotlens.llm import whitening


def whole(v):
    return tuple(math.floor(64 * c) + 1_000_000 for c in v)


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def check(rows, vectors, components=16):
    """rows of one length against a fit of all distinct vectors at once."""
    good = [(k, v) for k, v in vectors if usable(v)]
    fit = sorted({whole(v) for _, v in good})
    n, dim = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(dim)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)] for x in fit])
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, dim)
    assert len(rows) == len(good) * k and {r.n for r in rows} == {n}
    by_id = {i: whole(v) for i, v in good}
    at = {x: p for p, x in enumerate(fit)}
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    for r in rows:
        x = by_id[r.vec_id]
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        assert abs(abs(r.whitened) - abs(want[at[x], r.component - 1])) < 1e-6
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(covariance), rel=1e-9) and r.identity_error <= 1e-6
    signs = {}
    for r in rows:
        if abs(r.whitened) > 1e-3:
            signs.setdefault(r.component, set()).add(np.sign(r.whitened * want[at[by_id[r.vec_id]], r.component - 1]))
    assert all(len(s) == 1 for s in signs.values())


def test_whole_table(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    check(whitening.op13_whitening(spark, "/root/testdata/sf0.01").collect(), vectors)


def test_rows_of_all_kinds(spark):
    rng = np.random.default_rng(3)
    vectors = [(k, (rng.normal(size=5) * [9, 4, 2, 1, 0.5]).tolist()) for k in range(60)]
    vectors += [(100 + k, vectors[0][1]) for k in range(500)] + [(700, [-0.01, 0.0, 1e-300, 3.0, 1e5])]
    bad = [(800, None), (801, [1.0, None, 1.0, 1.0, 1.0]), (802, [1.0, math.nan, 1.0, 1.0, 1.0]), (803, [math.inf, 1.0, 1.0, 1.0, 1.0]), (804, []), (805, [1e300, 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(k, v, 1.0, 2) for k, v in vectors + bad], "vec_id long, embedding array<double>, x double, id int").repartition(7)
    got = whitening.whiten(df).collect()
    check(got, vectors)
    check(whitening.whiten(df, components=2).collect(), vectors, 2)


def test_small_variance_on_a_large_mean(spark):
    """A one-pass covariance of such numbers in double precision would be noise."""
    rng = np.random.default_rng(4)
    vectors = [(k, (4e9 + rng.integers(-3, 4, 6) / 64).tolist()) for k in range(200)]
    check(whitening.whiten(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect(), vectors)


def test_lengths_ids_and_no_variance(spark):
    rows = [(None, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (2, [4.0]), (3, [5.0]), (3, [6.0]), (4, [1.0, 1.0]), (5, [1.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id int, embedding array<float>")).collect()
    three = [r for r in got if r.vec_id in (None, 1)]
    assert len(three) == 6 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error == 0 for r in three)
    one = sorted((r.vec_id, r.whitened) for r in got if r.vec_id in (2, 3))
    assert [abs(round(w, 9)) for _, w in one] == [round(1.5**0.5, 9), 0, round(1.5**0.5, 9)]
    two = {r.component: (r.whitened, r.explained) for r in got if r.vec_id == 4}
    assert abs(two[1][0]) == 1 and two[1][1] == 1 and two[2] == (None, 0)


def test_huge_components_and_no_rows(spark):
    rows = [(k, [float(2**50 + k), 1.0 - k]) for k in range(3)] + [(9, [-float(2**55), 2.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 8 and all(r.deviation is None for r in got if r.vec_id == 9) and got[0].n == 4
    assert whitening.whiten(spark.createDataFrame([], "vec_id string, embedding array<float>")).collect() == []
    assert whitening.whiten(spark.createDataFrame([("a", None)], "vec_id string, embedding array<float>")).collect() == []
