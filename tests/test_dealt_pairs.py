"""Joins of few bytes that make many pairs are dealt to tasks by their pairs, which adaptive execution doesn't merge into one."""

import pytest

from lotlens.operators.similar_names import similar
from lotlens.plans.registry import QUERIES


def _dealt(df):
    return df._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM")


@pytest.fixture(scope="module")
def names(spark):
    return [f"renault{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


def test_similar_names(spark, names):
    left, right = (spark.createDataFrame([(n,) for n in x], "name string") for x in (names, [n + "x" for n in names]))
    found = similar(left, right, 0.88)
    assert _dealt(found) >= 2
    got = {(r["a"], r["b"]) for r in found.collect()}
    assert got == {(a, b + "x") for a in names for b in names if 2 * (7 + (a[7] == b[7]) + (a[8] == b[8]) + (a[7] != b[7] and a[8] != b[8] and (a[7] == b[8] or a[8] == b[7]))) / 19 >= 0.88}


def test_radius_join(spark, data):
    assert _dealt(QUERIES["radius_join"](spark, data)) >= 2
