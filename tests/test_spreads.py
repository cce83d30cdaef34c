"""Spreads against gathering every asked market, with blocks of a few rows and a group that holds most offers."""

from __future__ import annotations

import random
import statistics

import pytest

from lotlens.operators.spreads import spreads


@pytest.mark.parametrize("block_rows", [7, 100_000])
def test_as_gathered(spark, block_rows):
    rng = random.Random(3)
    offers = [(rng.choice("aaaaaaaab"), rng.choice([None, *range(2000, 2010)]), rng.choice([None, float(rng.randint(1, 40)), 7.0]), rng.choice([None, rng.randint(0, 9)])) for _ in range(600)]
    asked = [(g, lo, hi) for g in "abz" for lo in (None, 1990, 2003, 2009) for hi in (None, 2003, 2007)] * 2 + [(None, None, None)]
    got = spreads(spark.createDataFrame(offers, "g string, year int, price double, km long"), spark.createDataFrame(asked, "g string, y0 int, y1 int"), block_rows)
    found = {(r.g, r.y0, r.y1, r.kind): (r.n, r.least, r.median, r.most) for r in got.collect()}
    want = {}
    for g, lo, hi in set(asked):
        for kind, at in (("price", 2), ("km", 3)):
            v = [o[at] for o in offers if o[0] == g and o[at] is not None and ((lo is None and hi is None) or (o[1] is not None and (lo is None or o[1] >= lo) and (hi is None or o[1] <= hi)))]
            if v:
                want[g, lo, hi, kind] = (len(v), min(v), statistics.median(v), max(v))
    assert found == want


def test_nothing(spark):
    none = spark.createDataFrame([], "g string, year int, price double, km long")
    assert spreads(none, spark.createDataFrame([("a", 1, 2)], "g string, y0 int, y1 int")).collect() == []
