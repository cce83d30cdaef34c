"""Trials against admitting attempt by attempt."""

from __future__ import annotations

import random

import pytest

from lotlens.operators.admission import admitted


def one_by_one(rows, limit, most):
    inside = {}
    for person, listing, at, stock in sorted((r for r in rows if None not in r[:3]), key=lambda r: (r[2], r[1], r[3] is False)):
        stock = True if stock is None else stock
        mine = inside.setdefault(person, {})
        if len(mine) < limit and listing not in mine and not (stock and most is not None and sum(s for _, s, _ in mine.values()) >= most):
            mine[listing] = (at, stock, len(mine) + 1)
    return sorted((p, x, *v) for p, mine in inside.items() for x, v in mine.items())


@pytest.mark.parametrize(("limit", "most"), [(5, 2), (5, 0), (3, None), (100, 3)])
def test_as_one_by_one(spark, limit, most):
    rng = random.Random(limit)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([*range(12), None]), rng.choice([*range(25), None]), rng.choice([True, True, False, None])) for _ in range(400)]
    rows += [(9, k, k, k % 2 == 0) for k in range(200)]
    got = admitted(spark.createDataFrame(rows, "person int, listing int, at int, stock boolean").repartition(3), limit, most)
    assert sorted(map(tuple, got.select("person", "listing", "at", "stock", "place").collect())) == one_by_one(rows, limit, most)
