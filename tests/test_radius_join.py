"""The sides of a join of blocks are few bytes but many rows, so they stay off the driver."""

from __future__ import annotations

import __spark_entry__


def test_no_side_goes_through_the_driver(spark, data):
    found = __spark_entry__.queries()["radius_join"](spark, data)
    rows = found.collect()
    assert len(rows) == len({(r.customer, r.supplier) for r in rows}) > 0 and max(r.km for r in rows) <= 80
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in plan and plan.count(" BroadcastHashJoin") <= 1  # that of the counts of cells
