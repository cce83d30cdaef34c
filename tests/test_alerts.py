"""Dealer alerts: the batch fold against a plain loop, and the stream in several batches, with a restart and late days."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from lotlens.operators import alerts
from lotlens.streaming import alerts as stream

START = datetime(2024, 1, 1)


def scan(item, day, **more):
    row = dict(item=item, at=START + timedelta(days=day), price=100.0, median=None, n=9, enough=True, cheaper_id=None, cheaper_price=None, since=None, model_days=None, model_n=None, searches=None, people=None, gone=False)
    return tuple((row | more).values())


def random_scans(seed, items=12, days=40):
    rng = random.Random(seed)
    rows = []
    for item in range(items):
        since = START - timedelta(days=rng.randint(0, 90))
        for day in range(days):
            if rng.random() < 0.6:
                rows.append(scan(item, day, median=rng.choice([None, 0.0, 80.0, 95.0, 100.0, 112.0, 150.0]), enough=rng.choice([True, True, False, None]), cheaper_id=rng.choice([None, 1, 2, 3]), cheaper_price=rng.choice([None, 50.0, 91.9, 92.4, 99.0]), since=rng.choice([None, since, since]), model_days=rng.choice([None, 20]), model_n=rng.choice([None, 3, 7]), searches=rng.choice([None, rng.randint(0, 9)]), people=rng.choice([None, rng.randint(0, 9)]), gone=rng.random() < 0.03))
    return rows


def as_rows(df):
    return sorted(((r.item, r.at, r.kind, r.key, r.pct) for r in df), key=repr)


def test_rules(spark):
    scans = [scan(1, 0, median=100.0, searches=1, people=1), scan(1, 1, median=108.0, searches=3, people=5), scan(1, 2, median=111.0, searches=4, people=4), scan(1, 3, median=105.0), scan(1, 4, median=99.0, enough=False), scan(1, 5, median=99.0)]
    scans += [scan(2, 0, cheaper_id=7, cheaper_price=92.6), scan(2, 1, cheaper_id=7, cheaper_price=92.0), scan(2, 2, cheaper_id=7, cheaper_price=80.0), scan(2, 3, cheaper_id=8, cheaper_price=80.0)]
    scans += [scan(3, 0, since=START - timedelta(days=59)), scan(3, 1, since=START - timedelta(days=59)), scan(3, 2, since=START - timedelta(days=59)), scan(4, 0, since=START - timedelta(days=30), model_days=20, model_n=5), scan(4, 1, since=START - timedelta(days=30), model_days=20, model_n=5)]
    got = {(r.item, (r.at - START).days, r.kind, r.key, r.pct) for r in alerts.told(spark.createDataFrame(scans, alerts.SCAN)).collect()}
    assert got == {(1, 2, "market_moved", "up", 11.0), (1, 2, "new_demand", "4:4", None), (1, 5, "market_moved", "down", -10.8), (2, 1, "cheaper_nearby", "7", 8.0), (2, 3, "cheaper_nearby", "8", 20.0), (3, 1, "slow", "", None), (4, 1, "slow", "", None)}
    assert alerts.told(spark.createDataFrame([], alerts.SCAN)).count() == 0


@pytest.fixture
def store(spark):
    before = {k: spark.conf.get(k, None) for k in stream.STATE_STORE}
    for k, v in stream.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def run(spark, tmp_path, batch, number):
    """One more file, and the query started again from its checkpoint: a restart each time."""
    spark.createDataFrame(batch, alerts.SCAN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(alerts.SCAN).parquet(str(tmp_path / "in"))
    q = stream.told(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.read.schema(alerts.ALERT).parquet(str(tmp_path / "out")).collect()


def test_stream_in_batches_is_the_batch(spark, tmp_path, store):
    rows = sorted(random_scans(5), key=lambda r: r[1])
    rows = [r[:8] + (None,) + r[9:] for r in rows]  # without the timer's rule, whose moment isn't a scan's
    edges = [0, 60, 61, 150, len(rows)]
    for k, (s, e) in enumerate(zip(edges, edges[1:])):
        got = run(spark, tmp_path, rows[s:e], k)
    assert as_rows(got) == as_rows(alerts.told(spark.createDataFrame(rows, alerts.SCAN)).collect())


def test_timer_late_day_and_restart(spark, tmp_path, store):
    since = START - timedelta(days=55)
    run(spark, tmp_path, [scan(1, 0, since=since, median=100.0), scan(2, 0, since=since), scan(3, 0, median=100.0)], 0)
    # a late scan of car 1 may not move its mark back; car 2 is gone before it is slow
    run(spark, tmp_path, [scan(1, 1, since=since, median=100.0), scan(2, 1, gone=True), scan(1, -1, median=50.0)], 1)
    run(spark, tmp_path, [scan(3, 20, median=130.0)], 2)
    got = run(spark, tmp_path, [scan(3, 21, median=131.0), scan(1, 22, since=since, median=109.0)], 3)
    assert as_rows(got) == as_rows([type(got[0])(item=1, at=since + timedelta(days=60), kind="slow", key="", pct=None), type(got[0])(item=3, at=START + timedelta(days=20), kind="market_moved", key="up", pct=30.0)])
