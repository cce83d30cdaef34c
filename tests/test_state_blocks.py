"""Pairs of a rule's states: few rows are shuffled for them, and they take little room."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lotlens.operators import match_blocks


def sides(spark, searches, offers):
    s = spark.range(searches).select(F.col("id").alias("search"), F.lit(None).cast("string").alias("make"), F.lit(None).cast("string").alias("model"), F.lit("suv").alias("body_types"), F.lit("private").alias("seller_types"), F.lit(True).alias("seller_filter"))
    o = spark.range(offers).select("id", F.lit("m").alias("make"), F.col("id").cast("string").alias("model"), F.lit("suv").alias("body_type"), F.lit(None).cast("string").alias("seller_type"), F.lit(False).alias("dealer_inferred"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("dealer"))
    return s, o


def test_pairs_take_little_room(spark, tmp_path):
    match_blocks.states(*sides(spark, 100, 40_000), 1000.0, "body_type").write.parquet(str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("*.parquet"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4_000_000
    assert sum(f.stat().st_size for f in files) < 4_000_000


@pytest.mark.parametrize("rule", ["model", "seller"])
def test_searches_meet_few_things_said(spark, monkeypatch, rule):
    """Not every model of a make that is asked for, nor every dealer, is a thing of its own."""
    rows, met = [], match_blocks.met
    monkeypatch.setattr(match_blocks, "met", lambda left, *more: rows.append(left.count()) or met(left, *more))
    s, o = sides(spark, 10, 500)
    if rule == "model":
        s = s.withColumn("make", F.lit("m"))
    got = match_blocks.states(s, o, 1000.0, rule).groupBy("result").count().collect()
    assert {tuple(r) for r in got} == ({("ok", 5000)} if rule == "model" else {("fail", 2500), ("unknown", 2500)})
    assert rows[0] <= 20
