import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lotlens.operators import order_statistics as stats


def test_buckets_hold_no_more_than_their_rows_however_many_offers(spark, monkeypatch):
    monkeypatch.setattr(stats, "ROWS", 300)
    offers = spark.range(6000).select("id", F.lit("a").alias("make"), (F.col("id") % 60).cast("string").alias("model"), F.lit(2000).alias("year"), F.col("id").cast("double").alias("price"), F.lit(1.0).alias("km"))
    seen = stats.per_year(offers, lambda pdf: pd.DataFrame({"n": [len(pdf)]}), "n long", []).agg(F.sum("n"), F.max("n")).first()
    assert seen[0] == 18_000 and seen[1] <= 1200  # eight buckets held 2,250 on average


def test_the_cohort_is_the_last_level_of_the_references():
    rng = np.random.default_rng(5)
    n = 400
    pdf = pd.DataFrame({"id": np.arange(n), "make": "a", "model": rng.choice(["m", "n"], n), "of": 2000, "price": rng.choice([0.5, 9.0, 10.0, 11.0, np.pi], n), "km": np.where(rng.random(n) < 0.2, np.nan, rng.integers(0, 30, n)), "trim": "x", "gearbox": "F", "target": rng.random(n) < 0.6})
    want = stats.reference(pdf, least=1 << 60)[["id", "n", "median"]].reset_index(drop=True)
    pd.testing.assert_frame_equal(stats.cohort(pdf).reset_index(drop=True), want, check_dtype=False)


def test_split_references_work_out_percentiles_only_for_the_level_that_is_taken(monkeypatch):
    rng = np.random.default_rng(6)
    n = 600
    pdf = pd.DataFrame({"id": np.arange(n), "make": "a", "model": rng.choice(list("mnop"), n), "of": 2000, "price": rng.choice([0.5, 9.0, 10.0, 11.0, np.nan], n), "km": np.where(rng.random(n) < 0.2, np.nan, rng.integers(0, 30, n)), "trim": rng.choice(["x", "y", None], n), "gearbox": rng.choice(["F", "O", None], n), "target": rng.random(n) < 0.6, "member": rng.random(n) < 0.5, "of_target": np.where(rng.random(n) < 0.3, rng.integers(0, n, n), np.nan), "dealer": rng.random(n) < 0.4, "private": rng.random(n) < 0.3})
    pdf["member"] &= pdf["price"].notna()
    asked, real = [], stats.Pools.percentile
    monkeypatch.setattr(stats.Pools, "percentile", lambda self, parts, q, skip=None: asked.append(len(parts[0][1])) or real(self, parts, q, skip))
    got = stats.split_reference(pdf).set_index("id")
    assert sum(asked) <= 6 * pdf["target"].sum()  # it was 16 times: the floor, and five of each level
    assert set(got["level"]) == {"trim_transmission", "transmission", "model"}
    for t in pdf[pdf["target"]].itertuples():
        pool = pdf[pdf["member"] & (pdf["model"] == t.model) & (pdf["id"] != t.id) & (pdf["of_target"] != t.id)]
        pool = pool if np.isnan(t.km) else pool[pool["km"].isna() | ((pool["km"] - t.km).abs() <= t.km * 0.25)]
        pool = pool[pool["price"] >= pool["price"].quantile(0.75) * 0.35]
        gear = pool[pool["gearbox"] == t.gearbox] if t.gearbox else pool[:0]
        twin = gear[gear["trim"] == t.trim] if t.trim else pool[:0]
        best = next((x for x in (twin, gear) if len(x) >= 5), pool)
        row = got.loc[t.id]
        assert row["n"] == len(best) and row["dealer_n"] == best["dealer"].sum() and row["private_n"] == best["private"].sum()
        for k, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75)):
            np.testing.assert_allclose(row[k], best["price"].quantile(q))
        np.testing.assert_allclose(row["dealer_median"], best.loc[best["dealer"], "price"].median())
