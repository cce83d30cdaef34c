"""Operators against hand rows, recovered coefficients and row-wise twins."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lotlens.functions import geo
from lotlens.functions import text as T
from lotlens.operators import fair_value, merge, scoring
from lotlens.operators import order_statistics as stats
from lotlens.sources import registry, sheets


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_number_and_currency(spark):
    cases = {"USD 16.500": 16500.0, "11,5 millones": 11_500_000.0, "12 mil": 12_000.0, "sin precio": None, "$ 1.234.567,5": 1234567.5, "900": 900.0}
    for t, want in cases.items():
        assert one(spark, T.number(F.lit(t))) == want, t
    assert one(spark, T.currency(F.lit(2_000_000.0), F.lit(""))) == "ARS"
    assert one(spark, T.currency(F.lit(9000.0), F.lit(""))) == "USD"
    assert one(spark, T.currency(F.lit(9000.0), F.lit("pesos"))) == "ARS"


def test_business_days(spark):
    import datetime

    rng = random.Random(1)
    for _ in range(30):
        d, n = datetime.date(2024, 1, 1) + datetime.timedelta(rng.randint(0, 400)), rng.randint(0, 17)
        want, left = d, n
        if n == 0 and d.weekday() > 4:
            want = d - datetime.timedelta(d.weekday() - 4)
        while left:
            want += datetime.timedelta(1)
            left -= want.weekday() < 5
        assert one(spark, T.add_business_days(F.lit(d), F.lit(n))) == want, (d, n)


def test_haversine(spark):
    got = one(spark, geo.haversine_km(F.lit(-34.6), F.lit(-58.4), F.lit(-31.4), F.lit(-64.2)))
    a, b, c, d = map(math.radians, (-34.6, -58.4, -31.4, -64.2))
    want = 6371 * math.acos(math.sin(a) * math.sin(c) + math.cos(a) * math.cos(c) * math.cos(d - b))
    assert abs(got - want) < 0.01


def test_golden_score_and_levels(spark):
    """A car 8 % under a reference of 23 offers, four minutes old, with every filter met and 7 of 10 fields."""
    p = scoring.parts(F.lit(23), F.lit(8.0357), F.lit(1.0), F.lit(0.0), F.lit(112_000.0), F.lit(125_000.0), F.lit(1.0), F.lit(4 / 60), F.lit(0.7))
    assert one(spark, scoring.score(p)) == 89
    assert one(spark, scoring.level(F.lit(89), F.lit(False))) == "high"
    assert one(spark, scoring.level(F.lit(89), F.lit(True))) == "good"
    assert one(spark, scoring.level(F.lit(49), F.lit(None).cast("boolean"))) == "low"
    assert one(spark, scoring.tri(F.lit(None).cast("int"), F.lit(None).cast("boolean"))) == "unknown"
    assert one(spark, scoring.required(F.lit(None).cast("int"), F.lit(None).cast("boolean"))) == "fail"


def test_comparables_cascade(spark):
    rows = [(i, "a", "m", 2000, 10.0 if i % 2 else None, 1 if i < 7 else 2, "F", 100.0 + i, "s", i) for i in range(12)] + [(99, "a", "m", 2001, 10.0, 1, "F", 5.0, "s", 9)]
    offers = spark.createDataFrame(rows, "id long, make string, model string, year int, km double, trim int, gearbox string, price double, source string, seller int")
    ref = {r["id"]: r for r in stats.per_year(offers, stats.reference, stats.REFERENCE, ["trim", "gearbox"]).collect()}
    assert ref[0]["level"] == "trim_gearbox" and ref[0]["n"] == 6 and abs(ref[0]["median"] - 103.5) < 1e-9
    assert ref[8]["level"] == "gearbox" and ref[8]["n"] == 11


def near_rows(rng, n):
    return pd.DataFrame({
        "id": np.arange(n), "price": np.round(rng.uniform(900, 90_000, n), 2), "km": np.where(rng.random(n) < 0.2, np.nan, rng.integers(1, 50, n)), "trim": pd.array(rng.integers(0, 4, n), "Int64").to_numpy(float, na_value=np.nan),
        "gearbox": rng.choice(["F", "O"], n), "seller": rng.integers(0, 5, n), "source": rng.choice(["A", "N"], n), "year": rng.integers(2000, 2003, n), "target": rng.random(n) < 0.5,
    })


@pytest.mark.parametrize("n", [1, 2, 7, 60, 250])
def test_order_statistics_equal_pairs(n):
    """Every cut of every target against a plain loop over its pool."""
    pdf = near_rows(np.random.default_rng(n), n)
    ref, con, mar = (f(pdf).set_index("id") for f in (stats.reference, stats.context, stats.market))
    med = lambda x: np.median(x) if len(x) else np.nan
    for t in pdf[pdf["target"]].itertuples():
        others = pdf[pdf["id"] != t.id]
        near = (others["km"] - t.km).abs() <= max(5, t.km * 0.2)
        if len(others):
            cuts = {"all_years": others, "same_year": others[others["year"] == t.year], "similar_km": others[near], "closest": others[near & (others["year"] == t.year)], "same_trim": others[others["trim"] == t.trim], "dealers": others[others["source"] == "A"]}
            for k, c in cuts.items():
                assert np.allclose(con.loc[t.id, k], med(c["price"]), equal_nan=True), k
        foreign = others["seller"] != t.seller
        for k, c in (("1", others[foreign & near & (others["trim"] == t.trim)]), ("2", others[foreign & near]), ("3", others[foreign])):
            assert mar.loc[t.id, f"n{k}"] == len(c) and np.allclose(mar.loc[t.id, f"m{k}"], med(c["price"]), equal_nan=True), k
        pool = others[np.isnan(t.km) | others["km"].isna() | ((others["km"] - t.km).abs() <= t.km * 0.25)]
        if not len(pool):
            assert t.id not in ref.index
            continue
        pool = pool[pool["price"] >= np.quantile(pool["price"], 0.75) * 0.35]
        for level, keep in (("trim_gearbox", (pool["trim"] == t.trim) & (pool["gearbox"] == t.gearbox)), ("gearbox", pool["gearbox"] == t.gearbox), ("model", pool["price"] > 0)):
            if keep.sum() >= 5 or level == "model":
                break
        chosen, got = pool[keep], ref.loc[t.id]
        assert (got["level"], got["n"]) == (level, len(chosen))
        assert np.allclose([got["p25"], got["median"], got["p75"], got["median_km"]], [*np.quantile(chosen["price"], [0.25, 0.5, 0.75]), med(chosen["km"].dropna())], equal_nan=True)


def test_fair_value_recovers_coefficients():
    rng = np.random.default_rng(1)
    n = 2000
    years, trims, gears = rng.integers(2010, 2020, n), rng.choice(["base", "mid", "full"], n), rng.choice(["manual", "auto"], n)
    km = np.exp(rng.normal(11, 0.5, n))
    premium = pd.Series(trims).map({"base": -0.10, "mid": 0.0, "full": 0.15}).to_numpy() + pd.Series(gears).map({"manual": -0.03, "auto": 0.05}).to_numpy()
    y = 9 + 0.06 * (years - 2010) + premium - 0.12 * np.log(km / np.median(km)) + rng.normal(0, 0.03, n)
    curve = fair_value.fit(pd.DataFrame({"year": years, "trim": trims, "gearbox": gears, "km": km, "price": np.exp(y), "w": 1}))
    assert abs(curve["slope"] + 0.12) < 0.02
    assert abs(curve["trims"]["full"] - curve["trims"]["base"] - 0.25) < 0.02
    assert abs(curve["gearboxes"]["auto"] - curve["gearboxes"]["manual"] - 0.08) < 0.02
    fair = fair_value.predict(curve, pd.DataFrame({"year": years, "trim": trims, "gearbox": gears, "km": km}))
    assert np.median(np.abs(np.log(np.exp(y) / fair))) < 0.035


def test_gate_and_band_are_judged_by_offers(spark):
    """Many offers in each cell: the spread within cells counts, and the cohorts' medians are those of offers."""
    rng = np.random.default_rng(2)
    n = 1200
    year = rng.integers(2010, 2013, n)
    km = rng.choice([10.0, 20.0, 30.0], n, p=[0.7, 0.2, 0.1])
    price = np.exp(9 + 0.1 * (year - 2010) - 0.1 * np.log(km / 10) + rng.normal(0, 0.2, n))
    rows = [(i, "a", "m", int(y), "t", "g", float(k), float(p)) for i, (y, k, p) in enumerate(zip(year, km, price, strict=True))]
    offers = spark.createDataFrame(rows, "id long, make string, model string, year int, trim string, gearbox string, km double, price double")
    pdf = offers.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(5))).toPandas()
    cell = lambda df, *more: df.groupby(["year", "trim", "gearbox", "km", *more]).agg(price=("price", "median"), w=("price", "size")).reset_index()

    def cohort(t):
        """The median of the others within a year and a quarter of the mileage, over 35 % of their upper quartile."""
        pool = pdf[(pdf["id"] != t.id) & ((pdf["year"] - t.year).abs() <= 1) & ((pdf["km"] - t.km).abs() <= t.km * 0.25)]["price"]
        pool = pool[pool >= np.quantile(pool, 0.75) * 0.35] if len(pool) else pool
        return np.median(pool) if len(pool) >= 5 else np.nan

    pdf["usual"] = [cohort(t) for t in pdf.itertuples()]
    full, flips, curve_errors, cohort_errors = fair_value.predict(fair_value.fit(cell(pdf)), pdf), 0, [], []
    for k in range(5):
        held, rest = pdf[pdf["fold"] == k], pdf[pdf["fold"] != k]
        curve = fair_value.fit(cell(rest, "fold"))
        ratio = held["price"] / np.exp(held["year"].map(curve["starts"]))
        held = held[ratio.between(*fair_value.BAND) & held["usual"].notna()]
        curve_errors.append(np.abs(np.log(held["price"] / fair_value.predict(curve, held))))
        cohort_errors.append(np.abs(np.log(held["price"] / held["usual"])))
        under = lambda v, held=held: (1 - held["price"] / v) * 100 >= fair_value.GUARD
        flips += int((under(full[held.index]) != under(held["usual"])).sum())
    got = fair_value.gate(offers).first()
    want = [float(np.median(np.concatenate(x))) for x in (curve_errors, cohort_errors)]
    assert (got["n"], got["sample"], got["guard_flips"]) == (n, sum(map(len, curve_errors)), flips)
    assert np.allclose([got["curve_error"], got["cohort_error"]], want, atol=2e-6)
    assert got["enabled"] == (want[0] <= want[1])
    fair = fair_value.predict(fair_value.fit(cell(pdf)), pdf)
    low, high = np.quantile(np.log(pdf["price"] / fair), [0.25, 0.75])
    curve = fair_value.fit_curves(offers).first()
    assert np.allclose([curve["q25"], curve["q75"]], [low, high], atol=1e-9)


def test_hysteresis(spark):
    """A curve is taken into use at the cohort's error at most, and stays up to five percent over it."""
    for n, e, c, was, want in ((150, 0.1, 0.1, False, True), (149, 0.1, 0.2, True, False), (200, 0.104, 0.1, False, False), (200, 0.104, 0.1, True, True), (200, 0.106, 0.1, True, False), (200, None, 0.1, True, False)):
        assert one(spark, fair_value.enabled_by(F.lit(n), F.lit(e).cast("double"), F.lit(c), F.lit(was))) == want


def test_offers_without_a_curve_stay(spark):
    offers = spark.createDataFrame([(1, "a", "m", 2000, "t", "g", 10.0, 100.0), (2, "b", "n", None, None, None, None, 5.0)], "id long, make string, model string, year int, trim string, gearbox string, km double, price double")
    assert {r["id"]: r["fair"] for r in fair_value.value(offers, fair_value.fit_curves(offers)).collect()} == {1: None, 2: None}


def test_upsert_keeps_and_logs(spark):
    schema = "k string, price double, status string, seq int"
    now = spark.createDataFrame([("a", 1.0, "x", 1), ("b", 2.0, "x", 1), (None, 3.0, "x", 1)], schema)
    batch = spark.createDataFrame([("a", None, "y", 2), ("a", 9.0, "y", 3), ("b", None, None, 2), ("c", 5.0, "z", 2), (None, 4.0, "x", 2)], schema)
    got = {r["k"]: (r["price"], r["status"], r["change"]) for r in merge.upsert(now, batch, ["k"], ["seq"], ["price", "status"]).collect()}
    assert got == {"a": (9.0, "y", "price"), "b": (2.0, "x", None), "c": (5.0, "z", "new"), None: (4.0, "x", "price")}


def test_replace_partitions_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "weeks")
    rows = spark.createDataFrame([(1, "w1"), (2, "w2")], "v int, week string")
    merge.replace_partitions(rows, path, "week")
    for _ in range(2):
        merge.replace_partitions(spark.createDataFrame([(7, "w2")], "v int, week string"), path, "week")
    assert sorted((r["v"], r["week"]) for r in spark.read.parquet(path).collect()) == [(1, "w1"), (7, "w2")]


def test_sheets(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Marca;Modelo;Año;Precio;Kilometraje\nFord;Fiesta;2017;USD 10.300;112.000\n;x;1;2;3\n")
    rows = sheets.read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [r["accepted"] for r in rows] == [True, False]
    assert (rows[0]["make"], rows[0]["year"], rows[0]["price"], rows[0]["km"]) == ("Ford", 2017, 10300.0, 112000.0)


def test_saved_pages(spark):
    page = '<html><head><title> A car </title><script type="application/ld+json">{"@type":"Car","name":"Fiesta","offers":{"price":"10300","priceCurrency":"USD"}}</script><script type="application/ld+json">{broken</script></head></html>'
    pages = spark.createDataFrame([(1, "http://x/a", page), (2, "http://x/b", "<html></html>")], "page_id long, url string, html string")
    assert [tuple(r) for r in registry.parse(pages, "json_ld").collect()] == [(1, "http://x/a", "Fiesta", 10300.0, "USD")]
    assert [r["name"] for r in registry.parse(pages, "titles").collect()] == ["A car"]


def test_published_day(spark):
    import datetime

    seen = datetime.date(2024, 5, 10)
    cases = {"publicado hoy": seen, "ayer": seen - datetime.timedelta(1), "hace 3 días": seen - datetime.timedelta(3), "hace 2 semanas": seen - datetime.timedelta(14), "el 1/4/2024": datetime.date(2024, 4, 1), "nada": None}
    for t, want in cases.items():
        assert one(spark, registry.published_day(F.lit(t), F.lit(seen))) == want, t
