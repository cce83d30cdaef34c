"""Fair-value curves: a robust additive model of the log price for each make and model.

log price = level of the year + premium of the trim + premium of the gearbox + slope * (log km - the year's mean log km). The
terms are found by alternating medians of residuals. One (make, model) is fitted in one task, from the medians of its (year,
trim, gearbox, km step) cells, weighted by their counts; km steps are of two percent, so a model has some hundreds of cells a
year and version however many offers it has. What a curve is judged by is taken from the offers themselves: the quartiles of
their residuals, their held-out errors and their cohorts' medians, which are those of the price references.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled
from . import order_statistics as stats

LEAST_YEAR, LEAST_LEVEL, LEAST_MODEL = 8, 15, 150
BAND = (0.45, 2.2)
SLOPE = (-0.35, 0.0)
PASSES, STOP = 4, 0.005
HYSTERESIS, LEAST_COHORT, GUARD = 1.05, 5, 65.0  # an enabled curve stays up to 5 % worse; offers of a cohort; % under a value
CELLS = 50.0  # steps of log km
KM_RANGE = (1.0, 1_000_000.0)
CURVE = "make string, model string, n long, usual map<int,double>, slope double, starts map<int,double>, years map<int,double>, trims map<string,double>, gearboxes map<string,double>"
TERMS = ["n", "usual", "slope", "starts", "years", "trims", "gearboxes"]


def weighted_median(x: np.ndarray, w: np.ndarray) -> float:
    """The usual median if all weights are one."""
    if (w == 1).all():
        return float(np.median(x))
    order = np.argsort(x, kind="stable")
    return float(x[order][np.searchsorted(np.cumsum(w[order]), w.sum() / 2)])


def group_medians(codes: np.ndarray, x: np.ndarray, w: np.ndarray, least: int) -> dict:
    out = {}
    for c in np.unique(codes):
        at = codes == c
        if w[at].sum() >= least:
            out[c] = weighted_median(x[at], w[at])
    return out


def fit(pdf: pd.DataFrame) -> dict | None:
    """pdf: year, trim, gearbox, km, price and weight w; None if there are too few or no year has enough."""
    pdf = pdf[(pdf["price"] > 0) & pdf["year"].notna()]
    y, w = np.log(pdf["price"].to_numpy(float)), pdf["w"].to_numpy(float)
    year = pdf["year"].to_numpy(int)
    start = group_medians(year, y, w, LEAST_YEAR)
    if not start:
        return None
    base = np.array([start.get(k, np.nan) for k in year])
    ratio = np.exp(y - base)
    ok = (ratio >= BAND[0]) & (ratio <= BAND[1])
    pdf, y, w, year = pdf[ok], y[ok], w[ok], year[ok]
    if not len(pdf):
        return None
    km = pdf["km"].to_numpy(float)
    known = ~np.isnan(km) & (km >= KM_RANGE[0]) & (km <= KM_RANGE[1])
    usual = {k: float(np.average(np.log(km[at]), weights=w[at])) for k in np.unique(year) if (at := known & (year == k)).any()}
    known &= np.isin(year, list(usual))
    x = np.where(known, np.log(np.where(known, km, 1)) - np.array([usual.get(k, 0.0) for k in year]), 0.0)
    levels = {}
    for name in ("trim", "gearbox"):  # a missing trim or gearbox is no level
        has = pdf[name].notna().to_numpy()
        levels[name] = (pdf[name].astype(str).to_numpy(), has)
    (trim, has_trim), (gear, has_gear) = levels["trim"], levels["gearbox"]
    years, trims, gears, slope = dict(start), {}, {}, 0.0
    of = lambda table, codes: np.array([table.get(c, 0.0) for c in codes])
    moved = lambda new, old: max((abs(v - old.get(k, 0.0)) for k, v in new.items()), default=0.0)
    for step in range(PASSES):
        rest = y - of(years, year) - of(gears, gear) - slope * x
        new_trims = group_medians(trim[has_trim], rest[has_trim], w[has_trim], LEAST_LEVEL)
        new_years = group_medians(year, y - of(new_trims, trim) - of(gears, gear) - slope * x, w, 0)
        rest = y - of(new_years, year) - of(new_trims, trim) - slope * x
        new_gears = group_medians(gear[has_gear], rest[has_gear], w[has_gear], LEAST_LEVEL)
        rest, new_slope = (y - of(new_years, year) - of(new_trims, trim) - of(new_gears, gear))[known], 0.0
        if known.sum() > 2 and (v := np.average((x[known] - np.average(x[known], weights=w[known])) ** 2, weights=w[known])) > 1e-12:
            mx, mr = np.average(x[known], weights=w[known]), np.average(rest, weights=w[known])
            new_slope = float(np.clip(np.average((x[known] - mx) * (rest - mr), weights=w[known]) / v, *SLOPE))
        far = max(abs(new_slope - slope), moved(new_years, years), moved(new_trims, trims), moved(new_gears, gears))
        years, trims, gears, slope = new_years, new_trims, new_gears, new_slope
        if step and far <= STOP:  # the first pass is always followed by a second
            break
    return {"n": int(w.sum()), "usual": {int(k): v for k, v in usual.items()}, "slope": slope, "starts": {int(k): v for k, v in start.items()}, "years": {int(k): v for k, v in years.items()}, "trims": trims, "gearboxes": gears}


def predict(curve: dict, pdf: pd.DataFrame) -> np.ndarray:
    km, year = pdf["km"].to_numpy(float), pdf["year"].to_numpy(float)
    usual = np.array([curve["usual"].get(int(k), np.nan) if k == k else np.nan for k in year])
    known = (km >= KM_RANGE[0]) & (km <= KM_RANGE[1]) & ~np.isnan(usual)
    x = np.where(known, np.log(np.where(known, km, 1)) - np.nan_to_num(usual), 0.0)
    level = np.array([curve["years"].get(int(k), np.nan) if k == k else np.nan for k in year])
    return np.exp(level + np.array([curve["trims"].get(str(t), 0.0) for t in pdf["trim"]]) + np.array([curve["gearboxes"].get(str(g), 0.0) for g in pdf["gearbox"]]) + curve["slope"] * x)


def cells(offers: DataFrame, *more: str) -> DataFrame:
    """Medians of equal (make, model, year, trim, gearbox, km step): a map-side count of what any model has, whatever its offers."""
    step = F.round(F.ln(F.when(F.col("km") > 0, F.col("km"))) * CELLS)
    held = offers.groupBy("make", "model", "year", "trim", "gearbox", step.alias("step"), *more).agg(F.exp(F.avg(F.ln(F.when(F.col("km") > 0, F.col("km"))))).alias("km"), F.percentile("price", F.lit(0.5)).alias("price"), F.count(F.lit(1)).alias("w"))
    return held.drop("step")


def fair_price() -> Column:
    """The fair price of an offer joined with its curve; null where the curve has no level for its year."""
    x = F.coalesce(F.when(F.col("km").between(*KM_RANGE), F.ln("km") - F.try_element_at("usual", "year")), F.lit(0.0))
    zero = F.lit(0.0)
    return F.exp(F.try_element_at("years", "year") + F.coalesce(F.try_element_at("trims", F.col("trim").cast("string")), zero) + F.coalesce(F.try_element_at("gearboxes", F.col("gearbox").cast("string")), zero) + F.col("slope") * x)


def curves_of(offers: DataFrame) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        curve = fit(pdf)
        rows = [] if curve is None else [{"make": pdf["make"].iloc[0], "model": pdf["model"].iloc[0], **curve}]
        return pd.DataFrame(rows, columns=["make", "model", *TERMS])

    return cells(offers).groupBy("make", "model").applyInPandas(run, CURVE)


def fit_curves(offers: DataFrame) -> DataFrame:
    """The curves, and the quartiles of the residuals of all offers within BAND of their year's median."""
    curves = curves_of(offers)
    ratio = F.col("price") / F.exp(F.try_element_at("starts", "year"))
    rest = F.log(F.col("price") / fair_price())
    near = offers.join(curves, ["make", "model"]).filter(F.col("price") > 0).filter(ratio.between(*BAND))
    quartiles = near.groupBy("make", "model").agg(F.percentile(rest, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    return curves.join(quartiles, ["make", "model"], "left").withColumns({"q25": F.get("q", F.lit(0)), "q75": F.get("q", F.lit(1))}).drop("q")


def value(offers: DataFrame, curves: DataFrame) -> DataFrame:
    """offers plus fair, fair_low, fair_high and diff_pct; a column expression over the joined curve, no Python.

    Offers without a curve, or of a year that it has no level for, stay, without a value.
    """
    joined = offers.join(curves, ["make", "model"], "left").withColumn("fair", fair_price())
    made = {"fair_low": F.col("fair") * F.exp("q25"), "fair_high": F.col("fair") * F.exp("q75"), "diff_pct": (1 - F.col("price") / F.col("fair")) * 100}
    return joined.withColumns(made).drop(*TERMS, "q25", "q75")


def enabled_by(n: Column, curve: Column, cohort: Column, was: Column) -> Column:
    """Enough offers, and an error no greater than the cohort's; a curve in use stays until it is HYSTERESIS times that."""
    return (n >= LEAST_MODEL) & F.coalesce(curve <= cohort * F.when(was, HYSTERESIS).otherwise(1.0), F.lit(False))


def gate(offers: DataFrame, was: DataFrame | None = None, folds: int = 5) -> DataFrame:
    """(make, model, n, sample, curve_error, cohort_error, guard_flips, enabled), errors being median absolute log errors.

    Each offer is priced by a curve of the other folds and by its cohort: the median of its model's pool, as references take
    it, of LEAST_COHORT offers and more. Offers that both can price count. guard_flips: offers that one of the two, the full
    curve or the cohort, puts GUARD percent under its value and the other doesn't. `was` has (make, model) of curves in use.
    """
    dealt = settled(offers.select("id", "make", "model", "year", "trim", "gearbox", "price", "km", F.pmod(F.xxhash64("id"), F.lit(folds)).cast("int").alias("fold")))  # read six times

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for k in range(folds):
            train = pdf[pdf["fold"] != k]
            curve = fit(train) if len(train) else None
            if curve is not None:
                rows.append({"make": pdf["make"].iloc[0], "model": pdf["model"].iloc[0], "fold": k, **curve})
        return pd.DataFrame(rows, columns=["make", "model", "fold", *TERMS])

    curves = cells(dealt, "fold").groupBy("make", "model").applyInPandas(run, CURVE.replace("n long", "fold int, n long"))
    cohorts = stats.per_year(dealt, stats.cohort, stats.COHORT, []).filter(F.col("n") >= LEAST_COHORT).select("id", F.col("median").alias("usual_price"))
    start = F.exp(F.try_element_at("starts", "year"))
    # curves are few beside offers, so both join before the offers themselves move
    full = dealt.join(curves_of(dealt).drop("n"), ["make", "model"], "left").withColumn("fair", fair_price()).drop(*TERMS)
    held = full.join(curves.drop("n"), ["make", "model", "fold"]).filter((F.col("price") / start).between(*BAND))
    priced = held.select("id", "make", "model", "price", "fair", fair_price().alias("held")).filter("held IS NOT NULL").join(cohorts, "id")
    under = lambda c: F.coalesce((1 - F.col("price") / F.col(c)) * 100 >= GUARD, F.lit(False))
    error = lambda c: F.percentile(F.abs(F.log(F.col("price") / F.col(c))), F.lit(0.5))
    errors = priced.groupBy("make", "model").agg(F.count(F.lit(1)).alias("sample"), error("held").alias("e"), error("usual_price").alias("c"), F.count_if(under("fair") != under("usual_price")).alias("guard_flips"))
    sized = dealt.groupBy("make", "model").agg(F.count(F.lit(1)).alias("n")).join(errors, ["make", "model"], "left")
    used = sized.join(was.select("make", "model", F.lit(True).alias("was")), ["make", "model"], "left") if was is not None else sized.withColumn("was", F.lit(False))
    enabled = enabled_by(F.col("n"), F.col("e"), F.col("c"), F.coalesce("was", F.lit(False)))
    none = F.lit(0).cast("long")
    return used.select("make", "model", "n", F.coalesce("sample", none).alias("sample"), F.round("e", 6).alias("curve_error"), F.round("c", 6).alias("cohort_error"), F.coalesce("guard_flips", none).alias("guard_flips"), enabled.alias("enabled"))
