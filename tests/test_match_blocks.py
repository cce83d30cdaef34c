"""Rules in blocks against the same rules as columns, pair by pair, on random searches and offers with gaps."""

import random

import pytest
from pyspark.sql import functions as F

from lotlens.operators import match_blocks, rules

SEARCH = "search long, make string, model string, year_min int, year_max int, years string, price_min double, price_max double, currency string, km_min int, km_max int, transmission string, fuel string, body_types string, colors string, lat double, lon double, radius double, extra_zones string, sources string, seller_types string, seller_filter boolean, trims string, km_target int, price_target double, max_distance double"
OFFER = "id long, make string, model string, year int, price double, currency string, price_usd double, price_partial boolean, km long, transmission string, fuel string, body_type string, color string, maybe_colors string, lat double, lon double, source string, seller_type string, dealer_inferred boolean, dealer long, trim string"
SMALL = (16, 8)


def _searches(r):
    out = []
    for k in range(60):
        make = r.choice(["Fiat", "Ford", "", None, None])
        out.append((k, make, "Uno" if make == "Fiat" and k % 3 == 0 else None, r.choice([None, 1995]), r.choice([None, 2000]), r.choice([None, None, "1994,1996,1999"]), r.choice([None, 5000.0]), r.choice([None, 30000.0, 60000000.0, 9000.5]), r.choice([None, "usd", "ARS", "EUR"]), r.choice([None, 20000]), r.choice([None, 90000]), r.choice([None, "Manual", "Automática"]), r.choice([None, "gnc"]), r.choice([None, "suv", "suv,sedan,suv"]), r.choice([None, "blanco,negro", "verde"]), r.choice([None, -30.0]), -60.0, r.choice([None, 300.0, 0.0]), r.choice([None, None, "-31;-61;200|-25;-58;50"]), r.choice([None, "alpha,nova"]), r.choice([None, "private", "dealer,private"]), r.choice([None, True, False]), r.choice([None, "up! | Plus", "titanium|x !"]), r.choice([None, 50000]), r.choice([None, 20000.0]), r.choice([None, 100.0])))
    return out


def _offers(r):
    out = []
    for k in range(120):
        lat = r.choice([None, -30.0, -30.5, -25.0])
        out.append((k, r.choice(["Fiat", "Ford", "", None]), r.choice(["Uno", None]), r.choice([None, 1994, 1996, 2000, 2003]), r.choice([None, 0.0, 5000.0, 25000.0, 30000.0, 30000000.0]), r.choice([None, "ARS", "usd", "EUR"]), r.choice([None, 8000.0]), r.choice([None, True, False]), r.choice([None, 0, 20000, 50000, 120000]), r.choice([None, "manual", "AUTOMÁTICA  CVT"]), r.choice([None, "Nafta/GNC", "Nafta"]), r.choice([None, "suv", "sedan", "pickup"]), r.choice([None, "blanco", "rojo"]), r.choice([None, "verde:40,azul:20", "negro:29"]), lat, None if lat is None else r.choice([-60.0, -58.0]), r.choice([None, "alpha", "directo"]), r.choice([None, "private", "dealer"]), r.choice([None, True, False]), r.choice([None, 7]), r.choice([None, "UP! High", "SE Plus", "x ! titanium", ""])))
    return out


@pytest.fixture(scope="module")
def sides(spark):
    r = random.Random(3)
    return spark.createDataFrame(_searches(r), SEARCH), spark.createDataFrame(_offers(r), OFFER)


@pytest.fixture(scope="module")
def plain(sides):
    """{(search, id): {rule: state}} by a nested loop over all that a search can meet."""
    s, o = (d.select(F.struct("*").alias(k)) for d, k in zip(sides, "so"))
    get = (lambda k: F.col(f"s.{k}")), (lambda k: F.col(f"o.{k}"))
    c = F.col
    meets = F.when(c("s.model").isNotNull(), (c("s.make") == c("o.make")) & (c("s.model") == c("o.model"))).when(c("s.make").isNotNull(), c("s.make") == c("o.make")).otherwise(F.array_contains(F.split("s.body_types", ","), c("o.body_type")))
    states = rules.hard(*get, 1000.0) | rules.soft(*get, 1000.0)
    rows = s.crossJoin(o).filter(meets).select("s.search", "s.model", "o.id", *[e.alias(f"r_{k}") for k, e in states.items()]).collect()
    return {(x["search"], x["id"]): (x["model"], {k: x[f"r_{k}"] for k in states}) for x in rows}


def _by(plain, state, names):
    return {p: sum(r[k] == state for k in names) for p, (_, r) in plain.items()}


def test_sums_and_pages(sides, plain):
    fails, unknowns = _by(plain, "fail", match_blocks.HARD), _by(plain, "unknown", match_blocks.HARD)
    want = {}
    for p, (model, r) in plain.items():
        if model is None:
            w = want.setdefault(p[0], dict.fromkeys(match_blocks.SUMS + match_blocks.BY_RULE, 0))
            w["n"] += 1
            w["n_match"] += fails[p] == 0
            w["n_sure"] += fails[p] + unknowns[p] == 0
            for k in match_blocks.HARD:
                w[f"fail_{k}"] += r[k] == "fail"
                w[f"only_{k}"] += r[k] == "fail" and fails[p] == 1
    names = match_blocks.SUMS + match_blocks.BY_RULE
    got = match_blocks.sums(*sides, 1000.0, by_rule=True, block=SMALL).groupBy("search").agg(*[F.sum(k).alias(k) for k in names]).collect()
    assert {x["search"]: {k: x[k] for k in names} for x in got} == want and any(w["n_match"] for w in want.values())
    for tab, shown in (("all", lambda p: True), ("new", lambda p: unknowns[p] == 0), ("unsure", lambda p: unknowns[p] > 0)):
        got = {}
        for x in match_blocks.first(*sides, 1000.0, tab, -F.col("id"), 3, SMALL).collect():
            got.setdefault(x["search"], []).append(x["id"])
        fit = [p for p in plain if plain[p][0] is None and fails[p] == 0 and shown(p)]
        assert {s: sorted(v)[-3:] for s, v in got.items()} == {s: sorted(i for q, i in fit if q == s)[-3:] for s in {q for q, _ in fit}}


def test_pairs(sides, plain):
    fails, oks, unknowns = (_by(plain, k, match_blocks.HARD) for k in ("fail", "ok", "unknown"))
    for keep, good in (("match", lambda p: fails[p] == 0), ("ok2", lambda p: oks[p] >= 2)):
        want = sorted((*p, fails[p], oks[p], unknowns[p], sum(r[k] == "ok" for k in match_blocks.SOFT), sum(r[k] == "fail" for k in match_blocks.SOFT), ",".join(k for k in match_blocks.HARD if r[k] == "unknown")) for p, (m, r) in plain.items() if m is None and good(p))
        assert sorted(map(tuple, match_blocks.pairs(*sides, 1000.0, keep, SMALL).collect())) == want and want


def test_states(sides, plain):
    for rule in match_blocks.HARD + match_blocks.SOFT:
        got = {(x["search"], x["id"]): x["result"] for x in match_blocks.states(*sides, 1000.0, rule, SMALL).collect()}
        assert got == {p: r[rule] for p, (_, r) in plain.items() if r[rule] is not None}, rule


def test_no_pairs_in_sums(spark, sides):
    """40,000 searches on 40,000 offers of one kind: 1.6 billion pairs are added up, none is made."""
    s = spark.range(40_000).select(F.col("id").alias("search")).join(sides[0].filter("search = 0").drop("search")).withColumn("make", F.lit(None).cast("string")).withColumn("model", F.lit(None).cast("string")).withColumn("body_types", F.lit("suv"))
    o = spark.range(40_000).join(sides[1].filter("id = 0").drop("id")).withColumn("body_type", F.lit("suv"))
    assert match_blocks.sums(s, o, 1000.0).agg(F.sum("n")).first()[0] == 1_600_000_000
