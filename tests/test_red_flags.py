"""The nineteen flags against plain conditions on random offers, and the bands of the price's text."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from lotlens.operators import red_flags as R

FIELDS = "title string, description string, enriched boolean, year int, km long, diff_pct double, suspicious boolean, price_partial boolean, repost_of long, belt boolean, seller_type string, dealer_inferred boolean, seller_count int, stated_price double, stated_year int, stated_km long, single_owner boolean, service_history boolean, timing_belt_changed boolean, damage_mentioned boolean, commercial_use boolean, vtv_current boolean, pairs array<string>"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
DAMAGE = re.compile(r"\b(chocad[oa]s?|siniestrad[oa]s?|granizad[oa]s?|volcad[oa]s?|incendiad[oa]s?|con choque|para reparar|para arreglar)\b")
TEXTS = ["", "Único dueño", "Service oficial", "Cambié la correa", "x" * 149, "y" * 150, "Primera mano, servicios oficiales, kit de distribución " * 4]


def offer(rng):
    maybe = [None, True, False]
    pick = rng.choice
    return dict(title=pick([None, "Gol", "Gol CHOCADO", "Gol sin choques", "Gol nunca fue chocado", "chocado, no volcado", "Para reparar"]), description=pick([None, *TEXTS]), enriched=pick(maybe), year=pick([None, 2001, 2015, 2024]), km=pick([None, 0, 10_000, 60_000]), diff_pct=pick([None, -3.0, 24.9, 25.0, 34.4, 34.6, 49.4, 49.6]), suspicious=pick(maybe), price_partial=pick(maybe), repost_of=pick([None, 7]), belt=pick(maybe), seller_type=pick([None, "private", "dealer"]), dealer_inferred=pick(maybe), seller_count=pick([None, 6]), stated_price=pick([None, 0.0, 9.0]), stated_year=pick([None, 2001, 2016]), stated_km=pick([None, 0, 15_000, 15_001, 66_000, 66_667]), single_owner=pick(maybe), service_history=pick(maybe), timing_belt_changed=pick(maybe), damage_mentioned=pick(maybe), commercial_use=pick(maybe), vtv_current=pick(maybe), pairs=pick([None, [], ["duplicate_photos"], ["cross_source_data", None], ["cross_source_photos", "duplicate_photos"]]))


def plain(s):
    return (s or "").lower().translate(str.maketrans("áéíóúñ", "aeioun"))


def expected(o, now=2024):
    text, title = plain(o["description"]), plain(o["title"])
    known = bool(o["description"]) or bool(o["enriched"])
    broken = any(not re.search(r"\b(no|sin|nunca|jamas|cero)\s+(?:\w+\s+)?$", title[: m.start()]) for m in DAMAGE.finditer(title))
    pairs = o["pairs"] or []
    out = set()

    def flag(name, condition):
        if condition:
            out.add(name)

    if known:
        flag("no_owners", o["single_owner"] is not True and not re.search(R.OWNERS, text))
        flag("service_unavailable", o["service_history"] is False)
        flag("no_service", o["service_history"] is None and not re.search(R.SERVICE, text))
        flag("timing_pending", o["timing_belt_changed"] is False)
        flag("no_timing_belt", o["belt"] and o["timing_belt_changed"] is None and not re.search(R.BELT, text))
        flag("short_description", len(text) < 150)
        flag("damage_mentioned", o["damage_mentioned"] is True)
        flag("commercial_use", o["commercial_use"] is True)
    if "damage_mentioned" not in out and broken:
        out.add("damage_mentioned")
        flag("vtv_pending", o["vtv_current"] is False)
    flag("much_cheaper", o["diff_pct"] is not None and o["diff_pct"] >= 25)
    flag("low_km_for_age", o["km"] is not None and o["year"] and o["km"] / max(1, now - o["year"]) < 5000)
    flag("partial_price_suspect", o["suspicious"] or o["price_partial"])
    flag("repost", o["repost_of"])
    flag("private_many_listings", o["seller_type"] == "private" and o["dealer_inferred"] and o["seller_count"] is not None)
    flag("duplicate_photos", "duplicate_photos" in pairs)
    flag("cross_source_duplicate", "cross_source_photos" in pairs or "cross_source_data" in pairs)
    flag("price_mismatch", o["stated_price"])
    flag("year_mismatch", o["year"] and o["stated_year"] and o["year"] != o["stated_year"])
    flag("km_mismatch", o["km"] and o["stated_km"] and abs(o["km"] - o["stated_km"]) > max(5000, 0.1 * max(o["km"], o["stated_km"])))
    return [k for k in R.ORDER if k in out]


def test_as_plain_conditions(spark):
    rng = random.Random(9)
    offers = [offer(rng) for _ in range(800)]
    df = spark.createDataFrame([(k, *[o[n] for n in NAMES]) for k, o in enumerate(offers)], f"k int, {FIELDS}")
    got = {r.k: r.f for r in df.select("k", R.ordered(F.col, F.lit(2024)).alias("f")).collect()}
    for k, o in enumerate(offers):
        assert got[k] == expected(o), o
    assert {f for v in got.values() for f in v} == set(R.ORDER) and len(R.ORDER) == 19


def test_text_of_the_price(spark):
    df = spark.createDataFrame([(x,) for x in (None, 24.9, 25.0, 34.4, 34.6, 49.4, 49.6, 80.0)], "d double")
    assert [r[0] for r in df.select(R.cheaper_text(F.col("d"))).collect()] == [None, None, "much_cheaper", "much_cheaper", "much_cheaper_verify", "much_cheaper_verify", "much_cheaper_anticipo", "much_cheaper_anticipo"]


def test_texts_are_not_copied_to_offers(spark, data):
    """Documents meet offers by what they say: the join has no text, and each is read before it."""
    from lotlens.plans.red_flags import red_flags_all

    plan = red_flags_all(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[: plan.index("Relation")]
    assert " text#" not in joined and "strategy=broadcast" in joined
