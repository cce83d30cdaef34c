"""Which alerts a dealer gets for a car, from the scans of it: four rules over marks that move only when something is told.

A scan is a row of item, at (timestamp), price, median, n (of the market; enough says whether n will do), cheaper_id and
cheaper_price (the cheapest like it nearby that is new since the scan before), since (timestamp; when it came into stock),
model_days and model_n (how long the model takes to sell, and from how many), searches and people (null where the dealer
may not see demand), gone.

market_moved: the median is a tenth away from the mark, the median last told (or first seen). new_demand: searches and people
are at least three over their marks. cheaper_nearby: at least eight percent cheaper, each offer once. slow: once, when the
car has been there longer than one and a half times what its model takes, or 60 days if that isn't known. A scan that is
not newer than the last is ignored; one of a car that is gone ends its state.

told() works scans off as a batch, one fold an item; streaming.alerts does the same in keyed state, a scan at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOVE_PCT, CHEAPER_PCT, LEAST_DEMAND = 10.0, 8.0, 3
SLOW_FACTOR, SLOW_DAYS, LEAST_MODEL_N = 1.5, 60, 5
SCAN = "item long, at timestamp, price double, median double, n long, enough boolean, cheaper_id long, cheaper_price double, since timestamp, model_days int, model_n int, searches long, people long, gone boolean"
ALERT = "item long, at timestamp, kind string, key string, pct double"
_ALERTS = "array<struct<at:timestamp,kind:string,key:string,pct:double>>"


def slow_after(model_days: Column, model_n: Column) -> Column:
    """The days in stock from which a car is slow."""
    known = model_days.isNotNull() & (F.coalesce(model_n, F.lit(0)) >= LEAST_MODEL_N)
    return F.when(known, F.floor(model_days * SLOW_FACTOR).cast("int") + 1).otherwise(SLOW_DAYS)


def days_between(start: Column, end: Column) -> Column:
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / 86_400_000_000).cast("int")


def told(scans: DataFrame, least_demand: int = LEAST_DEMAND) -> DataFrame:
    """(item, at, kind, key, pct) of all alerts. An item's scans are folded in order of time; a car has one a day."""
    rows = F.array_sort(F.collect_list(F.struct("at", "price", "median", "n", "enough", "cheaper_id", "cheaper_price", "since", "model_days", "model_n", "searches", "people", "gone")))
    series = scans.filter(F.col("at").isNotNull()).groupBy("item").agg(rows.alias("s"))
    empty, no_ids = F.array().cast(_ALERTS), F.array().cast("array<bigint>")
    nothing = F.struct(F.lit(None).cast("timestamp").alias("last"), F.lit(None).cast("double").alias("mark"), F.lit(None).cast("bigint").alias("searches"), F.lit(None).cast("bigint").alias("people"), no_ids.alias("cheaper"), F.lit(False).alias("slow"), empty.alias("out"))

    def alert(condition: Column, x: Column, kind: str, key: Column, pct: Column) -> Column:
        one = F.array(F.struct(x["at"].alias("at"), F.lit(kind).alias("kind"), key.alias("key"), pct.cast("double").alias("pct")))
        return F.when(F.coalesce(condition, F.lit(False)), one).otherwise(empty)

    def step(acc: Column, x: Column) -> Column:
        usable = F.coalesce(x["enough"] & (x["median"] > 0), F.lit(False))
        first = usable & (acc["mark"].isNull() | (acc["mark"] <= 0))
        moved = F.round((x["median"] / acc["mark"] - 1) * 100, 1)
        market = F.coalesce(usable & ~first & (F.abs(moved) >= MOVE_PCT), F.lit(False))
        pct = F.round((1 - x["cheaper_price"] / x["price"]) * 100)
        cheaper = F.coalesce((x["price"] > 0) & (x["cheaper_price"] > 0) & (pct >= CHEAPER_PCT) & ~F.array_contains(acc["cheaper"], x["cheaper_id"]), F.lit(False))
        slow = F.coalesce(~acc["slow"] & (days_between(x["since"], x["at"]) >= slow_after(x["model_days"], x["model_n"])), F.lit(False))
        seen = x["searches"].isNotNull() & x["people"].isNotNull()
        new = seen & acc["people"].isNull()
        demand = F.coalesce(seen & (x["people"] - acc["people"] >= least_demand) & (x["searches"] - acc["searches"] >= least_demand), F.lit(False))
        found = F.concat(
            acc["out"],
            alert(market, x, "market_moved", F.when(moved < 0, "down").otherwise("up"), moved),
            alert(cheaper, x, "cheaper_nearby", x["cheaper_id"].cast("string"), pct),
            alert(slow, x, "slow", F.lit(""), F.lit(None)),
            alert(demand, x, "new_demand", F.concat_ws(":", x["searches"].cast("string"), x["people"].cast("string")), F.lit(None)),
        )
        after = F.struct(
            x["at"].alias("last"),
            F.when(first | market, x["median"]).otherwise(acc["mark"]).alias("mark"),
            F.when(new | demand, x["searches"]).otherwise(acc["searches"]).alias("searches"),
            F.when(new | demand, x["people"]).otherwise(acc["people"]).alias("people"),
            F.when(cheaper, F.concat(acc["cheaper"], F.array(x["cheaper_id"]))).otherwise(acc["cheaper"]).alias("cheaper"),
            (acc["slow"] | slow).alias("slow"),
            found.alias("out"),
        )
        ended = F.struct(x["at"].alias("last"), nothing["mark"].alias("mark"), nothing["searches"].alias("searches"), nothing["people"].alias("people"), no_ids.alias("cheaper"), F.lit(False).alias("slow"), acc["out"].alias("out"))
        stale = F.coalesce(x["at"] <= acc["last"], F.lit(False))
        return F.when(stale, acc).when(F.coalesce(x["gone"], F.lit(False)), ended).otherwise(after)

    return series.select("item", F.explode(F.aggregate("s", nothing, step, lambda a: a["out"])).alias("x")).select("item", "x.*")
