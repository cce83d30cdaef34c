"""What the market of each search costs and has run, told from sums of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spreads import spreads
from .base import query
from .cars import CTES, cars, profiles

_GROUP = "CASE WHEN make IS NULL THEN 'body ' || body_types WHEN model IS NULL THEN 'make ' || make ELSE 'model ' || make || ' ' || model END"


@query(f"""WITH {CTES},
asked AS (SELECT search, make, model, body_types, year_min, year_max FROM profiles WHERE make IS NOT NULL OR body_types IS NOT NULL),
o AS (SELECT make, model, body_type, year, CASE WHEN NOT price_partial THEN price_usd END AS price, km FROM cars),
met AS (
  SELECT search, o.* FROM asked a JOIN o ON o.make = a.make AND o.model = a.model WHERE a.model IS NOT NULL AND ((year_min IS NULL AND year_max IS NULL) OR year BETWEEN coalesce(year_min, 0) AND coalesce(year_max, 9999))
  UNION ALL SELECT search, o.* FROM asked a JOIN o ON o.make = a.make WHERE a.model IS NULL AND ((year_min IS NULL AND year_max IS NULL) OR year BETWEEN coalesce(year_min, 0) AND coalesce(year_max, 9999))
  UNION ALL SELECT search, o.* FROM asked a JOIN o ON list_contains(string_split(a.body_types, ','), o.body_type) WHERE a.make IS NULL AND ((year_min IS NULL AND year_max IS NULL) OR year BETWEEN coalesce(year_min, 0) AND coalesce(year_max, 9999)))
SELECT search, count(price) AS n_price, round(min(price), 4) AS price_least, round(median(price), 4) AS price_median, round(max(price), 4) AS price_most,
  count(km) AS n_km, CAST(min(km) AS DOUBLE) AS km_least, median(km) AS km_median, CAST(max(km) AS DOUBLE) AS km_most FROM met GROUP BY search HAVING count(price) + count(km) > 0
""")
def market_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each search the least, median and most of price and mileage over the offers of its vehicle, make or body types and years."""
    searches = profiles(spark, sf_dir).select("search", F.expr(_GROUP).alias("g"), "make", "body_types", "year_min", "year_max").filter("g IS NOT NULL")
    o = cars(spark, sf_dir).select("make", "model", "body_type", "year", F.when(~F.col("price_partial"), F.col("price_usd")).alias("price"), "km")
    kinds = searches.filter("make IS NULL").select("body_types").distinct().select("body_types", F.explode(F.split("body_types", ",")).alias("body_type"))
    groups = F.explode(F.array(F.concat(F.lit("make "), F.col("make")), F.concat(F.lit("model "), F.col("make"), F.lit(" "), F.col("model"))))
    named = o.select(groups.alias("g"), "year", "price", "km").filter("g IS NOT NULL").unionByName(o.join(kinds, "body_type").select(F.concat(F.lit("body "), F.col("body_types")).alias("g"), "year", "price", "km"))
    named = named.join(searches.select("g").distinct(), "g", "left_semi")
    found = spreads(named, searches.select("g", F.col("year_min").alias("y0"), F.col("year_max").alias("y1")))
    wide = found.groupBy("g", "y0", "y1").agg(*[x for k in ("price", "km") for x in [F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"n_{k}"), *[F.round(F.max(F.when(F.col("kind") == k, F.col(c))), 4).alias(f"{k}_{c}") for c in ("least", "median", "most")]]])
    same = (searches["g"] == wide["g"]) & searches["year_min"].eqNullSafe(wide["y0"]) & searches["year_max"].eqNullSafe(wide["y1"])
    return searches.join(wide, same).select("search", *[c for c in wide.columns if c not in ("g", "y0", "y1")])
