"""Offers and saved searches with all the fields that the match rules read, made from the driver's tables.

The views are plain SQL that Spark and DuckDB read alike, so an operator and its twin start from the same rows. A model has
some four parts at any size, so a search meets about as many offers however large the tables are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .base import LISTINGS, table

#: Quote of the dollar that prices without a frozen one are turned by.
FX = 1000.0

CARS = """
cars AS (
  SELECT l.id, CASE l.source WHEN 'A' THEN 'alpha' WHEN 'N' THEN 'nova' ELSE 'directo' END AS source, l.make,
    CASE WHEN l.id % 29 = 0 THEN NULL ELSE l.model || ' ' || CAST(CAST(floor(l.part / 4) AS BIGINT) AS VARCHAR(20)) END AS model,
    CASE WHEN l.id % 31 = 0 THEN NULL ELSE l.year END AS year,
    CASE WHEN l.id % 17 = 0 THEN NULL WHEN l.id % 5 = 0 THEN l.price * 1000 ELSE l.price END AS price,
    CASE l.id % 5 WHEN 0 THEN 'ARS' WHEN 4 THEN NULL ELSE 'USD' END AS currency,
    CASE WHEN l.id % 17 = 0 OR (l.id % 5 = 0 AND l.id % 3 = 0) THEN NULL ELSE l.price END AS price_usd,
    l.id % 11 = 0 AS price_partial, CAST(l.km * 4000 AS BIGINT) AS km,
    CASE l.id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Autom' || chr(225) || 'tica CVT' WHEN 2 THEN 'automatica' ELSE 'Manual' END AS transmission,
    CASE l.id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Nafta/GNC' WHEN 2 THEN 'Di' || chr(233) || 'sel' ELSE 'Nafta' END AS fuel,
    CASE l.part % 5 WHEN 0 THEN NULL WHEN 1 THEN 'suv' WHEN 2 THEN 'pickup' WHEN 3 THEN 'hatchback' ELSE 'sedan' END AS body_type,
    CASE l.id % 9 WHEN 0 THEN 'blanco' WHEN 1 THEN 'negro' WHEN 2 THEN 'gris' WHEN 3 THEN 'rojo' ELSE NULL END AS color,
    CASE l.id % 10 WHEN 4 THEN 'verde:40,azul:20' WHEN 5 THEN 'blanco:29,negro:71' WHEN 3 THEN 'gris:30' ELSE NULL END AS maybe_colors,
    CASE WHEN l.id % 19 = 0 THEN NULL ELSE -25.0 - (l.seller % 13) END AS lat, CASE WHEN l.id % 19 = 0 THEN NULL ELSE -58.0 - (l.seller % 11) END AS lon,
    CASE l.id % 3 WHEN 0 THEN 'private' WHEN 1 THEN 'dealer' ELSE NULL END AS seller_type, l.id % 8 = 0 AS dealer_inferred,
    CASE WHEN l.id % 23 = 0 THEN l.seller END AS dealer, CASE l.id % 4 WHEN 0 THEN 'available' WHEN 1 THEN 'reserved' WHEN 2 THEN 'sold' ELSE NULL END AS dealer_status,
    CASE l.part % 6 WHEN 0 THEN NULL WHEN 1 THEN '1.6 Titanium' WHEN 2 THEN 'SE Plus' WHEN 3 THEN 'XLT 4x4' WHEN 4 THEN 'up! High' ELSE 'Titanium' END AS trim,
    l.seller, l.seen, l.discount, l.tax, l.part, CASE WHEN l.id % 13 = 0 THEN 'gone' ELSE 'active' END AS status,
    CASE WHEN l.id % 37 = 0 THEN l.id - 37 END AS repost_of
  FROM listings l)
"""

SEARCHES = """
profiles AS (
  SELECT c_custkey AS search, CASE WHEN c_custkey % 20 IN (0, 1) THEN NULL ELSE p_brand END AS make,
    CASE WHEN c_custkey % 20 IN (0, 1) OR c_custkey % 20 = 2 THEN NULL ELSE p_type || ' ' || CAST(CAST(floor(p_partkey / 4) AS BIGINT) AS VARCHAR(20)) END AS model,
    CASE c_custkey % 4 WHEN 0 THEN NULL ELSE 1993 + c_custkey % 5 END AS year_min, CASE c_custkey % 3 WHEN 0 THEN NULL ELSE 1999 + c_custkey % 3 END AS year_max,
    CASE WHEN c_custkey % 11 = 0 THEN '1994,1996,1998' END AS years,
    CASE WHEN c_custkey % 6 = 1 THEN 10000.0 END AS price_min,
    CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 6 = 5 THEN 60000000.0 ELSE 30000.0 + c_acctbal * 4 END AS price_max,
    CASE c_custkey % 5 WHEN 0 THEN 'usd' WHEN 1 THEN 'ARS' ELSE NULL END AS currency,
    CASE WHEN c_custkey % 7 = 0 THEN 20000 END AS km_min, CASE WHEN c_custkey % 4 = 1 THEN 120000 END AS km_max,
    CASE c_custkey % 6 WHEN 1 THEN 'Manual' WHEN 2 THEN 'autom' || chr(225) || 'tica' ELSE NULL END AS transmission,
    CASE c_custkey % 7 WHEN 1 THEN 'gnc' WHEN 2 THEN 'Diesel' ELSE NULL END AS fuel,
    CASE WHEN c_custkey % 20 = 0 THEN 'suv' WHEN c_custkey % 9 = 3 THEN 'suv,sedan' END AS body_types,
    CASE c_custkey % 8 WHEN 1 THEN 'blanco,negro' WHEN 2 THEN 'verde' ELSE NULL END AS colors,
    CASE WHEN c_custkey % 5 = 2 THEN -25.0 - c_nationkey % 13 END AS lat, CASE WHEN c_custkey % 5 = 2 THEN -58.0 - c_nationkey % 11 END AS lon,
    CASE WHEN c_custkey % 5 = 2 THEN 250.0 END AS radius, CASE WHEN c_custkey % 10 = 2 THEN '-30;-60;400|-33;-65;150' END AS extra_zones,
    CASE WHEN c_custkey % 6 = 4 THEN 'alpha,nova' END AS sources,
    CASE c_custkey % 9 WHEN 1 THEN 'private' WHEN 2 THEN 'dealer' WHEN 3 THEN 'private,dealer' ELSE NULL END AS seller_types, c_custkey % 2 = 0 AS seller_filter,
    CASE c_custkey % 7 WHEN 3 THEN 'titanium' WHEN 4 THEN 'up high|Plus' ELSE NULL END AS trims, c_custkey % 14 = 3 AS trim_strict,
    CASE WHEN c_custkey % 5 = 3 THEN 80000 END AS km_target, CASE WHEN c_custkey % 5 = 4 THEN 25000.0 END AS price_target,
    CASE WHEN c_custkey % 10 = 2 THEN 300.0 END AS max_distance, c_nationkey AS zone, c_mktsegment AS segment
  FROM customer JOIN part ON p_partkey = c_custkey * 4 % 200)
"""

DAYS = 90
FRESH = f"fresh AS (SELECT c.* FROM cars c, (SELECT max(seen) AS now FROM cars) n WHERE seen > now - {DAYS})"

#: The searches with the fresh offers that can be theirs: by model, by make alone, and by body type alone.
PAIRS = """
pairs AS (
  SELECT p.search, c.id FROM profiles p JOIN fresh c ON p.make = c.make AND p.model = c.model
  UNION ALL SELECT p.search, c.id FROM profiles p JOIN fresh c ON p.make = c.make WHERE p.model IS NULL
  UNION ALL SELECT p.search, c.id FROM profiles p JOIN fresh c ON list_contains(string_split(p.body_types, ','), c.body_type) WHERE p.make IS NULL AND p.model IS NULL)
"""
CTES = f"{LISTINGS}, {CARS}, {SEARCHES}"

_TABLES = ("customer", "lineitem", "part")


def view(spark: SparkSession, sf_dir: str, name: str, *more: str) -> DataFrame:
    """The rows of a view above, or of one of the further ones given."""
    for t in _TABLES:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(f"WITH {', '.join((CTES, *more))} SELECT * FROM {name}")


def cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "cars")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "profiles")
