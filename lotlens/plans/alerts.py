"""The dealer alerts of every make, a scan a month, folded over marks that move only when something is told."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts
from .base import query
from .cars import CTES, view

SCANS = """
months AS (
  SELECT make, CAST(date_trunc('month', seen) AS DATE) AS month, count(*) AS n, median(price_usd) AS mid, max(CASE WHEN id % 3 = 0 THEN price_usd END) AS price, min(CASE WHEN id % 9 = 0 THEN id END) AS cheaper_id,
    count(CASE WHEN id % 7 = 0 THEN 1 END) AS searches, count(DISTINCT CASE WHEN id % 7 = 0 THEN seller END) AS people
  FROM cars WHERE price_usd > 0 GROUP BY make, CAST(date_trunc('month', seen) AS DATE)),
scans AS (
  SELECT CAST(replace(make, 'Brand#', '') AS BIGINT) AS item, CAST(month AS TIMESTAMP) AS moment, price, mid AS median, n, n >= 5 AS enough, cheaper_id, price * CAST(80 + n % 15 AS DOUBLE) / 100 AS cheaper_price,
    CAST(min(month) OVER (PARTITION BY make) AS TIMESTAMP) AS since, CAST(CASE WHEN n % 2 = 0 THEN 200 + n % 5 END AS INTEGER) AS model_days, CAST(n % 9 AS INTEGER) AS model_n,
    CASE WHEN n % 11 > 0 THEN searches END AS searches, CASE WHEN n % 11 > 0 THEN people END AS people, year(month) = 1996 AND month(month) = 6 AS gone
  FROM months)
"""


@query(f"""WITH RECURSIVE {CTES}, {SCANS},
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY moment) AS k FROM scans),
f AS (
  SELECT item, CAST(0 AS BIGINT) AS k, NULL::TIMESTAMP AS moment, NULL::DOUBLE AS mark, NULL::BIGINT AS s, NULL::BIGINT AS p, []::BIGINT[] AS c, false AS slow, NULL::DOUBLE AS moved, NULL::DOUBLE AS pct, NULL::BIGINT AS cheaper, false AS is_slow, NULL::VARCHAR AS demand FROM r WHERE k = 1
  UNION ALL
  SELECT item, k, moment, CASE WHEN gone THEN NULL WHEN first OR moved IS NOT NULL THEN median ELSE mark END, CASE WHEN gone THEN NULL WHEN new OR demand IS NOT NULL THEN searches ELSE s END, CASE WHEN gone THEN NULL WHEN new OR demand IS NOT NULL THEN people ELSE p END,
    CASE WHEN gone THEN [] WHEN cheaper IS NOT NULL THEN list_append(c, cheaper) ELSE c END, NOT gone AND (slow OR is_slow), moved, CASE WHEN cheaper IS NOT NULL THEN pct END, cheaper, is_slow, demand
  FROM (
    SELECT r.*, f.mark, f.s, f.p, f.c, f.slow, coalesce(r.enough AND r.median > 0, false) AND coalesce(f.mark <= 0, true) AS first, r.searches IS NOT NULL AND r.people IS NOT NULL AND f.p IS NULL AS new,
      CASE WHEN NOT r.gone AND r.enough AND r.median > 0 AND f.mark > 0 AND abs(round((r.median / f.mark - 1) * 100, 1)) >= 10 THEN round((r.median / f.mark - 1) * 100, 1) END AS moved,
      round((1 - r.cheaper_price / r.price) * 100) AS pct,
      CASE WHEN NOT r.gone AND r.price > 0 AND r.cheaper_price > 0 AND round((1 - r.cheaper_price / r.price) * 100) >= 8 AND NOT list_contains(f.c, r.cheaper_id) THEN r.cheaper_id END AS cheaper,
      NOT r.gone AND NOT f.slow AND date_diff('day', r.since, r.moment) >= CASE WHEN r.model_days IS NOT NULL AND r.model_n >= 5 THEN floor(r.model_days * 1.5) + 1 ELSE 60 END AS is_slow,
      CASE WHEN NOT r.gone AND r.people - f.p >= 3 AND r.searches - f.s >= 3 THEN r.searches || ':' || r.people END AS demand
    FROM f JOIN r ON r.item = f.item AND r.k = f.k + 1))
SELECT item, CAST(moment AS DATE) AS day, 'market_moved' AS kind, CASE WHEN moved < 0 THEN 'down' ELSE 'up' END AS key, moved AS pct FROM f WHERE moved IS NOT NULL
UNION ALL SELECT item, CAST(moment AS DATE), 'cheaper_nearby', CAST(cheaper AS VARCHAR), pct FROM f WHERE cheaper IS NOT NULL
UNION ALL SELECT item, CAST(moment AS DATE), 'slow', '', NULL FROM f WHERE is_slow
UNION ALL SELECT item, CAST(moment AS DATE), 'new_demand', demand, NULL FROM f WHERE demand IS NOT NULL""")
def dealer_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four rules over the months of each make. The stream of the same rules is streaming.alerts."""
    return alerts.told(view(spark, sf_dir, "scans", SCANS).withColumnRenamed("moment", "at")).select("item", F.to_date("at").alias("day"), "kind", "key", "pct")
