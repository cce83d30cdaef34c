"""News and old stock of the reads of every source, make and model group, a read a month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import news
from .base import query
from .cars import CTES, view

#: Two targets for each source and make: one for all its models, whose bounds widen, and one with bounds of its own.
READS = """
months AS (SELECT source, make, CAST(date_trunc('month', seen) AS DATE) AS month, count(*) AS n FROM cars GROUP BY source, make, CAST(date_trunc('month', seen) AS DATE)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source, make ORDER BY month) AS k FROM months),
reads AS (
  SELECT source || ' ' || make AS target, month AS moment, source, make, 'any' AS model, CAST(1996 - floor(k / 25) AS INTEGER) AS year_min, CAST(1998 + floor(k / 30) AS INTEGER) AS year_max,
    CASE WHEN k > 50 THEN NULL ELSE 120000 + 10000 * (k % 3) END AS km_max, CASE WHEN k > 20 THEN 1 ELSE 0 END AS band, k % 7 <> 3 AS ok, k % 7 <> 3 AND k % 5 <> 2 AND k > 1 AS complete, CASE WHEN k % 4 = 0 THEN 0 ELSE n END AS found
  FROM numbered
  UNION ALL SELECT source || ' ' || make || ' beside', month, source, make, 'any', CAST(1993 AS INTEGER), CAST(1997 AS INTEGER), NULL, 0, true, k % 3 = 0, n FROM numbered),
stored AS (
  SELECT target, moment, c.id, c.make, 'any' AS model, c.year, c.km, c.id % 11 = 0 AS dated
  FROM reads r JOIN cars c ON c.source = r.source AND c.make = r.make AND CAST(date_trunc('month', c.seen) AS DATE) = r.moment
  WHERE c.id % 2 = 0 AND (c.year IS NULL OR (c.year >= r.year_min - r.band AND c.year <= r.year_max + r.band)) AND (c.km IS NULL OR r.km_max IS NULL OR c.km <= r.km_max))
"""
_OUT = "(coalesce(s.year < {b}_min, false) OR coalesce(s.year > {b}_max, false) OR coalesce(s.km > {b}_km, false))"
_BEYOND = "(coalesce(s.year < {b}_min, false) OR coalesce(s.year > {b}_max, false))"


@query(f"""WITH {CTES}, {READS},
sent AS (SELECT *, year_min - band AS s_min, year_max + band AS s_max, km_max AS s_km FROM reads),
prior AS (SELECT r.target, r.moment, max(p.moment) AS was FROM reads r JOIN reads p ON p.target = r.target AND p.moment < r.moment AND p.complete GROUP BY ALL),
last AS (SELECT r.target, r.moment, p.found, row_number() OVER (PARTITION BY r.target, r.moment ORDER BY p.moment DESC) AS k FROM reads r JOIN reads p ON p.target = r.target AND p.moment < r.moment AND p.ok AND p.found > 0),
good AS (SELECT DISTINCT r.target, r.moment FROM reads r JOIN reads p ON p.target = r.target AND p.moment < r.moment AND p.ok),
base AS (SELECT g.target, g.moment, coalesce(max(l.found) FILTER (WHERE k <= 3), 0) AS base FROM good g LEFT JOIN last l ON l.target = g.target AND l.moment = g.moment GROUP BY ALL),
j AS (
  SELECT s.*, r.source, r.year_min AS o_min, r.year_max AS o_max, r.band, e.s_min AS e_min, e.s_max AS e_max, e.s_km AS e_km, p.was, b.base
  FROM stored s JOIN sent r ON r.target = s.target AND r.moment = s.moment LEFT JOIN prior p ON p.target = s.target AND p.moment = s.moment LEFT JOIN sent e ON e.target = p.target AND e.moment = p.was LEFT JOIN base b ON b.target = s.target AND b.moment = s.moment),
m AS (SELECT s.*, band > 0 AND {_BEYOND.format(b='o')} AS in_band, count(*) FILTER (WHERE NOT (band > 0 AND {_BEYOND.format(b='o')})) OVER (PARTITION BY target, moment) AS fresh FROM j s),
x AS (SELECT s.*, was IS NOT NULL AND CASE WHEN in_band THEN {_BEYOND.format(b='e')} ELSE {_OUT.format(b='e')} END AS left_out FROM m s),
siblings AS (SELECT p.*, year_min AS o_min, year_max AS o_max, km_max AS o_km FROM sent p),
covered AS (
  SELECT DISTINCT s.target, s.moment, s.id FROM x s JOIN siblings o ON o.source = s.source AND o.make = s.make AND o.target <> s.target AND o.complete AND o.moment < s.moment
  WHERE s.left_out AND o.moment = (SELECT max(q.moment) FROM siblings q WHERE q.target = o.target AND q.complete AND q.moment < s.moment) AND NOT {_OUT.format(b='o.o')} AND NOT {_OUT.format(b='o.s')})
SELECT x.target, x.moment AS day, x.id, CASE WHEN dated THEN 'dated' WHEN was IS NULL THEN 'first_run' WHEN NOT in_band AND fresh >= 5 AND 2 * fresh >= base THEN 'step' WHEN left_out AND c.id IS NULL AND in_band THEN 'band' WHEN left_out AND c.id IS NULL THEN 'envelope' ELSE 'news' END AS reason
FROM x LEFT JOIN covered c ON c.target = x.target AND c.moment = x.moment AND c.id = x.id
""")
def news_by_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each listing that a read stored first is news or not."""
    reads = view(spark, sf_dir, "reads", READS).withColumnRenamed("moment", "at")
    fresh = view(spark, sf_dir, "stored", READS).withColumnRenamed("moment", "at")
    return news.classify(reads, fresh).withColumnRenamed("at", "day")
