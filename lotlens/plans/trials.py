"""What the trials of customers admit of the offers that their orders brought."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.admission import admitted
from .base import query, table

LIMIT, STOCK_MOST, DAYS = 12, 4, 15
ATTEMPTS = f"""
attempts AS (
  SELECT o_custkey AS person, l_partkey AS listing, l_shipdate AS at_time,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber % 3 = 0 OR date_diff_days > {DAYS * 5} END AS stock
  FROM (SELECT o_custkey, l_partkey, l_shipdate, l_linenumber, {{days}} AS date_diff_days FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'))
"""


@query(f"""WITH RECURSIVE {ATTEMPTS.format(days="date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))")},
tries AS (SELECT person, listing, at_time, coalesce(stock, true) AS stock, row_number() OVER (PARTITION BY person ORDER BY at_time, listing, coalesce(stock, true) DESC) AS k FROM attempts),
f AS (
  SELECT person, CAST(0 AS BIGINT) AS k, []::BIGINT[] AS inside, 0 AS old, NULL::BIGINT AS listing, NULL::TIMESTAMP AS at_time, NULL::BOOLEAN AS stock FROM tries WHERE k = 1
  UNION ALL
  SELECT t.person, t.k, CASE WHEN t.ok THEN list_append(t.inside, t.listing) ELSE t.inside END, t.old + CASE WHEN t.ok AND t.stock THEN 1 ELSE 0 END, CASE WHEN t.ok THEN t.listing END, t.at_time, t.stock
  FROM (SELECT r.*, f.inside, f.old, len(f.inside) < {LIMIT} AND NOT list_contains(f.inside, r.listing) AND NOT (r.stock AND f.old >= {STOCK_MOST}) AS ok FROM f JOIN tries r ON r.person = f.person AND r.k = f.k + 1) t)
SELECT person, listing, CAST(at_time AS DATE) AS day, stock, len(inside) AS place FROM f WHERE listing IS NOT NULL
""")
def trial_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twin admits attempt by attempt, as the trigger of a database would; here both caps are row numbers."""
    for t in ("orders", "lineitem"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    attempts = spark.sql(f"WITH {ATTEMPTS.format(days='datediff(CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE))')} SELECT person, listing, at_time AS at, stock FROM attempts")
    return admitted(attempts, LIMIT, STOCK_MOST).select("person", "listing", F.to_date("at").alias("day"), "stock", F.col("place").cast("long").alias("place"))
