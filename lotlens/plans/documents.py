"""Documents put together from events, as variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variants as V
from .base import query, table


@query("""
WITH e AS (SELECT user_id, event_type, event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events),
last AS (SELECT user_id, event_type, arg_max(k, event_id) AS k FROM e GROUP BY ALL),
per AS (SELECT user_id, count(*) AS n, min(k) AS lo, max(k) AS hi FROM e GROUP BY user_id),
fields AS (
  SELECT user_id, event_type AS key, CAST(k AS VARCHAR) AS v FROM last WHERE event_type <> 'error'
  UNION ALL SELECT user_id, 'n', CAST(n AS VARCHAR) FROM per
  UNION ALL SELECT user_id, 'odd', CAST(n AS VARCHAR) FROM per WHERE n % 2 = 1
  UNION ALL SELECT user_id, 'zone', '{' || CASE WHEN hi % 3 > 0 THEN '"hi":' || hi || ',' ELSE '' END || '"lo":' || lo || ',"mid":' || (hi - lo) || '}' FROM per),
errors AS (SELECT user_id, 'number' AS kind FROM last WHERE event_type = 'error')
SELECT user_id, '{' || string_agg('"' || key || '":' || v, ',' ORDER BY key) || '}' AS document, any_value(errors.kind) AS error_kind FROM fields LEFT JOIN errors USING (user_id) GROUP BY user_id
""")
def variant_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user the last value of each kind of event as one object, merged with counts, one key dropped, a nested one set,
    and nulls stripped."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
    per = events.groupBy("user_id").agg(V.object_agg(F.col("event_type"), F.col("k").cast("variant"), F.col("event_id")).alias("doc"), F.count(F.lit(1)).alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    zone = V.built(lo=F.col("lo"), hi=F.when(F.col("hi") % 3 > 0, F.col("hi")))
    patch = V.built(n=F.col("n"), odd=F.when(F.col("n") % 2 == 1, F.col("n")), zone=zone)
    whole = per.select("user_id", "lo", "hi", V.merged(F.col("doc"), patch).alias("d"))
    whole = whole.select("user_id", F.col("d"), V.set_path(V.without(F.col("d"), "error"), ["zone", "mid"], (F.col("hi") - F.col("lo")).cast("variant")).alias("s"))
    return whole.select("user_id", F.to_json(V.stripped(F.col("s"))).alias("document"), V.kind(F.element_at(V.entries(F.col("d")), "error")).alias("error_kind"))
