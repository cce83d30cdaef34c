"""Ingest: upserts with change logs, insert-if-absent, target sync, normalization of one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from .base import ORACLE, query, table, tables


def _batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders before a date are what is there; later ones of the same customer are the batch, keyed by customer and priority."""
    o = table(spark, sf_dir, "orders")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    cols = [F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("source"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")).alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq")]
    old, new = o.filter(F.col("o_orderdate") < cut).select(*cols), o.filter(F.col("o_orderdate") >= cut).select(*cols)
    return merge.last_of_each(old, ["key", "source"], ["at", "seq"]), new


_UPSERT = """
WITH r AS (SELECT o_custkey AS key, o_orderpriority AS source, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS price, o_orderstatus AS status, o_orderdate AS seen_at, o_orderkey AS seq, o_orderdate >= TIMESTAMP '1998-01-01' AS fresh FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY key, source, fresh ORDER BY seen_at DESC, seq DESC) AS n FROM r),
c AS (SELECT * FROM k WHERE n = 1 AND NOT fresh), b AS (SELECT * FROM k WHERE n = 1 AND fresh),
m AS (SELECT coalesce(c.key, b.key) AS key, coalesce(c.source, b.source) AS source, coalesce(b.price, c.price) AS price, coalesce(b.status, c.status) AS status, coalesce(b.seq, c.seq) AS seq,
  CASE WHEN c.key IS NULL THEN 'new' WHEN b.key IS NULL THEN NULL WHEN b.price IS NOT NULL AND b.price IS DISTINCT FROM c.price THEN 'price' WHEN b.status <> c.status THEN 'status' END AS change
  FROM c FULL OUTER JOIN b ON c.key = b.key AND c.source = b.source)
"""


@query(_UPSERT + "SELECT key, source, price, status, seq, change FROM m")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, batch = _batches(spark, sf_dir)
    return merge.upsert(current, batch, ["key", "source"], ["at", "seq"], ["price", "status"]).select("key", "source", "price", "status", "seq", "change")


@query(_UPSERT + "SELECT coalesce(change, 'same') AS change, count(*) AS n, CAST(count(DISTINCT key) AS BIGINT) AS keys FROM m GROUP BY 1")
def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of an upsert by kind of change."""
    current, batch = _batches(spark, sf_dir)
    out = merge.upsert(current, batch, ["key", "source"], ["at", "seq"], ["price", "status"])
    return out.groupBy(F.coalesce("change", F.lit("same")).alias("change")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys"))


@query("""
WITH o AS (SELECT o_custkey AS u, o_orderstatus AS s, coalesce(o_orderdate < TIMESTAMP '2000-01-01', false) AS old FROM orders),
cur AS (SELECT DISTINCT u, s FROM o WHERE old), new AS (SELECT DISTINCT u, s FROM o WHERE NOT old)
SELECT u, s FROM cur UNION SELECT u, s FROM new
""")
def insert_if_absent_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is on one side: those before 2000 are there, those since then and those without a date come in."""
    old = F.coalesce(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"), F.lit(False))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("u"), F.col("o_orderstatus").alias("s"), old.alias("old"))
    return merge.insert_absent(o.filter("old").select("u", "s").distinct(), o.filter("NOT old").select("u", "s"), ["u", "s"])


query(ORACLE["insert_if_absent_whole"], name="insert_if_absent")(insert_if_absent_whole)  # under its older name, which once read a part only


@query("""
WITH c AS (SELECT p_brand AS make, p_type AS model, max(p_size) AS cap FROM part WHERE p_partkey % 3 > 0 GROUP BY 1, 2), d AS (SELECT p_brand AS make, p_type AS model, max(p_size) AS cap FROM part WHERE p_partkey % 4 > 0 GROUP BY 1, 2)
SELECT coalesce(c.make, d.make) AS make, coalesce(c.model, d.model) AS model, CASE WHEN c.make IS NULL THEN 'insert' WHEN d.make IS NULL THEN 'delete' ELSE 'update' END AS action FROM c FULL OUTER JOIN d ON c.make = d.make AND c.model = d.model WHERE c.cap IS DISTINCT FROM d.cap
""")
def target_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a table of targets has to change to become what is wanted."""
    part = table(spark, sf_dir, "part")
    of = lambda c: part.filter(c).groupBy(F.col("p_brand").alias("make"), F.col("p_type").alias("model")).agg(F.max("p_size").alias("cap"))
    return merge.set_difference(of("p_partkey % 3 > 0"), of("p_partkey % 4 > 0"), ["make", "model"], ["cap"])


@query("""
WITH s AS (SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_returnflag = 'R'), c AS (SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01')
SELECT p_brand AS make, count(*) AS missing FROM s JOIN part ON part = p_partkey WHERE part NOT IN (SELECT part FROM c) GROUP BY 1
""")
def missing_from_complete_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = tables(spark, sf_dir, "lineitem", "part")
    stock = line.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct()
    read = line.filter(F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).select(F.col("l_partkey").alias("p_partkey"))
    return stock.join(read, "p_partkey", "left_anti").join(part, "p_partkey").groupBy(F.col("p_brand").alias("make")).agg(F.count(F.lit(1)).alias("missing"))


@query("""
SELECT o_custkey AS source, strftime(max(o_orderdate) FILTER (WHERE complete), '%Y-%m-%d') AS covered_until, count(*) FILTER (WHERE NOT complete) AS incomplete,
  strftime(greatest(max(o_orderdate) FILTER (WHERE complete) - INTERVAL 1 DAY, TIMESTAMP '2001-07-02'), '%Y-%m-%d') AS read_from
FROM (SELECT *, o_orderstatus <> 'F' AS complete FROM orders) GROUP BY 1
""")
def source_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An incomplete read doesn't advance a source; a gap is caught up for 30 days at most."""
    o = table(spark, sf_dir, "orders").withColumn("complete", F.col("o_orderstatus") != "F")
    covered = F.max(F.when(F.col("complete"), F.col("o_orderdate")))
    agg = o.groupBy(F.col("o_custkey").alias("source")).agg(covered.alias("c"), F.count_if(~F.col("complete")).alias("incomplete"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return agg.select("source", day("c").alias("covered_until"), "incomplete", day(F.greatest(F.col("c") - F.expr("INTERVAL 1 DAY"), F.lit("2001-07-02").cast("timestamp_ntz"))).alias("read_from"))


@query("""
SELECT l_suppkey AS series, CAST(floor(l_orderkey / 1000) AS BIGINT) AS block, count(*) AS n, min(l_orderkey) FILTER (WHERE l_returnflag = 'N') AS floor_new, count(*) FILTER (WHERE l_returnflag = 'N') AS fresh FROM lineitem GROUP BY 1, 2
""")
def id_floor_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = F.col("l_returnflag") == "N"
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("series"), F.floor(F.col("l_orderkey") / 1000).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(fresh, F.col("l_orderkey"))).alias("floor_new"), F.count_if(fresh).alias("fresh"))
