"""Relational forms that the listing queries are made of: joins, distinct-on, quotas, set operations, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import ORACLE, LISTINGS, dec, listings, query, table, tables


@query("""
WITH d AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
SELECT c_name, o_orderkey, o_totalprice FROM d JOIN customer ON o_custkey = c_custkey WHERE k = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20
""")
def recent_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each key, then the top of these: a report of twenty."""
    orders, customer = tables(spark, sf_dir, "orders", "customer")
    newest = orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("o"))
    return newest.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("c_name", "o.o_orderkey", "o.o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("""
WITH q AS (SELECT CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderpriority = '1-URGENT' THEN 'blue' ELSE 'official' END AS kind, max(o_totalprice) / 1000 AS rate FROM orders GROUP BY 1, 2)
SELECT strftime(d, '%Y-%m-%d') AS day, kind, round(rate, 6) AS rate, 'any' AS lookup FROM (SELECT * FROM q ORDER BY d DESC, (kind = 'blue') DESC LIMIT 1)
UNION ALL SELECT strftime(d, '%Y-%m-%d'), kind, round(rate, 6), 'blue only' FROM (SELECT * FROM q WHERE kind = 'blue' ORDER BY d DESC LIMIT 1)
""")
def latest_fx_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "blue").otherwise("official")
    q = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d"), kind.alias("kind")).agg((F.max("o_totalprice") / 1000).alias("rate"))
    pick = lambda df, name: df.agg(F.max(F.struct("d", (F.col("kind") == "blue").alias("b"), "kind", "rate")).alias("x")).select(F.date_format("x.d", "yyyy-MM-dd").alias("day"), "x.kind", dec(F.col("x.rate"), 6).alias("rate"), F.lit(name).alias("lookup"))
    return pick(q, "any").unionByName(pick(q.filter("kind = 'blue'"), "blue only"))


@query("""
WITH m AS (SELECT o_custkey AS u, max(o_totalprice) AS best FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), f AS (SELECT user_id AS u, count(*) AS follows FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT coalesce(m.u, f.u) AS user_id, best, follows, CASE WHEN m.u IS NULL THEN 'follower' WHEN f.u IS NULL THEN 'match' ELSE 'both' END AS why FROM m FULL OUTER JOIN f ON m.u = f.u
""")
def audiences_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, events = tables(spark, sf_dir, "orders", "events")
    m = orders.filter("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("user_id")).agg(F.max("o_totalprice").alias("best"))
    f = events.filter("event_type = 'click'").groupBy("user_id").agg(F.count(F.lit(1)).alias("follows"))
    return m.join(f, "user_id", "full").select("user_id", "best", "follows", F.when(F.col("best").isNull(), "follower").when(F.col("follows").isNull(), "match").otherwise("both").alias("why"))


@query("""
SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-05-01') AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey) AND c_acctbal < 8000
""")
def retention_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What nobody has touched since a date: anti joins, one for each kind of touch."""
    customer, orders, events = tables(spark, sf_dir, "customer", "orders", "events")
    recent = orders.filter(F.col("o_orderdate") >= F.lit("2001-05-01").cast("timestamp_ntz"))
    return customer.filter("c_acctbal < 8000").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").join(events, F.col("c_custkey") == F.col("user_id"), "left_anti").select("c_custkey", "c_name")


@query("""
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_quantity > 48)
""")
def watched_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders, line = tables(spark, sf_dir, "customer", "orders", "lineitem")
    big = orders.join(line.filter("l_quantity > 48"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return customer.join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""
WITH a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END AS zone, c_mktsegment AS kind FROM customer), b AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 > 0 THEN s_nationkey END AS zone FROM supplier)
SELECT a.kind, count(*) AS pairs, count(a.zone) AS known FROM a JOIN b ON a.zone IS NOT DISTINCT FROM b.zone GROUP BY a.kind
""")
def null_safe_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null equals null; counted on either side before the join, so the null group is one row and not a product."""
    customer, supplier = tables(spark, sf_dir, "customer", "supplier")
    a = customer.select(F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")).alias("za"), F.col("c_mktsegment").alias("kind")).groupBy("kind", "za").agg(F.count(F.lit(1)).alias("na"))
    b = supplier.select(F.when(F.col("s_suppkey") % 4 > 0, F.col("s_nationkey")).alias("zb")).groupBy("zb").agg(F.count(F.lit(1)).alias("nb"))
    met = a.join(b, F.col("za").eqNullSafe(F.col("zb")))
    return met.groupBy("kind").agg(F.sum(F.col("na") * F.col("nb")).alias("pairs"), F.coalesce(F.sum(F.when(F.col("za").isNotNull(), F.col("na") * F.col("nb"))), F.lit(0)).cast("bigint").alias("known"))


@query("""
WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), n AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')
SELECT e.event_id, count(n.event_id) AS clicks, min(n.event_id) AS first_click FROM e LEFT JOIN n ON e.user_id = n.user_id AND n.ts >= e.ts AND n.ts < e.ts + INTERVAL 6 HOUR GROUP BY e.event_id
""")
def window_limited_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within six hours after: met by (user, block of six hours), so a busy user is spread over time."""
    events = table(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    span = 6 * 3600 * 1_000_000
    e = events.filter("event_type = 'view'").select("event_id", "user_id", "s", F.explode(F.array(F.floor(F.col("s") / span), F.floor(F.col("s") / span) + 1)).alias("block"))
    n = events.filter("event_type = 'click'").select("user_id", F.floor(F.col("s") / span).alias("block"), F.col("s").alias("t"), F.col("event_id").alias("click"))
    hit = e.join(n, ["user_id", "block"]).filter((F.col("t") >= F.col("s")) & (F.col("t") < F.col("s") + span)).groupBy("event_id").agg(F.count("click").alias("clicks"), F.min("click").alias("first_click"))
    return events.filter("event_type = 'view'").select("event_id").join(hit, "event_id", "left").select("event_id", F.coalesce("clicks", F.lit(0)).cast("bigint").alias("clicks"), "first_click")


@query("""
WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, event_id AS vid, value FROM events WHERE event_type = 'view')
SELECT e.event_id, v.vid AS last_view, v.value FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts
""")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest view before each purchase: one union, one window, no pairs."""
    e = table(spark, sf_dir, "events").filter("event_type IN ('purchase', 'view')")
    view = F.when(F.col("event_type") == "view", F.struct("event_id", "value"))
    w = W.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1)).rowsBetween(W.unboundedPreceding, 0)
    out = e.select("event_id", "event_type", F.last(view, ignorenulls=True).over(w).alias("v")).filter("event_type = 'purchase'")
    return out.select("event_id", F.col("v.event_id").alias("last_view"), F.col("v.value").alias("value"))


@query("""
SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY place <= CASE WHEN any_value(c_acctbal) OVER (PARTITION BY o_custkey) > 5000 THEN 5 ELSE 2 END
""")
def quota_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """So many rows for each user as the plan allows."""
    orders, customer = tables(spark, sf_dir, "orders", "customer")
    ranked = orders.withColumn("place", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).filter("place <= 5")
    limit = customer.select("c_custkey", F.when(F.col("c_acctbal") > 5000, 5).otherwise(2).alias("quota"))
    return ranked.join(limit, F.col("o_custkey") == F.col("c_custkey")).filter("place <= quota").select("o_custkey", "o_orderkey", "place")


@query("""
SELECT o_orderpriority AS priority, count(*) AS n, CAST(list_position(['3-MEDIUM', '1-URGENT', '2-HIGH', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority) AS INTEGER) AS place FROM orders GROUP BY 1 ORDER BY place
""")
def custom_enum_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.array(*map(F.lit, ["3-MEDIUM", "1-URGENT", "2-HIGH", "4-NOT SPECIFIED", "5-LOW"]))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.array_position(order, F.col("priority")).cast("int")).orderBy("place")


@query("""
SELECT make, array_to_string(list_slice(list_sort(list_distinct(list(model))), 1, 3), ',') AS models, CAST(len(list_distinct(list(seller))) AS INTEGER) AS sellers, list_has_any(list(gearbox), ['F']) AS any_f FROM (WITH l AS (SELECT p_brand AS make, p_type AS model, l_suppkey AS seller, l_linestatus AS gearbox FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT * FROM l) GROUP BY make
""")
def array_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = tables(spark, sf_dir, "lineitem", "part")
    l = line.join(part, F.col("l_partkey") == F.col("p_partkey"))  # noqa: E741
    return l.groupBy(F.col("p_brand").alias("make")).agg(F.array_join(F.slice(F.array_sort(F.collect_set("p_type")), 1, 3), ",").alias("models"), F.count_distinct("l_suppkey").cast("int").alias("sellers"), F.bool_or(F.col("l_linestatus") == "F").alias("any_f"))


@query("""
SELECT p_brand AS make, p_type AS model, count(*) AS n, count(DISTINCT l_suppkey) AS people FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) >= 3 ORDER BY n DESC, make, model LIMIT 10
""")
def top_models_with_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = tables(spark, sf_dir, "lineitem", "part")
    agg = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("make"), F.col("p_type").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("people"))
    return agg.filter("people >= 3").orderBy(F.desc("n"), "make", "model").limit(10)


@query("""
SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 200
""")
def intersect_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    of = lambda c: e.filter(c).select("user_id")
    return of("event_type = 'view'").intersect(of("event_type = 'purchase'")).subtract(of("event_type = 'error' AND value > 200"))


@query("""
SELECT conv_id, turn, CAST(i AS INTEGER) AS place, w AS word FROM (SELECT conv_id, turn, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i, unnest(string_split(text, ' ')) AS w FROM conversations)
""")
def words_with_ordinality_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all turns."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ", -1)).alias("i", "word"))
    return words.select("conv_id", "turn", (F.col("i") + 1).alias("place"), "word")


query(ORACLE["words_with_ordinality_whole"], name="words_with_ordinality")(words_with_ordinality_whole)  # under its older name, which once read a part only


@query("""
WITH s AS (SELECT o_orderkey AS id, o_custkey AS zone, o_totalprice AS price FROM orders)
SELECT zone, count(*) AS n, round(avg(CASE WHEN price > cheap THEN 1.0 ELSE 0 END), 6) AS share_dearer, any_value(cheap) AS own FROM s JOIN (SELECT zone AS z, min(price) AS cheap FROM s GROUP BY 1) ON z = zone GROUP BY zone
""")
def price_position_in_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("zone"), F.col("o_totalprice").alias("price"))
    cheap = s.groupBy("zone").agg(F.min("price").alias("own"))
    return s.join(cheap, "zone").groupBy("zone").agg(F.count(F.lit(1)).alias("n"), dec(F.avg(F.when(F.col("price") > F.col("own"), 1.0).otherwise(0.0)), 6).alias("share_dearer"), F.first("own").alias("own"))


@query("""
SELECT s_suppkey AS seller, mode(p_brand ORDER BY p_brand) AS usual_make, count(*) AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1
""")
def usual_place_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most common value with the least as tie-break, from counts: two small aggregations and no sort."""
    line, part, supplier = tables(spark, sf_dir, "lineitem", "part", "supplier")
    n = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_suppkey").alias("seller"), "p_brand").agg(F.count(F.lit(1)).alias("k"))
    return n.groupBy("seller").agg(F.min_by("p_brand", F.struct(-F.col("k"), F.col("p_brand"))).alias("usual_make"), F.sum("k").alias("n"))


@query(f"WITH {LISTINGS} SELECT make, model, year, count(*) AS n, round(avg(km), 6) AS mean_km, min(price) AS cheapest, max(price) AS dearest, CAST(grouping_id(make, model, year) AS INTEGER) AS total_of FROM listings GROUP BY ROLLUP (make, model, year)")
def market_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).rollup("make", "model", "year").agg(F.count(F.lit(1)).alias("n"), dec(F.avg("km"), 6).alias("mean_km"), F.min("price").alias("cheapest"), F.max("price").alias("dearest"), F.grouping_id("make", "model", "year").cast("int").alias("total_of"))


@query("""SELECT event_id, user_id, n, n > 3 AS blocked FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW) AS n FROM events)""")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's attempts in the last twelve hours, and which go beyond three."""
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    n = F.count(F.lit(1)).over(W.partitionBy("user_id").orderBy("us").rangeBetween(-12 * 3600 * 1_000_000, 0))
    return e.select("event_id", "user_id", n.alias("n")).withColumn("blocked", F.col("n") > 3)
