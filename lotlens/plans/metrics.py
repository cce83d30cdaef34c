"""Product metrics: funnels, activation, weekly north star, latency, health, cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import ORACLE, dec, exact, query, table, tables


@query("""
SELECT CASE WHEN value >= 85 THEN 'high' WHEN value >= 40 THEN 'good' ELSE 'low' END AS level, count(*) AS sent, count(*) FILTER (WHERE event_type = 'view') AS opened, count(*) FILTER (WHERE event_type = 'click') AS clicked,
  round(100.0 * count(*) FILTER (WHERE event_type = 'click') / nullif(count(*) FILTER (WHERE event_type IN ('view', 'click')), 0), 2) AS click_rate,
  list_position(['high', 'good', 'low'], CASE WHEN value >= 85 THEN 'high' WHEN value >= 40 THEN 'good' ELSE 'low' END) AS place
FROM events GROUP BY 1
""")
def alert_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("value") >= 85, "high").when(F.col("value") >= 40, "good").otherwise("low")
    view, click = F.col("event_type") == "view", F.col("event_type") == "click"
    agg = table(spark, sf_dir, "events").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("sent"), F.count_if(view).alias("opened"), F.count_if(click).alias("clicked"), F.count_if(view | click).alias("both"))
    rate = 100.0 * F.col("clicked") / F.nullif(F.col("both"), F.lit(0))
    return agg.select("level", "sent", "opened", "clicked", dec(rate, 2).alias("click_rate"), F.array_position(F.array(F.lit("high"), F.lit("good"), F.lit("low")), F.col("level")).cast("int").alias("place"))


@query("""
SELECT CASE WHEN m >= 100 THEN 'high' ELSE 'other' END AS segment, count(*) AS users, sum(n) FILTER (WHERE c > 0)::BIGINT AS events_of_clickers, round(avg(c), 4) AS clicks_per_user
FROM (SELECT user_id, max(value) AS m, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS c FROM events GROUP BY user_id) GROUP BY 1
""")
def high_score_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("m"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "click").alias("c"))
    return users.groupBy(F.when(F.col("m") >= 100, "high").otherwise("other").alias("segment")).agg(F.count(F.lit(1)).alias("users"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("events_of_clickers"), dec(F.avg("c")).alias("clicks_per_user"))


@query("""
WITH d AS (SELECT user_id, CAST(ts - INTERVAL 3 HOUR AS DATE) AS day, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1, 2)
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS users, CAST(sum(n) AS BIGINT) AS alerts, round(avg(n), 4) AS per_user, max(n) AS most, count(*) FILTER (WHERE n > 3) AS over_cap FROM d GROUP BY day
""")
def alerts_per_user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format(F.col("ts").cast("timestamp") - F.expr("INTERVAL 3 HOURS"), "yyyy-MM-dd")
    d = table(spark, sf_dir, "events").filter("event_type <> 'error'").groupBy("user_id", day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy("day").agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("alerts"), dec(F.avg("n")).alias("per_user"), F.max("n").alias("most"), F.count_if(F.col("n") > 3).alias("over_cap"))


@query("""
WITH a AS (SELECT c_custkey, c_mktsegment, c_nationkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') OR EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'purchase') AS active FROM customer)
SELECT c_mktsegment AS segment, c_nationkey AS nation, count(*) AS users, count(*) FILTER (WHERE active) AS activated, round(100.0 * count(*) FILTER (WHERE active) / count(*), 2) AS rate,
  CAST(grouping(c_mktsegment) * 2 + grouping(c_nationkey) AS INTEGER) AS total_of
FROM a GROUP BY GROUPING SETS ((c_mktsegment, c_nationkey), (c_mktsegment), ())
""")
def activation_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders, events = tables(spark, sf_dir, "customer", "orders", "events")
    urgent = orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    bought = events.filter("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"))
    active = urgent.union(bought).distinct().withColumn("active", F.lit(True))
    customer.join(active, "c_custkey", "left").createOrReplaceTempView("activation_users")
    return spark.sql("""
        SELECT c_mktsegment AS segment, c_nationkey AS nation, count(*) AS users, count_if(coalesce(active, false)) AS activated, round(100.0D * count_if(coalesce(active, false)) / count(*), 2) AS rate,
          CAST(grouping(c_mktsegment) * 2 + grouping(c_nationkey) AS INT) AS total_of
        FROM activation_users GROUP BY GROUPING SETS ((c_mktsegment, c_nationkey), (c_mktsegment), ())""")


@query("""
WITH w AS (SELECT user_id AS u, date_trunc('week', ts - INTERVAL 3 HOUR) AS week FROM events WHERE event_type IN ('view', 'click')
  UNION SELECT user_id, date_trunc('week', ts - INTERVAL 3 HOUR) FROM events WHERE event_type = 'purchase'),
bad AS (SELECT user_id AS u FROM events GROUP BY user_id HAVING bool_or(value > 300)),
n AS (SELECT week, count(*) AS active, count(*) FILTER (WHERE bad.u IS NULL) AS sound FROM w LEFT JOIN bad USING (u) GROUP BY week),
p AS (SELECT date_trunc('week', ts - INTERVAL 3 HOUR) AS week, count(DISTINCT user_id) AS buyers FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT strftime(week, '%Y-%m-%d') AS week, active, sound, coalesce(buyers, 0) AS buyers FROM n LEFT JOIN p USING (week)
""")
def north_star_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.date_format(F.date_trunc("week", F.col("ts").cast("timestamp") - F.expr("INTERVAL 3 HOURS")), "yyyy-MM-dd")
    events = table(spark, sf_dir, "events").withColumn("week", week)
    seen, bought = events.filter("event_type IN ('view', 'click')").select("user_id", "week"), events.filter("event_type = 'purchase'").select("user_id", "week")
    active = seen.union(bought).distinct()
    bad = events.groupBy("user_id").agg(F.bool_or(F.col("value") > 300).alias("bad")).filter("bad")
    n = active.join(bad, "user_id", "left").groupBy("week").agg(F.count(F.lit(1)).alias("active"), F.count_if(F.col("bad").isNull()).alias("sound"))
    p = bought.groupBy("week").agg(F.count_distinct("user_id").alias("buyers"))
    return n.join(p, "week", "left").select("week", "active", "sound", F.coalesce("buyers", F.lit(0)).cast("bigint").alias("buyers"))


@query("""
SELECT c_custkey AS search, o.o_orderkey AS first_match, date_diff('day', DATE '1995-01-01', CAST(o.o_orderdate AS DATE)) AS days
FROM customer LEFT JOIN LATERAL (SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000 ORDER BY o_orderdate, o_orderkey LIMIT 1) o ON true
""")
def first_value_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first valuable match of each search: an aggregate per key in place of a correlated top-1."""
    customer, orders = tables(spark, sf_dir, "customer", "orders")
    first = orders.filter("o_totalprice > 200000").groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("o"))
    return customer.join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("search"), F.col("o.o_orderkey").alias("first_match"), F.datediff(F.to_date("o.o_orderdate"), F.lit("1995-01-01").cast("date")).cast("bigint").alias("days"))


@query("""
SELECT 'users' AS criterion, CAST(count(DISTINCT user_id) AS DOUBLE) AS value, count(DISTINCT user_id) >= 100 AS met FROM events
UNION ALL SELECT 'errors_share', round(avg((event_type = 'error')::INT), 4), avg((event_type = 'error')::INT) <= 0.25 FROM events
UNION ALL SELECT 'orders_per_customer', round(count(*) / count(DISTINCT o_custkey), 4), count(*) / count(DISTINCT o_custkey) >= 5 FROM orders
UNION ALL SELECT 'open_share', round(avg((o_orderstatus = 'O')::INT), 4), avg((o_orderstatus = 'O')::INT) >= 0.3 FROM orders
UNION ALL SELECT 'parts_sold', CAST(count(DISTINCT l_partkey) AS DOUBLE), count(DISTINCT l_partkey) >= 100 FROM lineitem
""")
def validation_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, orders, line = tables(spark, sf_dir, "events", "orders", "lineitem")

    def one(df: DataFrame, name: str, value, holds) -> DataFrame:
        return df.agg(value.cast("double").alias("v")).select(F.lit(name).alias("criterion"), dec("v").alias("value"), holds(F.col("v")).alias("met"))

    share = lambda c: F.avg(c.cast("int"))
    rows = [
        one(events, "users", F.count_distinct("user_id"), lambda v: v >= 100),
        one(events, "errors_share", share(F.col("event_type") == "error"), lambda v: v <= 0.25),
        one(orders, "orders_per_customer", F.count(F.lit(1)) / F.count_distinct("o_custkey"), lambda v: v >= 5),
        one(orders, "open_share", share(F.col("o_orderstatus") == "O"), lambda v: v >= 0.3),
        one(line, "parts_sold", F.count_distinct("l_partkey"), lambda v: v >= 100),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders),
r AS (SELECT o_custkey, count(*) AS runs, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, avg(o_totalprice) AS mean FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01' GROUP BY 1)
SELECT l.o_custkey AS source, o_orderstatus AS last_status, strftime(o_orderdate, '%Y-%m-%d') AS last_run, coalesce(runs, 0) AS runs, coalesce(failed, 0) AS failed, round(mean, 6) AS mean_size FROM l LEFT JOIN r USING (o_custkey) WHERE k = 1
""")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    last = orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("l"))
    stats = orders.filter(F.col("o_orderdate") > F.lit("2000-01-01").cast("timestamp_ntz")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"), dec(F.avg("o_totalprice"), 6).alias("mean_size"))
    zero = F.lit(0).cast("bigint")
    return last.join(stats, "o_custkey", "left").select(F.col("o_custkey").alias("source"), F.col("l.o_orderstatus").alias("last_status"), F.date_format("l.o_orderdate", "yyyy-MM-dd").alias("last_run"), F.coalesce("runs", zero).alias("runs"), F.coalesce("failed", zero).alias("failed"), "mean_size")


@query("SELECT CAST(least(floor(l_quantity / 10) * 10, 40) AS INTEGER) AS bucket, l_returnflag AS source, count(*) AS n FROM lineitem GROUP BY 1, 2")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.least(F.floor(F.col("l_quantity") / 10) * 10, F.lit(40)).cast("int").alias("bucket"), F.col("l_returnflag").alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, max(value) AS slowest FROM events GROUP BY 1, 2
""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.percentile("value", F.array(F.lit(0.5), F.lit(0.95))).alias("p"), F.max("value").alias("slowest"))
    return agg.select("day", "event_type", "n", dec(F.get("p", F.lit(0))).alias("p50"), dec(F.get("p", F.lit(1))).alias("p95"), "slowest")


@query("""
WITH u AS (SELECT user_id, min(ts) FILTER (WHERE event_type = 'signup') AS s, min(ts) FILTER (WHERE event_type = 'view') AS v, min(ts) FILTER (WHERE event_type = 'click') AS c, min(ts) FILTER (WHERE event_type = 'purchase') AS p FROM events GROUP BY user_id)
SELECT CASE WHEN user_id % 2 = 0 THEN 'assisted' ELSE 'plain' END AS arm, count(*) AS users, count(*) FILTER (WHERE s IS NOT NULL) AS signed, count(*) FILTER (WHERE v > s) AS viewed, count(*) FILTER (WHERE v > s AND c > v) AS clicked, count(*) FILTER (WHERE v > s AND c > v AND p > c) AS bought,
  CAST(grouping(CASE WHEN user_id % 2 = 0 THEN 'assisted' ELSE 'plain' END) AS INTEGER) AS total
FROM u GROUP BY ROLLUP (CASE WHEN user_id % 2 = 0 THEN 'assisted' ELSE 'plain' END)
""")
def assisted_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda t: F.min(F.when(F.col("event_type") == t, F.col("ts")))
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(first("signup").alias("s"), first("view").alias("v"), first("click").alias("c"), first("purchase").alias("p"))
    viewed = F.col("v") > F.col("s")
    clicked = viewed & (F.col("c") > F.col("v"))
    users = users.withColumn("arm", F.when(F.col("user_id") % 2 == 0, "assisted").otherwise("plain"))
    return users.rollup("arm").agg(F.count(F.lit(1)).alias("users"), F.count("s").alias("signed"), F.count_if(viewed).alias("viewed"), F.count_if(clicked).alias("clicked"), F.count_if(clicked & (F.col("p") > F.col("c"))).alias("bought"), F.grouping("arm").cast("int").alias("total"))


@query("""
WITH r AS (SELECT CAST(min(o_orderdate) AS DATE) AS low, CAST(max(o_orderdate) AS DATE) AS high FROM orders),
days AS (SELECT low, high, CAST(unnest(generate_series(low, high, INTERVAL 1 DAY)) AS DATE) AS day FROM r),
o AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, count(DISTINCT o_custkey) AS users FROM orders GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n, coalesce(users, 0) AS users, CASE WHEN 2 * date_diff('day', low, day) > date_diff('day', low, high) THEN 'current' ELSE 'previous' END AS half,
  CAST(sum(coalesce(n, 0)) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS week_n
FROM days LEFT JOIN o USING (day)
""")
def decision_metrics_windows_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense daily series from the first to the last order, in two halves."""
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("users"))
    days = o.agg(F.min("day").alias("low"), F.max("day").alias("high")).select("low", "high", F.explode(F.sequence("low", "high")).alias("day"))
    zero = F.lit(0).cast("bigint")
    dense = days.join(o, "day", "left").select("day", "low", "high", F.coalesce("n", zero).alias("n"), F.coalesce("users", zero).alias("users"))
    back = dense.select(F.explode(F.sequence(F.col("day"), F.date_add("day", 6))).alias("day"), F.col("n").alias("m")).groupBy("day").agg(F.sum("m").alias("week_n"))
    half = F.when(2 * F.datediff("day", "low") > F.datediff("high", "low"), "current").otherwise("previous")
    return dense.join(back, "day").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "users", half.alias("half"), "week_n")


query(ORACLE["decision_metrics_windows_whole"], name="decision_metrics_windows")(decision_metrics_windows_whole)  # under its older name, which once read a part only


@query("""
WITH r AS (SELECT o_orderkey, o_orderpriority AS stratum, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS round FROM orders)
SELECT o_orderkey, stratum, CAST(round AS INTEGER) AS round FROM r WHERE round <= 5
""")
def stratified_sample_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of each stratum in the order of a hash: a sampling operator; least hashes by combining aggregation."""
    h = F.struct(F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("h"), F.col("o_orderkey").alias("k"))
    spread = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stratum"), h.alias("x"), F.pmod("o_orderkey", F.lit(64)).alias("salt"))
    few = spread.withColumn("r", F.row_number().over(W.partitionBy("stratum", "salt").orderBy("x"))).filter("r <= 5")
    best = few.withColumn("round", F.row_number().over(W.partitionBy("stratum").orderBy("x"))).filter("round <= 5")
    return best.select(F.col("x.k").alias("o_orderkey"), "stratum", "round")


@query("""
WITH f AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS f FROM orders GROUP BY 1)
SELECT strftime(date_trunc('month', f), '%Y-%m') AS cohort, CAST(floor(date_diff('day', f, CAST(o_orderdate AS DATE)) / 90) AS INTEGER) AS quarter, count(DISTINCT o_custkey) AS users FROM orders JOIN f USING (o_custkey) GROUP BY 1, 2
""")
def cohort_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d"))
    first = orders.groupBy("o_custkey").agg(F.min("d").alias("f"))
    return orders.join(first, "o_custkey").groupBy(F.date_format("f", "yyyy-MM").alias("cohort"), F.floor(F.datediff("d", "f") / 90).cast("int").alias("quarter")).agg(F.count_distinct("o_custkey").alias("users"))


@query("""
SELECT n_name AS nation, count(*) AS sellers, count(*) FILTER (WHERE s_acctbal IS NULL OR s_acctbal < 0) AS doubtful, round(100.0 * count(*) FILTER (WHERE s_acctbal < 0) / count(*), 2) AS doubtful_pct, bool_and(s_acctbal > -1000) AS all_sound, bool_or(s_acctbal > 9000) AS any_large
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name
""")
def seller_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation = tables(spark, sf_dir, "supplier", "nation")
    b, n = F.col("s_acctbal"), F.count(F.lit(1))
    return supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("nation")).agg(n.alias("sellers"), F.count_if(b.isNull() | (b < 0)).alias("doubtful"), dec(100.0 * F.count_if(b < 0) / n, 2).alias("doubtful_pct"), F.bool_and(b > -1000).alias("all_sound"), F.bool_or(b > 9000).alias("any_large"))


@query("""
SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS revenue, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'F') AS DECIMAL(28,2)) AS refunded, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1
""")
def commercial_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    worth = exact("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum(worth).cast("decimal(28,2)").alias("revenue"), F.sum(F.when(F.col("o_orderstatus") == "F", worth)).cast("decimal(28,2)").alias("refunded"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


@query("""
WITH l AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'purchase') AS ended FROM events GROUP BY user_id)
SELECT e.user_id, count(*) AS missed, max(value) AS best FROM events e JOIN l USING (user_id) WHERE ts > ended AND event_type = 'view' GROUP BY e.user_id
""")
def missed_since_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    ended = events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("ended"))
    return events.filter("event_type = 'view'").join(ended, "user_id").filter(F.col("ts") > F.col("ended")).groupBy("user_id").agg(F.count(F.lit(1)).alias("missed"), F.max("value").alias("best"))


@query("""
SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey AND abs(a.c_acctbal - b.c_acctbal) <= 20
""")
def trial_abuse_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts that look alike: a tolerance join by bands of the tolerance, so a large nation is no single task."""
    c = table(spark, sf_dir, "customer")
    band = F.floor(F.col("c_acctbal") / 20)
    mine = c.select("c_nationkey", "c_mktsegment", F.col("c_custkey").alias("a"), F.col("c_acctbal").alias("x"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    theirs = c.select("c_nationkey", "c_mktsegment", F.col("c_custkey").alias("b"), F.col("c_acctbal").alias("y"), band.alias("band"))
    return mine.join(theirs, ["c_nationkey", "c_mktsegment", "band"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("x") - F.col("y")) <= 20)).select("a", "b")


@query("""
SELECT k.reason, k.label, count(r.user_id) AS n FROM (VALUES ('view', 'saw it'), ('click', 'opened it'), ('refund', 'sent back')) k(reason, label) LEFT JOIN events r ON r.event_type = k.reason GROUP BY k.reason, k.label
""")
def answers_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed list of answers with their counts, zero included."""
    kinds = spark.createDataFrame([("view", "saw it"), ("click", "opened it"), ("refund", "sent back")], "reason string, label string")
    n = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("reason")).agg(F.count("user_id").alias("n"))
    return F.broadcast(kinds).join(n, "reason", "left").select("reason", "label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@query("""
WITH d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, o_orderstatus FROM orders)
SELECT c_mktsegment AS segment, count(DISTINCT o_custkey) AS people, CASE WHEN count(DISTINCT o_custkey) = 0 THEN '0' WHEN count(DISTINCT o_custkey) < 3 THEN 'few' ELSE CAST(count(DISTINCT o_custkey) AS VARCHAR) END AS shown, month FROM
  (SELECT o_custkey, strftime(d, '%Y-%m') AS month FROM d WHERE o_orderstatus = 'P') x JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, month
""")
def anonymous_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of people, shown only from three on."""
    orders, customer = tables(spark, sf_dir, "orders", "customer")
    agg = orders.filter("o_orderstatus = 'P'").join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count_distinct("o_custkey").alias("people"))
    return agg.select("segment", "month", "people", F.when(F.col("people") == 0, "0").when(F.col("people") < 3, "few").otherwise(F.col("people").cast("string")).alias("shown"))


@query("""
SELECT l_returnflag AS source, l_linestatus AS state, count(*) AS n, round(avg(l_discount), 6) AS mean_discount, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DECIMAL(38,4)) AS revenue
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY 1, 2
""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("2001-06-01").cast("timestamp_ntz"))
    revenue = exact("l_extendedprice") * (1 - exact("l_discount"))
    return line.groupBy(F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("state")).agg(F.count(F.lit(1)).alias("n"), dec(F.avg("l_discount"), 6).alias("mean_discount"), F.sum(exact("l_quantity")).cast("decimal(28,2)").alias("sum_qty"), F.sum(revenue).cast("decimal(38,4)").alias("revenue"))
