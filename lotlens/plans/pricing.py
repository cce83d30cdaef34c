"""Price references, context, fair values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fair_value
from ..operators import order_statistics as stats
from ..session import settled
from .base import LISTINGS, dec, listings, newest, query, table
from .cars import CTES, cars

_RECENT = "recent AS (SELECT l.* FROM listings l, (SELECT max(seen) AS now FROM listings) n WHERE seen > now - 180)"


def recent(spark: SparkSession, sf_dir: str, days: int = 180) -> DataFrame:
    offers = listings(spark, sf_dir)
    now = newest(table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select(F.to_date("l_shipdate").alias("seen")), "seen")
    return offers.crossJoin(now).filter(F.col("seen") > F.date_sub("now", days)).drop("now")


def _null(c: str) -> Column:
    """Not a number, which stands for nothing to take a percentile of, as null."""
    return F.when(~F.isnan(c), F.col(c))


_PAIRS = """
pairs AS (
  SELECT t.id, t.price, t.trim, t.gearbox, t.km, c.id AS c_id, c.price AS c_price, c.km AS c_km, c.trim AS c_trim, c.gearbox AS c_gearbox, c.source AS c_source
  FROM recent t JOIN recent c ON t.make = c.make AND t.model = c.model AND c.year BETWEEN t.year - 1 AND t.year + 1 AND t.id <> c.id
  WHERE t.km IS NULL OR c.km IS NULL OR abs(c.km - t.km) <= t.km * 0.25)
"""
_FLOORED = """
floors AS (SELECT id, quantile_cont(c_price, 0.75) * 0.35 AS floor FROM pairs GROUP BY id),
floored AS (SELECT p.* FROM pairs p JOIN floors f USING (id) WHERE c_price >= floor)
"""


@query(f"""
WITH {LISTINGS}, {_RECENT}, {_PAIRS}, {_FLOORED},
leveled AS (
  SELECT id, any_value(price) AS price, 1 AS rank, 'trim_gearbox' AS level, count(*) AS n, quantile_cont(c_price, 0.25) AS p25, quantile_cont(c_price, 0.5) AS median, quantile_cont(c_price, 0.75) AS p75, quantile_cont(c_km, 0.5) AS median_km
  FROM floored WHERE trim = c_trim AND gearbox = c_gearbox GROUP BY id
  UNION ALL
  SELECT id, any_value(price), 2, 'gearbox', count(*), quantile_cont(c_price, 0.25), quantile_cont(c_price, 0.5), quantile_cont(c_price, 0.75), quantile_cont(c_km, 0.5) FROM floored WHERE gearbox = c_gearbox GROUP BY id
  UNION ALL
  SELECT id, any_value(price), 3, 'model', count(*), quantile_cont(c_price, 0.25), quantile_cont(c_price, 0.5), quantile_cont(c_price, 0.75), quantile_cont(c_km, 0.5) FROM floored GROUP BY id),
picked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank) AS k FROM leveled WHERE n >= 5 OR rank = 3)
SELECT id, level, n, round(p25, 4) AS p25, round(median, 4) AS median, round(p75, 4) AS p75, round(median_km, 4) AS median_km, round((1 - price / median) * 100, 4) AS diff_pct
FROM picked WHERE k = 1
""")
def comparable_price_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade of references of every recent offer, by order statistics of ranges: no pair of offers is made."""
    ref = stats.per_year(recent(spark, sf_dir), stats.reference, stats.REFERENCE, ["trim", "gearbox"])
    return ref.select("id", "level", "n", dec("p25", 4).alias("p25"), dec("median", 4).alias("median"), dec("p75", 4).alias("p75"), dec(_null("median_km"), 4).alias("median_km"), dec((1 - F.col("price") / F.col("median")) * 100, 4).alias("diff_pct"))


@query(f"""
WITH {LISTINGS}, q AS (SELECT make, model, quantile_cont(price, 0.75) AS p75 FROM listings GROUP BY make, model)
SELECT l.make, l.model, count(*) AS n, count(*) FILTER (WHERE price < 0.35 * p75) AS under_floor, round(min(price) FILTER (WHERE price >= 0.35 * p75), 4) AS cheapest
FROM listings l JOIN q ON l.make = q.make AND l.model = q.model GROUP BY l.make, l.model
""")
def price_floor_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = listings(spark, sf_dir).select("make", "model", "price")
    quartile = offers.groupBy("make", "model").agg(F.percentile("price", F.lit(0.75)).alias("p75"))
    low = F.col("price") < 0.35 * F.col("p75")
    return offers.join(quartile, ["make", "model"]).groupBy("make", "model").agg(F.count(F.lit(1)).alias("n"), F.count_if(low).alias("under_floor"), dec(F.min(F.when(~low, F.col("price"))), 4).alias("cheapest"))


@query(f"""
WITH {LISTINGS}, {_RECENT},
pairs AS (
  SELECT t.id, t.price, c.price AS c_price, (t.trim = c.trim AND abs(c.km - t.km) <= greatest(5, t.km * 0.2)) AS version_km, (abs(c.km - t.km) <= greatest(5, t.km * 0.2)) AS near_km
  FROM recent t JOIN recent c ON t.make = c.make AND t.model = c.model AND c.year BETWEEN t.year - 1 AND t.year + 1 AND t.id <> c.id AND t.seller <> c.seller),
agg AS (
  SELECT id, any_value(price) AS price, count(*) FILTER (WHERE version_km) AS n1, count(*) FILTER (WHERE near_km) AS n2, count(*) AS n3,
    quantile_cont(c_price, 0.5) FILTER (WHERE version_km) AS m1, quantile_cont(c_price, 0.5) FILTER (WHERE near_km) AS m2, quantile_cont(c_price, 0.5) AS m3
  FROM pairs GROUP BY id)
SELECT id, CASE WHEN n1 >= 4 THEN 'version_km' WHEN n2 >= 4 THEN 'km' ELSE 'model' END AS basis,
  CASE WHEN n1 >= 4 THEN n1 WHEN n2 >= 4 THEN n2 ELSE n3 END AS n,
  round(CASE WHEN n1 >= 4 THEN m1 WHEN n2 >= 4 THEN m2 ELSE m3 END, 4) AS reference,
  round((price / CASE WHEN n1 >= 4 THEN m1 WHEN n2 >= 4 THEN m2 ELSE m3 END - 1) * 100, 1) AS vs_market_pct
FROM agg WHERE n3 >= 4
""")
def dealer_market_ref_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = stats.per_year(recent(spark, sf_dir), stats.market, stats.MARKET, ["trim", "seller"])
    pick = lambda a, b, c: F.when(F.col("n1") >= 4, a).when(F.col("n2") >= 4, b).otherwise(c)
    median = pick(F.col("m1"), F.col("m2"), F.col("m3"))
    return agg.filter("n3 >= 4").select("id", pick(F.lit("version_km"), F.lit("km"), F.lit("model")).alias("basis"), pick(F.col("n1"), F.col("n2"), F.col("n3")).alias("n"), dec(median, 4).alias("reference"), dec((F.col("price") / median - 1) * 100, 1).alias("vs_market_pct"))


@query(f"""
WITH {LISTINGS}, {_RECENT},
pairs AS (SELECT t.id, t.year, t.km, t.trim, c.year AS c_year, c.km AS c_km, c.trim AS c_trim, c.price AS c_price, c.source AS c_source FROM recent t JOIN recent c ON t.make = c.make AND t.model = c.model AND c.year BETWEEN t.year - 1 AND t.year + 1 AND t.id <> c.id)
SELECT id, count(*) AS n, round(quantile_cont(c_price, 0.5), 4) AS all_years,
  round(quantile_cont(c_price, 0.5) FILTER (WHERE c_year = year), 4) AS same_year,
  round(quantile_cont(c_price, 0.5) FILTER (WHERE abs(c_km - km) <= greatest(5, km * 0.2)), 4) AS similar_km,
  round(quantile_cont(c_price, 0.5) FILTER (WHERE c_year = year AND abs(c_km - km) <= greatest(5, km * 0.2)), 4) AS closest,
  round(quantile_cont(c_price, 0.5) FILTER (WHERE c_trim = trim), 4) AS same_trim,
  round(quantile_cont(c_price, 0.5) FILTER (WHERE c_source = 'A'), 4) AS dealers
FROM pairs GROUP BY id
""")
def price_context_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = ("all_years", "same_year", "similar_km", "closest", "same_trim", "dealers")
    made = stats.per_year(recent(spark, sf_dir), stats.context, stats.CONTEXT, ["trim", "source"])
    return made.select("id", "n", *[dec(_null(k), 4).alias(k) for k in cuts])


@query("""
WITH sold AS (SELECT p_brand AS make, p_type AS model, CAST(year(l_shipdate) AS INTEGER) AS year, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'F'),
wide AS (SELECT make, model, y.year AS year, days FROM sold, (SELECT DISTINCT year FROM sold) y WHERE sold.year BETWEEN y.year - 1 AND y.year + 1)
SELECT make, model, year, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(quantile_cont(days, 0.5), 1) END AS median_days FROM wide GROUP BY make, model, year
""")
def days_to_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    sold = line.join(orders.filter("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    sold = sold.select(F.col("p_brand").alias("make"), F.col("p_type").alias("model"), F.year("l_shipdate").alias("year"), F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("days"))
    years = sold.select("year").distinct()  # as many as there are years
    wide = sold.withColumn("year", F.explode(F.sequence(F.col("year") - 1, F.col("year") + 1))).join(F.broadcast(years), "year", "left_semi")
    return wide.groupBy("make", "model", "year").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 5, dec(F.percentile("days", F.lit(0.5)), 1)).alias("median_days"))


@query(f"""
WITH {LISTINGS}
SELECT make, model, count(*) AS n, round(CASE WHEN var_pop(km) > 1e-12 THEN regr_slope(ln(price), km) ELSE 0 END, 6) AS slope, round(corr(ln(price), km), 6) AS correlation, round(regr_r2(ln(price), km), 6) AS r2
FROM listings WHERE km IS NOT NULL AND price > 0 GROUP BY make, model HAVING count(*) >= 3
""")
def slope_and_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = listings(spark, sf_dir).filter("km IS NOT NULL AND price > 0").withColumn("y", F.log("price"))
    agg = offers.groupBy("make", "model").agg(F.count(F.lit(1)).alias("n"), F.when(F.var_pop("km") > 1e-12, F.regr_slope("y", "km")).otherwise(0.0).alias("s"), F.corr("y", "km").alias("c"), F.regr_r2("y", "km").alias("r"))
    return agg.filter("n >= 3").select("make", "model", "n", dec("s", 6).alias("slope"), dec("c", 6).alias("correlation"), dec("r", 6).alias("r2"))


@query(f"""
WITH {LISTINGS}
SELECT make, round(quantile_disc(price, 0.5), 4) AS disc_price, CAST(quantile_disc(year, 0.25) AS INTEGER) AS year_from, CAST(quantile_disc(year, 0.75) AS INTEGER) AS year_to, mode(model ORDER BY model) AS usual_model, mode(model ORDER BY model) FILTER (WHERE gearbox = 'F') AS usual_f
FROM listings GROUP BY make
""")
def percentile_disc_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings(spark, sf_dir).createOrReplaceTempView("offers_for_mode")
    return spark.sql("""
        SELECT make, round(percentile_disc(0.5) WITHIN GROUP (ORDER BY price), 4) AS disc_price, CAST(percentile_disc(0.25) WITHIN GROUP (ORDER BY year) AS INT) AS year_from,
          CAST(percentile_disc(0.75) WITHIN GROUP (ORDER BY year) AS INT) AS year_to, mode() WITHIN GROUP (ORDER BY model) AS usual_model, mode() WITHIN GROUP (ORDER BY model) FILTER (WHERE gearbox = 'F') AS usual_f
        FROM offers_for_mode GROUP BY make""")


@query()
def fair_value_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each offer's fair value by its model's curve; a fit by alternating medians, which SQL doesn't express."""
    offers = listings(spark, sf_dir).withColumn("trim", (F.col("trim") % 5).cast("string"))
    curves = fair_value.fit_curves(offers)
    return fair_value.value(offers, curves).select("id", "make", "model", dec("fair", 4).alias("fair"), dec("diff_pct", 4).alias("diff_pct"))


@query()
def fair_value_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-fold errors of the curve against the cohort median, by model, and whether the curve is used."""
    offers = listings(spark, sf_dir).withColumn("trim", (F.col("trim") % 5).cast("string"))
    return fair_value.gate(offers)


#: Reads of whole stocks, by make and model or of a source as a whole; what they covered and did not see is unconfirmed.
_READS = "reads AS (SELECT p_brand AS make, p_type || ' ' || CAST(CAST(floor(p_partkey / 4) AS BIGINT) AS VARCHAR(20)) AS model, CASE p_partkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'nova' ELSE 'directo' END AS source, CAST(1994 + p_partkey % 4 AS INTEGER) AS year_min, CAST(5 + p_partkey % 40 AS INTEGER) AS days_ago FROM part)"
_QUALIFIED = f"""{CTES}, {_READS}, clock AS (SELECT max(seen) AS now FROM cars),
unsure AS (SELECT DISTINCT c.id FROM cars c JOIN reads r ON r.source = c.source AND lower(r.make) = lower(c.make) AND lower(r.model) = lower(c.model) AND c.year >= r.year_min, clock WHERE c.source IN ('alpha', 'nova') AND now - days_ago > c.seen + 2),
good AS (SELECT c.* FROM cars c, clock WHERE price_usd > 0 AND NOT price_partial AND seen >= now - 365 AND source <> 'directo' AND c.id NOT IN (SELECT id FROM unsure)),
pool AS (SELECT g.* FROM good g WHERE repost_of IS NULL OR repost_of NOT IN (SELECT id FROM good))"""


def qualified(spark: SparkSession, sf_dir: str, days: int = 365) -> DataFrame:
    """Offers with whether they are of the pool: a whole price, seen lately, confirmed by later reads of their stock where
    their source is confirmed so, and no repost of an offer that counts itself."""
    kept = "id source make model year price_usd price_partial km transmission trim seller_type dealer_inferred seen repost_of"
    offers = settled(cars(spark, sf_dir).select(*kept.split()))  # read five times
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    reads = spark.sql(f"WITH {_READS} SELECT * FROM reads").withColumnRenamed("source", "read_source")
    now = F.broadcast(offers.agg(F.max("seen").alias("now")))
    some = offers.filter(F.col("source").isin("alpha", "nova")).join(now)  # only these pay for the test
    low = lambda c: F.lower(F.col(c))
    met = some.select("id", low("make").alias("make"), low("model").alias("model"), "source", "year", "seen", "now").join(reads.select(low("make").alias("make"), low("model").alias("model"), F.col("read_source").alias("source"), "year_min", "days_ago"), ["make", "model", "source"])
    unsure = met.filter((F.col("year") >= F.col("year_min")) & (F.date_sub("now", F.col("days_ago").cast("int")) > F.date_add("seen", 2))).select("id").distinct()
    whole = offers.join(now).filter("price_usd > 0 AND NOT price_partial AND source <> 'directo'").filter(F.col("seen") >= F.date_sub("now", days)).join(unsure, "id", "left_anti")
    good = whole.select("id", "repost_of")
    counted = good.filter("repost_of IS NOT NULL").join(good.select(F.col("id").alias("repost_of")), "repost_of", "left_semi").select("id")
    pool = good.select("id").join(counted, "id", "left_anti").withColumn("member", F.lit(True))
    return offers.filter("make IS NOT NULL AND model IS NOT NULL").join(pool, "id", "left").withColumn("member", F.coalesce("member", F.lit(False)))


@query(f"""WITH {_QUALIFIED},
pairs AS (SELECT t.id, t.price_usd AS price, c.price_usd AS p, lower(c.trim) = lower(t.trim) AND c.transmission = t.transmission AS twin, c.transmission = t.transmission AS gear, coalesce(c.seller_type = 'dealer' OR c.dealer_inferred, false) AS dealer, coalesce(c.seller_type = 'private' AND NOT c.dealer_inferred, false) AS private
  FROM cars t JOIN pool c ON lower(c.make) = lower(t.make) AND lower(c.model) = lower(t.model) AND c.id <> t.id WHERE (t.year IS NULL OR c.year BETWEEN t.year - 1 AND t.year + 1)
    AND (t.km IS NULL OR c.km IS NULL OR abs(c.km - t.km) <= t.km * 0.25) AND c.repost_of IS DISTINCT FROM t.id),
floors AS (SELECT id, quantile_cont(p, 0.75) * 0.35 AS f FROM pairs GROUP BY id), kept AS (SELECT q.* FROM pairs q JOIN floors USING (id) WHERE p >= f),
leveled AS ({" UNION ALL ".join(f"SELECT id, any_value(price) AS price, {k} AS rank, '{n}' AS level, count(*) AS n, quantile_cont(p, 0.25) AS p25, quantile_cont(p, 0.5) AS median, quantile_cont(p, 0.75) AS p75, count(*) FILTER (WHERE dealer) AS dealer_n, quantile_cont(p, 0.5) FILTER (WHERE dealer) AS dealer_median, count(*) FILTER (WHERE private) AS private_n, quantile_cont(p, 0.5) FILTER (WHERE private) AS private_median FROM kept WHERE {w} GROUP BY id" for k, n, w in ((1, "trim_transmission", "twin"), (2, "transmission", "gear"), (3, "model", "true")))}),
best AS (SELECT * FROM leveled WHERE n >= 5 OR rank = 3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank) = 1)
SELECT c.id, coalesce(level, 'model') AS level, coalesce(n, 0) AS n, round(p25, 4) AS p25, round(median, 4) AS median, round(p75, 4) AS p75, coalesce(dealer_n, 0) AS dealer_n, round(dealer_median, 4) AS dealer_median, coalesce(private_n, 0) AS private_n, round(private_median, 4) AS private_median, round(CASE WHEN median > 0 AND c.price_usd > 0 THEN (1 - c.price_usd / median) * 100 END, 4) AS diff_pct
FROM cars c LEFT JOIN best b ON b.id = c.id WHERE c.make IS NOT NULL AND c.model IS NOT NULL""")
def comparables_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference of every offer by the full rules: unconfirmed offers and reposts, targets of unknown year, a price floor,
    the cascade, and dealers and private sellers of the chosen level apart."""
    q = qualified(spark, sf_dir).select(
        "id", F.lower("make").alias("make"), F.lower("model").alias("model"), "year", F.col("price_usd").alias("price"), F.col("km").cast("double").alias("km"), F.lower("trim").alias("trim"), F.col("transmission").alias("gearbox"), "member", F.col("repost_of").alias("of_target"),
        F.coalesce((F.col("seller_type") == "dealer") | F.col("dealer_inferred"), F.lit(False)).alias("dealer"), F.coalesce((F.col("seller_type") == "private") & ~F.col("dealer_inferred"), F.lit(False)).alias("private"),
    )
    # a row stands under the target years that it counts for, and under none for targets of unknown year
    years = F.when(F.col("year").isNotNull(), F.sequence(F.col("year") - 1, F.col("year") + 1)).otherwise(F.array().cast("array<int>"))
    dealt = q.withColumn("of", F.explode(F.concat(years, F.array(F.lit(None).cast("int"))))).withColumn("target", F.col("of").eqNullSafe(F.col("year")))
    dealt = dealt.filter(F.col("target") | F.col("member"))
    made = stats.by_bucket(dealt, stats.split_reference, stats.SPLIT, 4 * table(spark, sf_dir, "lineitem").count())
    money = [dec(_null(k)).alias(k) for k in ("p25", "median", "p75")]
    off = F.when((_null("median") > 0) & (_null("price") > 0), (1 - F.col("price") / F.col("median")) * 100)
    return made.select("id", "level", "n", *money, "dealer_n", dec(_null("dealer_median")).alias("dealer_median"), "private_n", dec(_null("private_median")).alias("private_median"), dec(off).alias("diff_pct"))
