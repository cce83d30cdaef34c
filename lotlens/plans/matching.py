"""Saved searches against offers: filters, scores, flags, previews, diagnosis, places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geo import HAVERSINE_SQL, cell, haversine_km
from ..operators import match_blocks, scoring, search_bits
from ..session import settled
from .base import LISTINGS, dec, listings, query, table

MODELS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
#: A customer's search: what it wants, made from its key and balance, so that some bounds are missing.
SEARCHES = """
searches AS (
  SELECT c_custkey AS search, 'Brand#' || (1 + c_custkey % 25) AS make, CASE CAST(floor(c_custkey / 25) AS BIGINT) % 6 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'LARGE' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'PROMO' WHEN 4 THEN 'SMALL' ELSE 'STANDARD' END AS model, CAST(2001 - c_custkey % 4 AS INTEGER) AS year_min,
    CASE WHEN c_custkey % 3 > 0 THEN 20000 + c_acctbal * 6 END AS price_max, CASE WHEN c_custkey % 5 > 0 THEN CAST(10.0 + c_custkey % 40 AS DOUBLE) END AS km_max,
    CASE WHEN c_custkey % 4 = 0 THEN 'F' END AS gearbox, CAST(CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 50 + 1 END AS INTEGER) AS trim, c_nationkey AS zone
  FROM customer)
"""


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("search"), F.concat(F.lit("Brand#"), (1 + k % 25).cast("string")).alias("make"), F.element_at(F.array(*map(F.lit, MODELS)), (F.floor(k / 25) % 6 + 1).cast("int")).alias("model"), (2001 - k % 4).cast("int").alias("year_min"),
        F.when(k % 3 > 0, 20000 + F.col("c_acctbal") * 6).alias("price_max"), F.when(k % 5 > 0, 10.0 + k % 40).alias("km_max"),
        F.when(k % 4 == 0, "F").alias("gearbox"), F.when(k % 7 == 0, (k % 50 + 1).cast("int")).alias("trim"), F.col("c_nationkey").alias("zone"),
    )


def fresh(spark: SparkSession, sf_dir: str, days: int = 30) -> DataFrame:
    offers = listings(spark, sf_dir)
    now = offers.agg(F.max("seen").alias("now"))
    return offers.join(F.broadcast(now), F.col("seen") > F.date_sub("now", days))


_FRESH = "fresh AS (SELECT l.*, now FROM listings l, (SELECT max(seen) AS now FROM listings) n WHERE seen > now - {days})"
RULES = ("year", "price", "km", "gearbox", "trim")


def sides(spark: SparkSession, sf_dir: str, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """The searches, and the fresh offers, worked out once."""
    return settled(searches(spark, sf_dir)), settled(fresh(spark, sf_dir, days))


def hits(want: DataFrame, offers: DataFrame) -> DataFrame:
    """Each search with the offers of its make and model that fail nothing, and r_<rule>: ok or unknown, null where it sets no bound.

    They meet in blocks, so a task holds a bounded part of a model's pairs, and what fails is told by the bounds themselves.
    """
    c = F.col
    rules = {
        "year": scoring.tri(c("o.year"), c("o.year") >= c("s.year_min")),
        "price": F.when(c("s.price_max").isNotNull(), scoring.tri(c("o.price"), c("o.price") <= c("s.price_max"))),
        "km": F.when(c("s.km_max").isNotNull(), scoring.tri(c("o.km"), c("o.km") <= c("s.km_max"))),
        "gearbox": F.when(c("s.gearbox").isNotNull(), scoring.tri(c("o.gearbox"), c("o.gearbox") == c("s.gearbox"))),
        "trim": F.when(c("s.trim").isNotNull(), scoring.required(c("o.trim"), F.abs(c("o.trim") - c("s.trim")) <= 5)),
    }
    fits = (c("o.year").isNull() | (c("o.year") >= c("s.year_min"))) & (c("s.trim").isNull() | (c("o.trim").isNotNull() & (F.abs(c("o.trim") - c("s.trim")) <= 5)))
    for value, most in (("price", "price_max"), ("km", "km_max")):
        fits &= c(f"s.{most}").isNull() | c(f"o.{value}").isNull() | (c(f"o.{value}") <= c(f"s.{most}"))
    fits &= c("s.gearbox").isNull() | c("o.gearbox").isNull() | (c("o.gearbox") == c("s.gearbox"))
    left, right, tasks = match_blocks.dealt(want.withColumn("kind", search_bits.kind()), offers.withColumn("kind", search_bits.kind()), match_blocks.PAIR_BLOCK)
    s, o = left.repartition(tasks, *match_blocks.CELL).hint("merge").alias("s"), right.repartition(tasks, *match_blocks.CELL).alias("o")
    meets = fits
    for k in match_blocks.CELL:
        meets = (c(f"s.{k}") == c(f"o.{k}")) & meets
    offer = [c(f"o.{k}").alias(k) for k in offers.columns if k not in ("gearbox", "trim")]
    return s.join(o, meets).select(c("s.search"), c("s.zone"), c("s.price_max"), c("s.km_max"), *offer, c("o.trim").alias("trim"), *[r.alias(f"r_{k}") for k, r in rules.items()])


def count(state: str) -> Column:
    return sum((F.coalesce(F.col(f"r_{k}") == state, F.lit(False)).cast("int") for k in RULES), F.lit(0))


_MATCHED = """
matched AS (
  SELECT s.search, s.zone, s.price_max, s.km_max, o.*,
    CASE WHEN o.year IS NULL THEN 'unknown' WHEN o.year >= year_min THEN 'ok' ELSE 'fail' END AS r_year,
    CASE WHEN price_max IS NULL THEN NULL WHEN o.price IS NULL THEN 'unknown' WHEN o.price <= price_max THEN 'ok' ELSE 'fail' END AS r_price,
    CASE WHEN km_max IS NULL THEN NULL WHEN o.km IS NULL THEN 'unknown' WHEN o.km <= km_max THEN 'ok' ELSE 'fail' END AS r_km,
    CASE WHEN s.gearbox IS NULL THEN NULL WHEN o.gearbox IS NULL THEN 'unknown' WHEN o.gearbox = s.gearbox THEN 'ok' ELSE 'fail' END AS r_gearbox,
    CASE WHEN s.trim IS NULL THEN NULL WHEN o.trim IS NOT NULL AND abs(o.trim - s.trim) <= 5 THEN 'ok' ELSE 'fail' END AS r_trim
  FROM searches s JOIN fresh o ON s.make = o.make AND s.model = o.model),
states AS (
  SELECT *, len(list_filter([r_year, r_price, r_km, r_gearbox, r_trim], lambda x: x = 'ok')) AS oks, len(list_filter([r_year, r_price, r_km, r_gearbox, r_trim], lambda x: x = 'fail')) AS fails,
    len(list_filter([r_year, r_price, r_km, r_gearbox, r_trim], lambda x: x = 'unknown')) AS unknowns FROM matched)
"""


def _ctes(days: int = 30) -> str:
    return f"WITH {LISTINGS}, {SEARCHES}, {_FRESH.format(days=days)}, {_MATCHED}"


@query(_ctes() + """
SELECT search, id, CAST(oks AS INTEGER) AS n_ok, CAST(unknowns AS INTEGER) AS n_unknown,
  array_to_string(list_filter(['year=' || r_year, 'price=' || r_price, 'km=' || r_km, 'gearbox=' || r_gearbox, 'trim=' || r_trim], lambda x: x IS NOT NULL), ',') AS reasons
FROM states WHERE fails = 0
""")
def match_with_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f"{k}="), F.col(f"r_{k}")) for k in RULES])), ",")
    return hits(*sides(spark, sf_dir)).select("search", "id", count("ok").alias("n_ok"), count("unknown").alias("n_unknown"), reasons.alias("reasons"))


@query(_ctes() + """,
ref AS (SELECT make, model, count(*) AS n, quantile_cont(price, 0.5) AS median, quantile_cont(km, 0.5) AS usual_km FROM listings GROUP BY make, model),
p AS (
  SELECT search, id, s.price, (1 - s.price / median) * 100 AS d, discount >= 0.09 AS financing, s.year IS NULL AS no_year, tax >= 0.08 AS partial,
    CASE WHEN n < 5 THEN 0.5 ELSE least(greatest(0.5 + (1 - s.price / median) * 100 / 20, 0), 1) END AS a,
    least(greatest(oks / (oks + fails + unknowns) - 0.15 * (unknowns / (oks + fails + unknowns)), 0), 1) AS b,
    CASE WHEN s.km IS NULL OR usual_km IS NULL OR usual_km <= 0 OR n < 5 THEN 0.5 ELSE least(greatest(0.5 + 1.25 * (usual_km - s.km) / usual_km, 0), 1) END AS c,
    CASE WHEN r_trim = 'ok' THEN 1.0 WHEN r_trim IS NULL THEN 0.5 ELSE 0.2 END AS e,
    pow(0.5, (now - seen) * 24 / 24.0) AS f, ((s.km IS NOT NULL)::INT + (s.price IS NOT NULL)::INT + (s.year IS NOT NULL)::INT + (discount > 0)::INT) / 4.0 AS g
  FROM states s JOIN ref ON s.make = ref.make AND s.model = ref.model WHERE fails = 0),
q AS (SELECT *, CAST(floor(round(35 * a + 25 * b + 15 * c + 10 * e + 10 * f + 5 * g, 6) + 0.5) AS INTEGER) AS score FROM p WHERE NOT (partial OR d >= 65 OR (d >= 50 AND financing)))
SELECT search, id, score, CASE WHEN (d >= 50 OR no_year) AND score >= 85 THEN 'good' WHEN score >= 85 THEN 'high' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'match' ELSE 'low' END AS level FROM q
""")
def opportunity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("search", "id", "score", "level")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with their score and level, without those that a guard excludes."""
    want, offers = sides(spark, sf_dir)
    m = hits(want, referenced(spark, sf_dir, offers))
    asked = count("ok") + count("fail") + count("unknown")
    trim = F.when(F.col("r_trim") == "ok", 1.0).when(F.col("r_trim").isNull(), 0.5).otherwise(0.2)
    kept = m.filter(~left_out()).withColumn("score", scoring.score(score_parts(asked, count("ok"), count("unknown"), trim)))
    return kept.withColumn("level", scoring.level(F.col("score"), (F.col("d") >= 50) | F.col("year").isNull()))


def referenced(spark: SparkSession, sf_dir: str, offers: DataFrame) -> DataFrame:
    """Offers with n, median and usual_km of their make and model, and d, how far under the median they are in percent."""
    ref = listings(spark, sf_dir).groupBy("make", "model").agg(F.count(F.lit(1)).alias("n"), F.percentile("price", F.lit(0.5)).alias("median"), F.percentile("km", F.lit(0.5)).alias("usual_km"))
    return offers.join(ref, ["make", "model"]).withColumn("d", (1 - F.col("price") / F.col("median")) * 100)


def left_out() -> Column:
    return scoring.excluded(F.col("d"), F.col("tax") >= 0.08, F.col("discount") >= 0.09)


def score_parts(asked: Column, oks: Column, unknowns: Column, trim: Column) -> dict[str, Column]:
    """The parts of the score of a match of a referenced offer, of so many rules asked."""
    full = sum((F.coalesce(c, F.lit(False)).cast("int") for c in (F.col("km").isNotNull(), F.col("price").isNotNull(), F.col("year").isNotNull(), F.col("discount") > 0)), F.lit(0)) / 4.0
    return scoring.parts(F.col("n"), F.col("d"), oks / asked, unknowns / asked, F.col("km"), F.col("usual_km"), trim, F.datediff("now", "seen") * 24, full)


@query(_ctes() + """,
ref AS (SELECT make, model, count(*) AS n, quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.25) AS p25, quantile_cont(price, 0.75) AS p75 FROM listings GROUP BY make, model),
x AS (SELECT search, id, n, (1 - price / median) * 100 AS d, least(greatest(2.5 * ln(median / p25) * 100, 12), 20) AS d_full, (oks + 0.75 * unknowns) / (oks + fails + unknowns) AS fit FROM states s JOIN ref ON s.make = ref.make AND s.model = ref.model WHERE fails = 0),
y AS (SELECT search, id, fit, 0.4 + (least(greatest(0.4 + 0.6 * d / d_full, 0), 1) - 0.4) * (n / (n + 8.0)) AS deal FROM x)
SELECT search, id, round(deal, 4) AS deal, round(fit, 4) AS fit, CAST(floor(round(100 * deal * fit, 6) + 0.5) AS INTEGER) AS score FROM y
""")
def deal_fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deal times fit: how far under the usual price, measured by the spread, shrunk by the size of the reference."""
    ref = listings(spark, sf_dir).groupBy("make", "model").agg(F.count(F.lit(1)).alias("n"), F.percentile("price", F.array(F.lit(0.25), F.lit(0.5))).alias("p"))
    want, offers = sides(spark, sf_dir)
    m = hits(want, offers.join(ref, ["make", "model"]))
    median, p25 = F.get("p", F.lit(1)), F.get("p", F.lit(0))
    d, d_full = (1 - F.col("price") / median) * 100, scoring.clamp(2.5 * F.log(median / p25) * 100, 12.0, 20.0)
    deal = 0.4 + (scoring.clamp(0.4 + 0.6 * d / d_full) - 0.4) * (F.col("n") / (F.col("n") + 8.0))
    fit = (count("ok") + 0.75 * count("unknown")) / (count("ok") + count("fail") + count("unknown"))
    return m.select("search", "id", deal.alias("d"), fit.alias("f")).select("search", "id", dec("d").alias("deal"), dec("f").alias("fit"), scoring.half_up(F.round(100 * F.col("d") * F.col("f"), 6)).alias("score"))


@query(f"""
WITH {LISTINGS}, ref AS (SELECT make, model, quantile_cont(price, 0.5) AS median FROM listings GROUP BY make, model)
SELECT id, array_to_string(list_filter([
  CASE WHEN (1 - price / median) * 100 >= 50 THEN 'much_cheaper_50' WHEN (1 - price / median) * 100 >= 35 THEN 'much_cheaper_35' WHEN (1 - price / median) * 100 >= 25 THEN 'much_cheaper_25' END,
  CASE WHEN km / greatest(2002 - year, 1) < 2 THEN 'few_km' END, CASE WHEN km IS NULL THEN 'no_km' END, CASE WHEN regexp_matches(CAST(CAST(floor(price) AS BIGINT) AS VARCHAR), '^(1{{4,}}|2{{4,}}|3{{4,}}|4{{4,}}|5{{4,}}|6{{4,}}|7{{4,}}|8{{4,}})$') THEN 'placeholder_price' END,
  CASE WHEN contains(title, 'red') THEN 'red_title' END, CASE WHEN discount >= 0.09 THEN 'financing' END], lambda x: x IS NOT NULL), ',') AS flags
FROM listings JOIN ref USING (make, model)
""")
def red_flags_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = listings(spark, sf_dir)
    ref = offers.groupBy("make", "model").agg(F.percentile("price", F.lit(0.5)).alias("median"))
    d = (1 - F.col("price") / F.col("median")) * 100
    flags = [("much_cheaper_50", d >= 50), ("much_cheaper_35", (d >= 35) & (d < 50)), ("much_cheaper_25", (d >= 25) & (d < 35)), ("few_km", F.col("km") / F.greatest(2002 - F.col("year"), F.lit(1)) < 2), ("no_km", F.col("km").isNull()), ("placeholder_price", T.placeholder_price(F.col("price"))), ("red_title", F.col("title").contains("red")), ("financing", F.col("discount") >= 0.09)]
    return offers.join(ref, ["make", "model"]).select("id", scoring.ordered_flags(flags).alias("flags"))


@query(_ctes() + """,
k AS (SELECT *, row_number() OVER (PARTITION BY search ORDER BY seen DESC, id DESC) AS r, count(*) OVER (PARTITION BY search) AS n FROM states WHERE fails = 0)
SELECT search, CAST(any_value(n) AS BIGINT) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY r) AS newest FROM k WHERE r <= 3 GROUP BY search
""")
def preview_count_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many offers a search would get, and the newest three; missing values pass."""
    want, offers = sides(spark, sf_dir)
    n = search_bits.sums(want, offers).filter("n_match > 0").select("search", F.col("n_match").alias("n"))
    near = search_bits.first(want, offers, 3, [-F.unix_date("seen"), F.lit(0)], newest_id=True)
    top = near.withColumn("r", F.row_number().over(W.partitionBy("search").orderBy("p0", F.desc("id")))).filter("r <= 3")
    return n.join(_listed(top, "r").withColumnRenamed("ids", "newest"), "search")


def _listed(top: DataFrame, k: str) -> DataFrame:
    """(search, ids): a search's few ids in the order of k, joined by commas."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct(k, "id"))), lambda x: x["id"].cast("string"))
    return top.groupBy("search").agg(F.array_join(ids, ",").alias("ids"))


@query(_ctes() + """
SELECT search, id, CAST(row_number() OVER (PARTITION BY search ORDER BY price, km NULLS LAST, id) AS INTEGER) AS place
FROM states WHERE fails = 0 QUALIFY place BETWEEN 3 AND 12
""")
def search_results_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of each search's results: sorted by price, missing km last, an id to break ties; offset 2, limit 10."""
    near = search_bits.first(*sides(spark, sf_dir), 12, [F.col("price"), F.col("km")])
    place = F.row_number().over(W.partitionBy("search").orderBy(F.asc_nulls_last("p0"), F.asc_nulls_last("p1"), "id"))
    return near.select("search", "id", place.alias("place")).filter(F.col("place").between(3, 12))


@query(_ctes() + """
SELECT rule, count(*) FILTER (WHERE state = 'fail') AS fails, count(*) FILTER (WHERE state = 'fail' AND fails = 1) AS only_fails, count(*) FILTER (WHERE state = 'unknown') AS unknowns, count(DISTINCT search) FILTER (WHERE state = 'fail' AND fails = 1) AS searches_gaining
FROM (SELECT search, fails, unnest(['year', 'price', 'km', 'gearbox', 'trim']) AS rule, unnest([r_year, r_price, r_km, r_gearbox, r_trim]) AS state FROM states) GROUP BY rule
""")
def relaxation_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = search_bits.sums(*sides(spark, sf_dir))
    total = n.agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.lit(k).alias("rule"), F.sum(f"fail_{k}").alias("fails"), F.sum(f"only_{k}").alias("only_fails"), F.sum(f"unknown_{k}").alias("unknowns"), F.count_if(F.col(f"only_{k}") > 0).alias("searches_gaining")).alias(k) for k in RULES])
    return total.filter("n > 0").select(F.inline(F.array(*RULES)))


@query(_ctes() + """,
g AS (SELECT search, unnest(['price', 'trim', 'year', 'km', 'gearbox']) AS cause, unnest([count(*) FILTER (WHERE fails = 1 AND r_price = 'fail'), count(*) FILTER (WHERE fails = 1 AND r_trim = 'fail'), count(*) FILTER (WHERE fails = 1 AND r_year = 'fail'), count(*) FILTER (WHERE fails = 1 AND r_km = 'fail'), count(*) FILTER (WHERE fails = 1 AND r_gearbox = 'fail')]) AS gain, unnest([1, 2, 3, 4, 5]) AS priority FROM states GROUP BY search)
SELECT search, min_by(cause, (-gain, priority)) AS main_cause, max(gain) AS gain FROM g WHERE gain > 0 GROUP BY search
""")
def unmet_demand_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["price", "trim", "year", "km", "gearbox"]
    n = search_bits.sums(*sides(spark, sf_dir))
    gains = n.filter(" + ".join(f"only_{k}" for k in order) + " > 0").select("search", *[F.col(f"only_{k}").alias(k) for k in order])
    best = F.array_max(F.array(*[F.struct(F.col(k).alias("gain"), F.lit(-i).alias("p"), F.lit(k).alias("cause")) for i, k in enumerate(order)]))
    return gains.select("search", best["cause"].alias("main_cause"), best["gain"].alias("gain"))


@query(_ctes() + """,
s AS (SELECT m.search, m.id, m.price, m.seen FROM states m WHERE fails = 0 AND unknowns = 0)
SELECT search, min_by(id, (price, id)) AS id, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY search
""")
def missed_car(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest offer that surely fits: a bound that the search sets requires the value."""
    want, offers = sides(spark, sf_dir)
    n = search_bits.sums(want, offers).filter("n_sure > 0").select("search", F.col("n_sure").alias("n"))
    near = search_bits.first(want, offers, 1, [F.col("price"), F.lit(0)], keep="sure")
    least = near.groupBy("search").agg(F.min_by("id", F.struct(F.col("p0").isNull(), "p0", "id")).alias("id"))
    return least.join(n, "search")


@query(f"""
WITH {LISTINGS}, solid AS (SELECT * FROM listings WHERE km IS NOT NULL AND tax < 0.08),
one AS (SELECT make, model, id, price, seen, row_number() OVER (PARTITION BY make, model ORDER BY seen DESC, price, id) AS k FROM solid),
top AS (SELECT make, model FROM solid GROUP BY make, model HAVING count(DISTINCT seller) >= 3 ORDER BY count(*) DESC, make, model LIMIT 20)
SELECT o.make, o.model, o.id, o.price FROM one o JOIN top USING (make, model) WHERE k = 1
""")
def landing_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    solid = listings(spark, sf_dir).filter("km IS NOT NULL AND tax < 0.08")
    top = solid.groupBy("make", "model").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seller").alias("sellers")).filter("sellers >= 3").orderBy(F.desc("n"), "make", "model").limit(20)
    newest = F.min_by(F.struct("id", "price"), F.struct(-F.unix_date("seen"), F.col("price"), F.col("id")))
    return solid.join(F.broadcast(top.select("make", "model")), ["make", "model"]).groupBy("make", "model").agg(newest.alias("x")).select("make", "model", "x.id", "x.price")


@query(_ctes() + """,
t AS (SELECT search, id, oks, price, row_number() OVER (PARTITION BY search ORDER BY oks DESC, price, id) AS k FROM states WHERE fails = 0)
SELECT search, string_agg(CAST(id AS VARCHAR), ',' ORDER BY k) AS cars FROM t WHERE k <= 3 GROUP BY search
""")
def welcome_cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three matches with most bounds met: of a search's matches those with the fewest unknown."""
    near = search_bits.first(*sides(spark, sf_dir), 3, [F.col("price"), F.lit(0)], keep="fewest")
    k = F.row_number().over(W.partitionBy("search").orderBy("unknowns", F.asc_nulls_last("p0"), "id"))
    return _listed(near.withColumn("k", k).filter("k <= 3"), "k").withColumnRenamed("ids", "cars")


@query(f"""
WITH {SEARCHES}
SELECT make, zone, count(*) AS members, min(year_min) AS year_min, CASE WHEN count(*) FILTER (WHERE price_max IS NULL) > 0 THEN NULL ELSE CAST(ceil(max(price_max) / 1000) * 1000 AS BIGINT) END AS price_cap, CASE WHEN count(*) FILTER (WHERE km_max IS NULL) > 0 THEN NULL ELSE max(km_max) END AS km_max
FROM searches GROUP BY make, zone
""")
def target_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches grouped to their widest query: a bound stands only if every member has one."""
    open_ = lambda c, v: F.when(F.count_if(F.col(c).isNull()) > 0, None).otherwise(v)
    return searches(spark, sf_dir).groupBy("make", "zone").agg(F.count(F.lit(1)).alias("members"), F.min("year_min").alias("year_min"), open_("price_max", (F.ceil(F.max("price_max") / 1000) * 1000).cast("bigint")).alias("price_cap"), open_("km_max", F.max("km_max")).alias("km_max"))


_PLACES = """
cust AS (SELECT c_custkey AS id, -55 + (c_custkey * 37 % 3300) / 100.0 AS lat, -72 + (c_custkey * 53 % 1800) / 100.0 AS lon FROM customer),
supp AS (SELECT s_suppkey AS id, -55 + (s_suppkey * 71 % 3300) / 100.0 AS lat, -72 + (s_suppkey * 29 % 1800) / 100.0 AS lon FROM supplier)
"""


def _places(spark: SparkSession, sf_dir: str, name: str, key: str, a: int, b: int) -> DataFrame:
    k = F.col(key)
    return table(spark, sf_dir, name).select(k.alias("id"), (-55 + (k * a % 3300) / 100.0).alias("lat"), (-72 + (k * b % 1800) / 100.0).alias("lon"))


@query(f"WITH {_PLACES} SELECT a.id AS customer, b.id AS supplier, round({HAVERSINE_SQL.format(a='a', b='b')}, 3) AS km FROM cust a JOIN supp b ON {HAVERSINE_SQL.format(a='a', b='b')} <= 80")
def radius_join(spark: SparkSession, sf_dir: str, radius: float = 80.0) -> DataFrame:
    """Pairs within a radius: by cells of a degree or so, neighbours exploded on one side, the distance as a residue.

    Distances are worked out between distinct places, and the customers of a place then meet the suppliers near it. Few bytes
    make many pairs, so both joins are of blocks, in tasks dealt by pairs.
    """
    a, b = _places(spark, sf_dir, "customer", "c_custkey", 37, 53), _places(spark, sf_dir, "supplier", "s_suppkey", 71, 29)
    size_lat, size_lon = radius / 111.0, radius / (111.0 * 0.55)  # a degree of longitude at 55 degrees south is 0.57 of one of latitude
    here, there = F.struct("lat", "lon"), F.struct("lat2", "lon2")
    near = F.explode(F.array(*[F.struct((cell(F.col("lat"), size_lat) + i).alias("y"), (cell(F.col("lon"), size_lon) + j).alias("x")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    theirs = b.select("id", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    spots = theirs.select("lat2", "lon2").distinct().select(there.alias("id"), F.struct(cell(F.col("lat2"), size_lat).alias("y"), cell(F.col("lon2"), size_lon).alias("x")).alias("kind"))
    mine = a.select("lat", "lon").distinct().select(here.alias("search"), near.alias("kind"))
    met = match_blocks.met(*match_blocks.dealt(mine, spots, match_blocks.PAIR_BLOCK))
    met = met.withColumn("km", haversine_km(F.col("search.lat"), F.col("search.lon"), F.col("id.lat2"), F.col("id.lon2"))).filter(F.col("km") <= radius)
    around = settled(met.select(F.col("search").alias("kind"), "id.lat2", "id.lon2", dec("km", 3).alias("km")).join(theirs, ["lat2", "lon2"]).select("kind", "id", "km"))
    pairs = match_blocks.met(*match_blocks.dealt(a.select(here.alias("kind"), F.col("id").alias("search")), around, match_blocks.PAIR_BLOCK))
    return pairs.select(F.col("search").alias("customer"), F.col("id").alias("supplier"), "km")


@query(f"WITH {_PLACES}, d AS (SELECT a.id, b.n_nationkey AS nation, {HAVERSINE_SQL.format(a='a', b='b')} AS km FROM cust a, (SELECT n_nationkey, -55 + (n_nationkey * 131 % 3300) / 100.0 AS lat, -72 + (n_nationkey * 77 % 1800) / 100.0 AS lon FROM nation) b) SELECT id, min_by(nation, (km, nation)) AS nearest, round(min(km), 3) AS km FROM d GROUP BY id")
def nearest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of a fixed list of places: the list is one small array, so it is a fold over a column, not a join."""
    k = F.col("n_nationkey")
    spots = table(spark, sf_dir, "nation").select(F.struct(k.alias("k"), (-55 + (k * 131 % 3300) / 100.0).alias("lat"), (-72 + (k * 77 % 1800) / 100.0).alias("lon")).alias("p")).agg(F.collect_list("p").alias("spots"))  # nations: a fixed, small dimension
    a = _places(spark, sf_dir, "customer", "c_custkey", 37, 53).crossJoin(F.broadcast(spots))
    best = F.array_min(F.transform("spots", lambda p: F.struct(haversine_km(F.col("lat"), F.col("lon"), p["lat"], p["lon"]).alias("km"), p["k"].alias("k"))))
    return a.select("id", best.alias("b")).select("id", F.col("b.k").alias("nearest"), dec(F.col("b.km"), 3).alias("km"))
