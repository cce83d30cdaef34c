"""Reports over users, alerts, digests, models and weeks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import dec, newest, query, table
from .cars import CTES, cars, profiles
from .rules import _COUNTED, sides, totals

c = F.col


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("""WITH n AS (SELECT max(ts) AS now FROM events), a AS (SELECT user_id, min(ts) AS first_alert, count(*) AS alerts, bool_or(value > 45) AS opened, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id)
SELECT c_custkey AS user_id, c_mktsegment AS plan, coalesce(alerts, 0) AS alerts, coalesce(opened, false) AS opened, coalesce(kinds, '') AS kinds, date_diff('day', CAST(first_alert AS DATE), CAST(now AS DATE)) AS age_days FROM customer LEFT JOIN a ON a.user_id = c_custkey, n WHERE c_mktsegment <> 'HOUSEHOLD'""")
def metric_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users but for the staff, with what they were sent and whether they opened any of it."""
    e = events(spark, sf_dir)
    a = e.filter(c("event_type").isin("view", "click")).groupBy("user_id").agg(F.min("ts").alias("first"), F.count("*").alias("alerts"), F.bool_or(c("value") > 45).alias("opened"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))
    u = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'HOUSEHOLD'").select(c("c_custkey").alias("user_id"), c("c_mktsegment").alias("plan"))
    none = lambda k, v: F.coalesce(c(k), F.lit(v)).alias(k)
    return u.join(a, "user_id", "left").join(newest(e, "ts")).select("user_id", "plan", none("alerts", 0), none("opened", False), none("kinds", ""), F.datediff("now", "first").cast("long").alias("age_days"))


@query("""WITH s AS (SELECT user_id, min(ts) AS joined FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT s.user_id, CAST(joined AS DATE) AS joined, EXISTS (SELECT 1 FROM events e WHERE e.user_id = s.user_id AND e.event_type = 'purchase' AND e.ts > joined AND e.ts <= joined + INTERVAL 7 DAY) AS bought_in_week, EXISTS (SELECT 1 FROM events e WHERE e.user_id = s.user_id AND e.event_type = 'click' AND e.ts > joined AND e.ts <= joined + INTERVAL 1 DAY) AS active_in_day FROM s""")
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each signup within a day and a week."""
    e = events(spark, sf_dir)
    s = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("joined"))
    after = e.filter("event_type IN ('purchase', 'click')").join(s, "user_id").filter(c("ts") > c("joined"))
    within = lambda t, d: F.bool_or((c("event_type") == t) & (c("ts") <= c("joined") + F.expr(f"INTERVAL {d} DAYS")))
    did = after.groupBy("user_id").agg(within("purchase", 7).alias("b"), within("click", 1).alias("a"))
    return s.join(did, "user_id", "left").select("user_id", F.to_date("joined").alias("joined"), F.coalesce("b", F.lit(False)).alias("bought_in_week"), F.coalesce("a", F.lit(False)).alias("active_in_day"))


@query("""SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS contacted FROM (SELECT user_id, min(ts) AS ts FROM (SELECT user_id, ts FROM events WHERE event_type = 'click' AND value > 25 UNION SELECT user_id, ts FROM events WHERE event_type = 'purchase') GROUP BY user_id, date_trunc('week', ts)) GROUP BY ALL""")
def contacted_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of each week who said or showed that they had got in touch; both ways count once."""
    e = events(spark, sf_dir)
    week = F.to_date(F.date_trunc("week", "ts")).alias("week")
    both = e.filter("event_type = 'click' AND value > 25").select("user_id", week).union(e.filter("event_type = 'purchase'").select("user_id", week)).distinct()
    return both.groupBy("week").agg(F.count("*").alias("contacted"))


@query(f"""{_COUNTED}, h AS (SELECT p.segment, CASE WHEN unknowns > 0 THEN 'unsure' ELSE 'sure' END AS kind, k.search FROM counted k JOIN profiles p ON p.search = k.search WHERE fails = 0)
SELECT segment, kind, count(*) AS hidden, count(DISTINCT search) AS searches, min(kind) AS best FROM h GROUP BY GROUPING SETS ((segment, kind), (segment), ())""")
def cap_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies beyond the caps, by plan and kind, by plan, and in all."""
    searches, offers = sides(spark, sf_dir)
    kinds = F.explode(F.map_from_arrays(F.array(F.lit("sure"), F.lit("unsure")), F.array(c("n_sure"), c("n_match") - c("n_sure")))).alias("kind", "n")
    h = totals(searches, offers).select("search", kinds).filter("n > 0").join(searches.select("search", "segment"), "search")
    sets = h.withColumn("best", c("kind")).groupingSets([[c("segment"), c("kind")], [c("segment")], []], c("segment"), c("kind"))
    return sets.agg(F.sum("n").alias("hidden"), F.count_distinct("search").alias("searches"), F.min("best").alias("best"))


@query(f"""WITH {CTES}, d AS (SELECT make, model, count(*) AS searches FROM profiles WHERE model IS NOT NULL GROUP BY ALL), o AS (SELECT make, model, id, price_usd, row_number() OVER (PARTITION BY make, model ORDER BY price_usd, id) AS k FROM cars WHERE price_usd > 0 AND NOT price_partial AND status = 'active')
SELECT d.make, d.model, searches, o.id AS cheapest, round(o.price_usd, 2) AS price FROM d LEFT JOIN o ON o.make = d.make AND o.model = d.model AND k = 1""")
def guide_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models asked for, by demand, each with its cheapest offer."""
    d = profiles(spark, sf_dir).filter("model IS NOT NULL").groupBy("make", "model").agg(F.count("*").alias("searches"))
    o = cars(spark, sf_dir).filter("price_usd > 0 AND NOT price_partial AND status = 'active'").groupBy("make", "model").agg(F.min(F.struct("price_usd", "id")).alias("m"))
    return d.join(o, ["make", "model"], "left").select("make", "model", "searches", c("m.id").alias("cheapest"), F.round("m.price_usd", 2).alias("price"))


_DIGESTS = "digests AS (SELECT user_id, CAST(ts AS DATE) AS day, '[' || string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) || ']' AS items FROM events WHERE event_type = 'view' GROUP BY user_id, CAST(ts AS DATE))"


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest a user and day, its items as a JSON array."""
    v = events(spark, sf_dir).filter("event_type = 'view'")
    items = F.to_json(F.array_sort(F.collect_list("event_id")))
    return v.groupBy("user_id", F.to_date("ts").alias("day")).agg(items.alias("items"))


@query(f"WITH {_DIGESTS} SELECT user_id, day, item FROM (SELECT user_id, day, unnest(CAST(items AS BIGINT[])) AS item FROM digests)")
def digest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of stored digests, one row each."""
    return digests(spark, sf_dir).select("user_id", "day", F.explode_outer(F.from_json("items", "array<bigint>")).alias("item"))


@query(f"""WITH {_DIGESTS}, shown AS (SELECT DISTINCT user_id, unnest(CAST(items AS BIGINT[])) % 10 AS dealer FROM digests), clicked AS (SELECT DISTINCT user_id, event_id % 10 AS dealer FROM events WHERE event_type = 'click'), sold AS (SELECT DISTINCT user_id, event_id % 10 AS dealer FROM events WHERE event_type = 'purchase')
SELECT s.dealer, count(*) AS reached, count(k.user_id) AS clicked, count(p.user_id) AS bought, CASE WHEN count(k.user_id) >= 3 THEN round(count(p.user_id) / count(k.user_id), 4) END AS rate
FROM shown s LEFT JOIN clicked k ON k.user_id = s.user_id AND k.dealer = s.dealer LEFT JOIN sold p ON p.user_id = k.user_id AND p.dealer = k.dealer WHERE s.user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD') GROUP BY s.dealer""")
def dealer_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People whom a dealer's items reached, who clicked and who bought, each once; the staff doesn't count, and a rate needs three people."""
    e = events(spark, sf_dir)
    staff = table(spark, sf_dir, "customer").filter("c_mktsegment = 'HOUSEHOLD'").select(c("c_custkey").alias("user_id"))
    shown = digests(spark, sf_dir).select("user_id", F.explode(F.from_json("items", "array<bigint>")).alias("i")).select("user_id", (c("i") % 10).alias("dealer")).distinct().join(staff, "user_id", "left_anti")
    did = e.filter("event_type IN ('click', 'purchase')").groupBy("user_id", (c("event_id") % 10).alias("dealer")).agg(F.bool_or(c("event_type") == "click").alias("k"), F.bool_or(c("event_type") == "purchase").alias("p"))
    x = shown.join(did, ["user_id", "dealer"], "left")
    clicked, bought = F.count_if(c("k")), F.count_if(c("k") & c("p"))
    return x.groupBy("dealer").agg(F.count("*").alias("reached"), clicked.alias("clicked"), bought.alias("bought"), F.when(clicked >= 3, F.round(bought / clicked, 4)).alias("rate"))


@query(f"""WITH {CTES}, m AS (SELECT make, model, count(*) AS n FROM cars WHERE model IS NOT NULL GROUP BY ALL) SELECT make, CAST(to_json(list({{'model': model, 'n': n}} ORDER BY n DESC, model)) AS VARCHAR) AS models FROM m GROUP BY make""")
def models_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models of each make as an ordered JSON array of objects."""
    m = cars(spark, sf_dir).filter("model IS NOT NULL").groupBy("make", "model").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-c("n")).alias("o"), "model", "n")))
    return m.groupBy("make").agg(F.to_json(F.transform(ordered, lambda x: F.struct(x["model"].alias("model"), x["n"].alias("n")))).alias("models"))


@query(f"WITH {CTES} SELECT c.id, p.search FROM cars c JOIN profiles p ON lower(c.make) = lower(upper(p.make)) AND lower(c.model) = lower(upper(p.model))")
def case_blind_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches and offers by make and model, however they are capitalised: both sides are lowered before the join."""
    low = lambda k: F.lower(F.upper(k)).alias(k)
    p = profiles(spark, sf_dir).select("search", low("make"), low("model"))
    return cars(spark, sf_dir).select("id", F.lower("make").alias("make"), F.lower("model").alias("model")).join(p, ["make", "model"]).select("id", "search")


@query(f"""WITH {CTES}, batch AS (SELECT DISTINCT repost_of AS id FROM cars WHERE repost_of IS NOT NULL) SELECT b.id, c.id IS NOT NULL AS there, round(c.price_usd, 2) AS price FROM batch b LEFT JOIN cars c ON c.id = b.id""")
def batch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored rows of a batch of keys, in one join; keys that aren't there stay."""
    o = cars(spark, sf_dir)
    batch = o.filter("repost_of IS NOT NULL").select(c("repost_of").alias("id")).distinct()
    return batch.join(o.select("id", F.lit(True).alias("hit"), "price_usd"), "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("there"), F.round("price_usd", 2).alias("price"))


_BAND = "CASE WHEN price_usd < 20000 THEN 'low' WHEN price_usd < 50000 THEN 'mid' ELSE 'high' END"


@query(f"""WITH {CTES}, x AS (SELECT make, {_BAND} AS band FROM cars WHERE price_usd > 0), s AS (SELECT band, count(*) AS n, (SELECT count(*) FROM x) AS total FROM x GROUP BY band), m AS (SELECT make, count(*) AS n FROM x GROUP BY make), o AS (SELECT make, band, count(*) AS n FROM x GROUP BY ALL)
SELECT m.make, s.band, coalesce(o.n, 0) AS observed, round(m.n * s.n / s.total, 4) AS expected FROM m JOIN s ON true LEFT JOIN o ON o.make = m.make AND o.band = s.band""")
def expected_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of each make and price band against what the bands' shares in all lead to expect."""
    band = F.when(c("price_usd") < 20000, "low").when(c("price_usd") < 50000, "mid").otherwise("high")
    o = cars(spark, sf_dir).filter("price_usd > 0").groupBy("make", band.alias("band")).agg(F.count("*").alias("n"))
    bands = o.groupBy("band").agg(F.sum("n").alias("b"))
    total = bands.agg(F.sum("b").alias("t"))
    shares = F.broadcast(bands.join(F.broadcast(total)))  # three bands
    makes = o.groupBy("make").agg(F.sum("n").alias("m"))
    full = makes.join(shares)
    return full.join(o, ["make", "band"], "left").select("make", "band", F.coalesce("n", F.lit(0)).alias("observed"), F.round(c("m") * c("b") / c("t"), 4).alias("expected"))


@query(f"""WITH {CTES}, w AS (SELECT DISTINCT CAST(date_trunc('week', seen) AS DATE) AS week FROM cars), n AS (SELECT CAST(date_trunc('week', max(seen)) AS DATE) AS now FROM cars) SELECT week FROM w, n WHERE week < now AND week >= now - 21""")
def weeks_to_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last closed week and the two before it."""
    o = cars(spark, sf_dir).select(F.to_date(F.date_trunc("week", "seen")).alias("week"))
    return o.distinct().join(newest(o, "week")).filter((c("week") < c("now")) & (c("week") >= F.date_sub("now", 21))).select("week")


@query(f"""WITH {CTES}, w AS (SELECT CAST(date_trunc('week', seen) AS DATE) AS week, count(*) AS n FROM cars GROUP BY ALL), l AS (SELECT *, lag(n) OVER (ORDER BY week) AS before FROM w)
SELECT week, n, CASE WHEN n < 5 THEN 'dry_run' WHEN before IS NOT NULL AND n < before * 0.5 THEN 'reject' ELSE 'write' END AS state FROM l""")
def weekly_run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a week's rows are written: too few are only shown, half of the week before are refused."""
    w = cars(spark, sf_dir).groupBy(F.to_date(F.date_trunc("week", "seen")).alias("week")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(W.orderBy("week"))  # one row a week
    return w.withColumn("before", before).select("week", "n", F.when(c("n") < 5, "dry_run").when(c("before").isNotNull() & (c("n") < c("before") * 0.5), "reject").otherwise("write").alias("state"))


@query(f"""WITH RECURSIVE {CTES}, m AS (SELECT make, CAST(date_trunc('month', seen) AS DATE) AS month, quantile_cont(price_usd, 0.5) AS median FROM cars WHERE price_usd > 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY make ORDER BY month) AS k FROM m),
f AS (SELECT make, month, k, median, median AS mark, false AS told FROM r WHERE k = 1 UNION ALL SELECT r.make, r.month, r.k, r.median, CASE WHEN abs(r.median / f.mark - 1) >= 0.1 THEN r.median ELSE f.mark END, abs(r.median / f.mark - 1) >= 0.1 FROM f JOIN r ON r.make = f.make AND r.k = f.k + 1)
SELECT make, month, round(median, 4) AS median FROM f WHERE told""")
def market_move_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months in which a make's median has moved by a tenth since it was last told; the mark moves only when it is."""
    m = cars(spark, sf_dir).filter("price_usd > 0").groupBy("make", F.to_date(F.date_trunc("month", "seen")).alias("month")).agg(F.percentile("price_usd", F.lit(0.5)).alias("median"))
    months = m.groupBy("make").agg(F.array_sort(F.collect_list(F.struct("month", "median"))).alias("ms"))  # a row for each month
    empty = F.array().cast("array<struct<month:date,median:double>>")

    def step(acc, x):
        moved = acc["mark"].isNotNull() & (F.abs(x["median"] / acc["mark"] - 1) >= 0.1)
        return F.struct(F.when(acc["mark"].isNull() | moved, x["median"]).otherwise(acc["mark"]).alias("mark"), F.when(moved, F.concat(acc["told"], F.array(x))).otherwise(acc["told"]).alias("told"))

    told = F.aggregate("ms", F.struct(F.lit(None).cast("double").alias("mark"), empty.alias("told")), step, lambda a: a["told"])
    return months.select("make", F.explode(told).alias("x")).select("make", "x.month", dec("x.median").alias("median"))


@query(f"""WITH {CTES}, p AS (SELECT * FROM cars WHERE price_usd > 0 AND year IS NOT NULL), ref AS (SELECT make, year, quantile_cont(price_usd, 0.5) AS m FROM p GROUP BY ALL HAVING count(*) >= 5), r AS (SELECT p.make, p.km, p.year, CASE WHEN m IS NOT NULL THEN ln(price_usd / m) END AS off, ref.m FROM p LEFT JOIN ref ON ref.make = p.make AND ref.year = p.year)
SELECT make, count(*) AS n, round(count(m) / count(*), 4) AS coverage, round(quantile_cont(abs(off), 0.5), 6) AS error, round(corr(off, km), 4) AS by_km, round(corr(off, year), 4) AS by_year FROM r GROUP BY make""")
def reference_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a reference covers each make, its error, and whether the error leans on mileage or year."""
    p = cars(spark, sf_dir).filter("price_usd > 0 AND year IS NOT NULL")
    ref = p.groupBy("make", "year").agg(F.percentile("price_usd", F.lit(0.5)).alias("m"), F.count("*").alias("k")).filter("k >= 5")
    r = p.join(ref, ["make", "year"], "left").withColumn("off", F.ln(c("price_usd") / c("m")))
    return r.groupBy("make").agg(F.count("*").alias("n"), F.round(F.count("m") / F.count("*"), 4).alias("coverage"), dec(F.percentile(F.abs("off"), F.lit(0.5)), 6).alias("error"), F.round(F.corr("off", "km"), 4).alias("by_km"), F.round(F.corr("off", "year"), 4).alias("by_year"))


@query(f"""WITH {CTES}, old AS (SELECT make, model, count(*) AS n FROM cars WHERE model IS NOT NULL AND seen < DATE '1998-01-01' GROUP BY ALL), new AS (SELECT make, model, count(*) AS n, count(DISTINCT year) AS years FROM cars WHERE model IS NOT NULL AND seen >= DATE '1996-01-01' AND NOT price_partial GROUP BY ALL)
SELECT coalesce(n.make, o.make) AS make, coalesce(n.model, o.model) AS model, CASE WHEN n.n IS NULL THEN 'disabled' WHEN n.n >= 20 AND years >= 2 THEN 'fitted' WHEN o.n IS NOT NULL THEN 'kept' ELSE 'failed' END AS state FROM old o FULL JOIN new n ON o.make = n.make AND o.model = n.model""")
def fit_all_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each model's curve: fitted anew, kept from before where a fit failed, disabled where its offers are gone."""
    o = cars(spark, sf_dir).filter("model IS NOT NULL")
    old = o.filter(c("seen") < F.lit("1998-01-01").cast("date")).groupBy("make", "model").agg(F.count("*").alias("was"))
    new = o.filter((c("seen") >= F.lit("1996-01-01").cast("date")) & ~c("price_partial")).groupBy("make", "model").agg(F.count("*").alias("n"), F.count_distinct("year").alias("years"))
    state = F.when(c("n").isNull(), "disabled").when((c("n") >= 20) & (c("years") >= 2), "fitted").when(c("was").isNotNull(), "kept").otherwise("failed")
    return old.join(new, ["make", "model"], "full").select("make", "model", state.alias("state"))


@query(f"""WITH {CTES} SELECT search, len(CASE WHEN search % 7 = 0 THEN NULL ELSE string_split(body_types, ',') END) AS n_bodies, CASE WHEN search % 7 = 0 THEN NULL ELSE string_split(body_types, ',')[1] END AS first_body, CASE WHEN search % 7 = 0 THEN NULL ELSE list_contains(string_split(body_types, ','), 'suv') END AS wants_suv FROM profiles""")
def filter_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of a search's stored JSON filters; one that isn't an array is none."""
    listed = F.to_json(F.struct(F.split("body_types", ",").alias("body_types")))
    stored = F.when(c("search") % 7 == 0, F.lit('{"body_types": "suv"}')).otherwise(listed)
    got = F.from_json(F.get_json_object(stored, "$.body_types"), "array<string>")
    arr = F.when(F.substring(F.get_json_object(stored, "$.body_types"), 1, 1) == "[", got)
    return profiles(spark, sf_dir).select("search", F.when(arr.isNotNull(), F.size(arr)).cast("long").alias("n_bodies"), F.get(arr, F.lit(0)).alias("first_body"), F.array_contains(arr, "suv").alias("wants_suv"))
