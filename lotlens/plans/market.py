"""The market around an offer: reappearances, foreign copies, news, costs, references, guides, questions, places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geo import haversine_km
from ..operators import rules
from .base import dec, newest, query, table
from .cars import CTES, cars, profiles
from .normalize import _pick
from .text import _p

c = F.col
_SAME = "o.make = n.make AND o.model = n.model AND o.trim IS NOT DISTINCT FROM n.trim"


@query(f"""WITH {CTES}, p AS (SELECT n.id, o.id AS was, o.seen, row_number() OVER (PARTITION BY n.id ORDER BY o.seen DESC, o.id DESC) AS k FROM cars n JOIN cars o ON {_SAME} AND o.year = n.year AND o.seller IS NOT DISTINCT FROM n.seller
  WHERE o.status = 'gone' AND n.status = 'active' AND o.seen < n.seen AND o.id <> n.id AND n.km BETWEEN o.km AND o.km + 40000)
SELECT id, was FROM p WHERE k = 1""")
def reappearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An active offer that is a gone one again under a new id: same car and seller, mileage gone on; the latest gone one wins."""
    keys = ["make", "model", "year", "seller"]
    n = cars(spark, sf_dir).filter("status = 'active'").select("id", *keys, "trim", "km", "seen")
    o = cars(spark, sf_dir).filter("status = 'gone'").select(c("id").alias("was"), *keys, c("trim").alias("t"), c("km").alias("k"), c("seen").alias("at"))
    hit = n.join(o, keys).filter(c("trim").eqNullSafe(c("t")) & (c("at") < c("seen")) & (c("was") != c("id")) & c("km").between(c("k"), c("k") + 40000))
    return hit.groupBy("id").agg(F.max_by("was", F.struct("at", "was")).alias("was"))


@query(f"""WITH {CTES}, p AS (SELECT n.id, o.id AS other, o.seller = n.seller AS own, row_number() OVER (PARTITION BY n.id, o.seller = n.seller ORDER BY abs(o.price_usd - n.price_usd), o.id) AS k FROM cars n JOIN cars o ON o.make = n.make AND o.model = n.model AND o.year = n.year
  WHERE n.source = 'directo' AND o.source <> 'directo' AND abs(o.km - n.km) <= 0.1 * n.km AND abs(o.price_usd - n.price_usd) <= 0.05 * n.price_usd)
SELECT id, other, own FROM p WHERE k = 1""")
def stock_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dealer's own stock found again elsewhere, by the same seller or another: near in mileage and price, the nearest price."""
    keys = ["make", "model", "year"]
    n = cars(spark, sf_dir).filter("source = 'directo'").select("id", *keys, "km", "price_usd", "seller")
    o = cars(spark, sf_dir).filter("source <> 'directo'").select(c("id").alias("other"), *keys, c("km").alias("k"), c("price_usd").alias("p"), c("seller").alias("s"))
    hit = n.join(o, keys).filter((F.abs(c("k") - c("km")) <= 0.1 * c("km")) & (F.abs(c("p") - c("price_usd")) <= 0.05 * c("price_usd")))
    return hit.groupBy("id", (c("s") == c("seller")).alias("own")).agg(F.min_by("other", F.struct(F.abs(c("p") - c("price_usd")), "other")).alias("other")).select("id", "other", "own")


_ASKED = ["0001", "supplier#00000000", "9", "%", "zzz"]


@query(f"""WITH q AS (SELECT unnest({_ASKED}) AS asked), h AS (SELECT asked, s_suppkey AS seller, s_name AS name, row_number() OVER (PARTITION BY asked ORDER BY s_name, s_suppkey) AS k FROM q JOIN supplier ON contains(lower(s_name), asked)) SELECT asked, seller, name FROM h WHERE k <= 30""")
def seller_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sellers whose name holds what is typed, as it is: thirty at most for each."""
    asked = F.explode(F.filter(F.array(*map(F.lit, _ASKED)), lambda a: F.contains(F.lower("s_name"), a)))
    hit = table(spark, sf_dir, "supplier").select(asked.alias("asked"), c("s_suppkey").alias("seller"), c("s_name").alias("name"))
    return hit.withColumn("k", F.row_number().over(W.partitionBy("asked").orderBy("name", "seller"))).filter("k <= 30").drop("k")


@query(f"""WITH {CTES}, f AS (SELECT part, source, min(seen) AS first_seen FROM cars GROUP BY part, source), b AS (SELECT source, CAST(date_trunc('month', seen) AS DATE) AS month, count(DISTINCT part) AS found FROM cars GROUP BY ALL), n AS (SELECT source, CAST(date_trunc('month', first_seen) AS DATE) AS month, count(*) AS fresh FROM f GROUP BY ALL),
j AS (SELECT b.source, b.month, found, coalesce(fresh, 0) AS fresh, lag(found) OVER (PARTITION BY b.source ORDER BY b.month) AS before FROM b LEFT JOIN n ON n.source = b.source AND n.month = b.month)
SELECT source, month, found, fresh, CASE WHEN before IS NULL THEN 'first_run' WHEN fresh >= 5 AND 2 * fresh >= before THEN 'step' WHEN fresh > 0 THEN 'news' ELSE 'same' END AS verdict FROM j""")
def news_or_old_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what a read brings is news: not in the first read, nor where half of what was found before is new at once."""
    o = cars(spark, sf_dir)
    month = lambda d: F.to_date(F.date_trunc("month", d)).alias("month")
    found = o.groupBy("source", month("seen")).agg(F.count_distinct("part").alias("found"))
    fresh = o.groupBy("part", "source").agg(F.min("seen").alias("first")).groupBy("source", month("first")).agg(F.count("*").alias("fresh"))
    j = found.join(fresh, ["source", "month"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(0))).withColumn("before", F.lag("found").over(W.partitionBy("source").orderBy("month")))
    verdict = F.when(c("before").isNull(), "first_run").when((c("fresh") >= 5) & (2 * c("fresh") >= c("before")), "step").when(c("fresh") > 0, "news").otherwise("same")
    return j.select("source", "month", "found", "fresh", verdict.alias("verdict"))


_FEES = [("N", 0.010, 0.020, 300.0, 500.0), ("S", 0.015, 0.030, 200.0, 450.0), ("C", 0.0, 0.025, 250.0, 250.0)]
_FEE_ROWS = ", ".join(f"('{a}', {b}, {d}, {e}, {f})" for a, b, d, e, f in _FEES)
_ZONE_OF = "CASE WHEN lat IS NULL THEN NULL WHEN lat > -30 THEN 'N' WHEN lat > -34 THEN 'C' ELSE 'S' END"


@query(f"""WITH {CTES}, fees AS (SELECT * FROM (VALUES {_FEE_ROWS}) AS t(zone, tax_low, tax_high, fee_low, fee_high)), u AS (SELECT min(tax_low) AS tl, max(tax_high) AS th, min(fee_low) AS fl, max(fee_high) AS fh FROM fees),
x AS (SELECT id, price_usd, {_ZONE_OF} AS zone, CASE WHEN seller_type = 'dealer' OR dealer_inferred THEN 'dealer' ELSE seller_type END AS kind FROM cars WHERE price_usd > 0 AND NOT price_partial)
SELECT id, round(price_usd * (1 + coalesce(tax_low, tl)) + coalesce(fee_low, fl) + CASE kind WHEN 'dealer' THEN 150 ELSE 0 END, 6) AS total_low,
  round(price_usd * (1 + coalesce(tax_high, th)) + coalesce(fee_high, fh) + CASE WHEN kind = 'private' THEN 0 ELSE 400 END, 6) AS total_high,
  array_to_string(list_filter([CASE WHEN x.zone IS NULL THEN 'no_zone' END, CASE WHEN kind IS NULL THEN 'no_seller' END], lambda m: m IS NOT NULL), ',') AS missing FROM x LEFT JOIN fees f ON f.zone = x.zone, u""")
def total_cost_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and most that a car costs in all: its zone's tax and fees, or the union of all zones' where it is unknown; so for the seller."""
    fees = spark.createDataFrame(_FEES, "zone string, tax_low double, tax_high double, fee_low double, fee_high double")
    every = fees.agg(F.min("tax_low").alias("tl"), F.max("tax_high").alias("th"), F.min("fee_low").alias("fl"), F.max("fee_high").alias("fh"))
    zone = F.when(c("lat").isNotNull(), F.when(c("lat") > -30, "N").when(c("lat") > -34, "C").otherwise("S"))
    x = cars(spark, sf_dir).filter("price_usd > 0 AND NOT price_partial").select("id", "price_usd", zone.alias("zone"), rules.effective_seller(F.col).alias("kind"))
    x = x.join(F.broadcast(fees), "zone", "left").join(F.broadcast(every))
    low = c("price_usd") * (1 + F.coalesce("tax_low", "tl")) + F.coalesce("fee_low", "fl") + F.when(c("kind") == "dealer", 150).otherwise(0)
    high = c("price_usd") * (1 + F.coalesce("tax_high", "th")) + F.coalesce("fee_high", "fh") + F.when(c("kind") == "private", 0).otherwise(400)
    missing = F.concat_ws(",", F.when(c("zone").isNull(), "no_zone"), F.when(c("kind").isNull(), "no_seller"))
    return x.select("id", F.round(low, 6).alias("total_low"), F.round(high, 6).alias("total_high"), missing.alias("missing"))


@query(f"""WITH {CTES} SELECT id, CASE WHEN seller_type = 'dealer' OR dealer_inferred THEN 'dealer' ELSE seller_type END AS effective, CASE WHEN dealer_inferred AND coalesce(seller_type, '') <> 'dealer' THEN 'inferred' WHEN seller_type IS NOT NULL THEN 'stated' ELSE 'unknown' END AS how FROM cars""")
def effective_seller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who sells: a dealer if the source says so or many offers show it."""
    how = F.when(c("dealer_inferred") & (F.coalesce("seller_type", F.lit("")) != "dealer"), "inferred").when(c("seller_type").isNotNull(), "stated").otherwise("unknown")
    return cars(spark, sf_dir).select("id", rules.effective_seller(F.col).alias("effective"), how.alias("how"))


@query(f"""WITH {CTES}, p AS (SELECT * FROM cars WHERE price_usd > 0 AND NOT price_partial AND year IS NOT NULL AND model IS NOT NULL),
twins AS (SELECT make, model, trim, transmission, count(*) AS n, quantile_cont(price_usd, 0.5) AS m FROM p WHERE trim IS NOT NULL AND transmission IS NOT NULL GROUP BY ALL), wide AS (SELECT make, model, count(*) AS n, quantile_cont(price_usd, 0.5) AS m FROM p GROUP BY ALL), curve AS (SELECT make, year, count(*) AS n, exp(quantile_cont(ln(price_usd), 0.5)) AS m FROM p GROUP BY ALL)
SELECT p.id, CASE WHEN t.n >= 6 THEN 'twins' WHEN k.n >= 40 THEN 'curve' ELSE 'model' END AS basis, round(CASE WHEN t.n >= 6 THEN t.m WHEN k.n >= 40 THEN k.m ELSE w.m END, 4) AS reference
FROM p LEFT JOIN twins t ON t.make = p.make AND t.model = p.model AND t.trim = p.trim AND t.transmission = p.transmission JOIN wide w ON w.make = p.make AND w.model = p.model JOIN curve k ON k.make = p.make AND k.year = p.year""")
def hybrid_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twins keep their own median; the others take an enabled curve's value, else the model's median."""
    p = cars(spark, sf_dir).filter("price_usd > 0 AND NOT price_partial AND year IS NOT NULL AND model IS NOT NULL")
    med = lambda x, a: F.percentile(x, F.lit(0.5)).alias(a)
    t = p.filter("trim IS NOT NULL AND transmission IS NOT NULL").groupBy("make", "model", "trim", "transmission").agg(F.count("*").alias("tn"), med("price_usd", "tm"))
    w = p.groupBy("make", "model").agg(med("price_usd", "wm"))
    k = p.groupBy("make", "year").agg(F.count("*").alias("kn"), F.exp(F.percentile(F.ln("price_usd"), F.lit(0.5))).alias("km_"))
    x = p.join(t, ["make", "model", "trim", "transmission"], "left").join(w, ["make", "model"]).join(k, ["make", "year"])
    pick = lambda a, b, d: F.when(c("tn") >= 6, a).when(c("kn") >= 40, b).otherwise(d)
    return x.select("id", pick(F.lit("twins"), F.lit("curve"), F.lit("model")).alias("basis"), F.round(pick(c("tm"), c("km_"), c("wm")), 4).alias("reference"))


_GUIDES = [("g1", "Brand#1", 1992, 1999), ("g2", "Brand#1", 1994, 1996), ("g3", "Brand#2", 1990, 1995), ("g4", "Brand#2", 1995, 1999), ("g5", "Brand#3", 1997, 1997), ("g6", "Brand#3", 1996, 1998)]
_GUIDE_ROWS = ", ".join(f"('{a}', '{b}', {d}, {e})" for a, b, d, e in _GUIDES)


@query(f"""WITH {CTES}, g AS (SELECT * FROM (VALUES {_GUIDE_ROWS}) AS t(guide, make, y0, y1)), k AS (SELECT id, guide, row_number() OVER (PARTITION BY id ORDER BY y1 - y0, guide) AS k FROM cars JOIN g ON g.make = cars.make AND year BETWEEN y0 AND y1) SELECT id, guide FROM k WHERE k = 1""")
def guide_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the guides that cover an offer's year, the one of the narrowest span."""
    g = F.broadcast(spark.createDataFrame(_GUIDES, "guide string, make string, y0 int, y1 int"))
    return cars(spark, sf_dir).join(g, "make").filter(c("year").between(c("y0"), c("y1"))).groupBy("id").agg(F.min_by("guide", F.struct(c("y1") - c("y0"), "guide")).alias("guide"))


_ASKS = (("owner", "seller_type = 'private'"), ("km", "km IS NULL"), ("papers", "dealer IS NULL"), ("price", "price_partial"), ("belt", "coalesce(year, 1996) < 1996"))


@query(f"WITH {CTES} SELECT id, array_to_string(list_filter([{', '.join(f'CASE WHEN {w} THEN {k!r} END' for k, w in _ASKS)}], lambda q: q IS NOT NULL)[1:3], ',') AS questions FROM cars WHERE status = 'active'")
def seller_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to ask a seller, the first three that apply."""
    asks = F.array_compact(F.array(*[F.when(F.expr(w), k) for k, w in _ASKS]))
    return cars(spark, sf_dir).filter("status = 'active'").select("id", F.array_join(F.slice(asks, 1, 3), ",").alias("questions"))


_TOLD = ["Rosario, Santa Fe", "ROSARIO (centro)", "Córdoba capital", "Consultar", "zona sur", "Funes - Santa Fe", None, "Envíos a todo el país", "Pergamino", "Paraná, Entre Ríos", "rosario santa fe argentina"]
_PLACES = [("rosario", -32.95, -60.66), ("cordoba", -31.42, -64.18), ("parana", -31.73, -60.53)]
_PLACE_ROWS = ", ".join(f"('{a}', {b}, {d})" for a, b, d in _PLACES)
_NOISE = r"(consultar|envios|todo el pais|a convenir)"
_TAIL = r"\s*(,|-|\().*$|\s+(centro|capital|santa fe|argentina)\b.*$"


def place_key(t: Column) -> Column:
    """A place as typed, without what follows its name."""
    return F.trim(F.regexp_replace(T.plain(t), _TAIL, ""))


_PLACE_KEY = f"trim(regexp_replace({_p('told')}, '{_TAIL}', ''))"


@query(f"""WITH t AS (SELECT c_custkey AS id, {_pick('c_custkey', _TOLD)} AS told FROM customer), places AS (SELECT * FROM (VALUES {_PLACE_ROWS}) AS t(place, lat, lon)), denied AS (SELECT * FROM (VALUES ('zona sur', 10), ('pergamino', 200)) AS t(place, age))
SELECT id, {_PLACE_KEY} AS place, CASE WHEN told IS NULL THEN 'none' WHEN regexp_matches({_p('told')}, '{_NOISE}') THEN 'noise' WHEN p.place IS NOT NULL THEN 'known' WHEN d.age <= 90 THEN 'denied' ELSE 'remote' END AS how, p.lat, p.lon
FROM t LEFT JOIN places p ON p.place = {_PLACE_KEY} AND NOT regexp_matches({_p('told')}, '{_NOISE}') LEFT JOIN denied d ON d.place = {_PLACE_KEY}""")
def geocode_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a place is: noise is none; then known places; places once not found aren't asked again for 90 days; the rest is to be asked."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    t = spark.sql(f"SELECT c_custkey AS id, {_pick('c_custkey', _TOLD)} AS told FROM customer").withColumn("place", place_key(c("told"))).withColumn("noise", F.coalesce(T.plain(c("told")).rlike(_NOISE), F.lit(False)))
    known = spark.createDataFrame(_PLACES, "place string, lat double, lon double").withColumn("noise", F.lit(False)).withColumn("hit", F.lit(True))
    denied = spark.createDataFrame([("zona sur", 10), ("pergamino", 200)], "place string, age int")
    j = t.join(F.broadcast(known), ["place", "noise"], "left").join(F.broadcast(denied), "place", "left")
    how = F.when(c("told").isNull(), "none").when(c("noise"), "noise").when(c("hit"), "known").when(c("age") <= 90, "denied").otherwise("remote")
    return j.select("id", "place", how.alias("how"), "lat", "lon")


_KM = "2 * 6371.0 * asin(sqrt(least(pow(sin(radians(lat + 32.95) / 2), 2) + cos(radians(-32.95)) * cos(radians(lat)) * pow(sin(radians(lon + 60.66) / 2), 2), 1.0)))"


@query(f"WITH {CTES} SELECT id, round({_KM}, 1) AS km FROM cars WHERE (lat IS NULL AND source = 'alpha') OR {_KM} <= 300")
def radius_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch within 300 km of a place; one source passes without coordinates, the others drop out."""
    km = haversine_km(F.lit(-32.95), F.lit(-60.66), c("lat"), c("lon"))
    return cars(spark, sf_dir).filter((c("lat").isNull() & (c("source") == "alpha")) | (km <= 300)).select("id", dec(km, 1).alias("km"))


@query(f"WITH {CTES}, stored AS (SELECT id, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 9 = 0 THEN lat + 1 ELSE lat END AS lat, lon, id % 10 > 0 AS there FROM cars) SELECT cars.id, NOT there AS fresh FROM cars JOIN stored s ON s.id = cars.id WHERE NOT there OR s.lat IS DISTINCT FROM cars.lat OR s.lon IS DISTINCT FROM cars.lon")
def zone_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers whose stored zone is missing or stands for other coordinates."""
    o = cars(spark, sf_dir)
    s = o.select("id", F.when(c("id") % 4 == 0, F.lit(None)).when(c("id") % 9 == 0, c("lat") + 1).otherwise(c("lat")).alias("a"), c("lon").alias("b"), (c("id") % 10 > 0).alias("there"))
    return o.join(s, "id").filter(~c("there") | ~c("a").eqNullSafe(c("lat")) | ~c("b").eqNullSafe(c("lon"))).select("id", (~c("there")).alias("fresh"))


_REGIONS = ((1, "lat > -28 AND lon > -62", "noreste"), (2, "lat > -30", "norte"), (3, "lon < -65", "oeste"), (4, "lat IS NOT NULL", "centro"))


@query(f"WITH {CTES} SELECT id, CASE {' '.join(f'WHEN {w} THEN {r!r}' for _, w, r in _REGIONS)} END AS region FROM cars")
def region_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region of the first rule that an offer's place meets."""
    hits = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(F.expr(w), F.lit(False)).alias("hit"), F.lit(r).alias("region")) for k, w, r in _REGIONS]), lambda x: x["hit"])
    return cars(spark, sf_dir).select("id", F.get(hits, F.lit(0))["region"].alias("region"))


@query(f"""WITH {CTES}, q AS (SELECT search, make, year_min, price_max FROM profiles WHERE make IS NOT NULL AND model IS NOT NULL), w AS (SELECT make, min(year_min) AS y, max(price_max) AS p, count(*) FILTER (WHERE year_min IS NULL) AS oy, count(*) FILTER (WHERE price_max IS NULL) AS op FROM q GROUP BY make)
SELECT id FROM cars JOIN w ON w.make = cars.make WHERE (oy > 0 OR year IS NULL OR year >= y) AND (op > 0 OR price_usd IS NULL OR price_usd <= p) AND status = 'active'""")
def source_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a site could not filter, filtered after the read; a missing value passes."""
    q = profiles(spark, sf_dir).filter("make IS NOT NULL AND model IS NOT NULL")
    w = q.groupBy("make").agg(F.min("year_min").alias("y"), F.max("price_max").alias("p"), (F.count_if(c("year_min").isNull()) > 0).alias("oy"), (F.count_if(c("price_max").isNull()) > 0).alias("op"))
    return cars(spark, sf_dir).filter("status = 'active'").join(w, "make").filter((c("oy") | c("year").isNull() | (c("year") >= c("y"))) & (c("op") | c("price_usd").isNull() | (c("price_usd") <= c("p")))).select("id")


@query(f"""WITH {CTES}, m AS (SELECT id, CASE id % 6 WHEN 0 THEN '12.5' WHEN 1 THEN '-300' WHEN 2 THEN 'n/a' WHEN 3 THEN NULL WHEN 4 THEN '1e2' ELSE CAST(id % 50 AS VARCHAR) END AS margin FROM cars)
SELECT id, CASE WHEN TRY_CAST(margin AS DOUBLE) BETWEEN -40 AND 120 THEN TRY_CAST(margin AS DOUBLE) END AS sort_key FROM m""")
def margin_sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored margin as a sort key: only numbers, and only ones that can be."""
    k = c("id") % 6
    text = F.when(k == 0, "12.5").when(k == 1, "-300").when(k == 2, "n/a").when(k == 4, "1e2").when(k == 5, (c("id") % 50).cast("string"))
    number = text.try_cast("double")
    return cars(spark, sf_dir).select("id", F.when(number.between(-40, 120), number).alias("sort_key"))


@query(f"""WITH {CTES}, d AS (SELECT search, CASE WHEN search % 3 = 0 THEN 'VW' ELSE make END AS make, least(year_min, year_max) AS y0, greatest(year_min, year_max) AS y1, CASE WHEN price_max BETWEEN 1000 AND 1000000 THEN price_max END AS price, zone FROM profiles)
SELECT zone, CASE WHEN make = 'VW' THEN 'volkswagen' ELSE lower(make) END AS make, count(*) AS drafts, CASE WHEN count(*) = count(y0) THEN min(y0) END AS year_min, CASE WHEN count(*) = count(y1) THEN max(y1) END AS year_max, round(CASE WHEN count(*) = count(price) THEN max(price) END, 2) AS price_max FROM d WHERE make IS NOT NULL GROUP BY ALL""")
def draft_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts made plain and put together by make: turned ranges set right, prices that can't be dropped, a bound only if all have it."""
    from ..functions.vehicle import brand

    p = profiles(spark, sf_dir)
    d = p.select(brand(F.when(c("search") % 3 == 0, "VW").otherwise(c("make"))).alias("make"), F.least("year_min", "year_max").alias("y0"), F.greatest("year_min", "year_max").alias("y1"), F.when(c("price_max").between(1000, 1000000), c("price_max")).alias("price"), "zone").filter("make IS NOT NULL")
    full = lambda k, a: F.when(F.count("*") == F.count(k), a)
    return d.groupBy("zone", "make").agg(F.count("*").alias("drafts"), full("y0", F.min("y0")).alias("year_min"), full("y1", F.max("y1")).alias("year_max"), F.round(full("price", F.max("price")), 2).alias("price_max"))


@query(f"""WITH {CTES}, d AS (SELECT s_suppkey AS dealer, -25.0 - s_suppkey % 13 AS lat, -58.0 - s_suppkey % 11 AS lon FROM supplier), n AS (SELECT max(seen) AS now FROM cars),
x AS (SELECT d.dealer, c.id, c.price_usd, row_number() OVER (PARTITION BY d.dealer ORDER BY c.price_usd, c.id) AS place FROM d JOIN cars c ON abs(c.lat - d.lat) <= 1 AND abs(c.lon - d.lon) <= 1, n
  WHERE c.status = 'active' AND c.seller_type = 'private' AND NOT c.dealer_inferred AND c.price_usd > 0 AND NOT c.price_partial AND c.seen > now - 60 AND {_KM.replace('lat + 32.95', 'c.lat - d.lat').replace('-32.95', 'd.lat').replace('radians(lat)', 'radians(c.lat)').replace('lon + 60.66', 'c.lon - d.lon')} <= 130)
SELECT dealer, id, place FROM x WHERE place <= 5""")
def buy_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five cheapest private offers near each dealer: places meet by their degree cells and the eight around."""
    o = cars(spark, sf_dir)
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    s = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("d"), (-25.0 - c("s_suppkey") % 13).alias("a"), (-58.0 - c("s_suppkey") % 11).alias("b"))
    cells = s.withColumn("i", near).withColumn("x", F.floor(c("a")) + c("i")).withColumn("j", near).withColumn("y", F.floor(c("b")) + c("j"))
    keep = o.join(newest(o, "seen")).filter("status = 'active' AND seller_type = 'private' AND NOT dealer_inferred AND price_usd > 0 AND NOT price_partial").filter(c("seen") > F.date_sub("now", 60))
    hit = keep.withColumn("x", F.floor("lat")).withColumn("y", F.floor("lon")).join(cells, ["x", "y"]).filter((F.abs(c("lat") - c("a")) <= 1) & (F.abs(c("lon") - c("b")) <= 1) & (haversine_km(c("a"), c("b"), c("lat"), c("lon")) <= 130))
    place = F.row_number().over(W.partitionBy("d").orderBy("price_usd", "id")).cast("long")
    return hit.select(c("d").alias("dealer"), "id", place.alias("place")).filter("place <= 5")
