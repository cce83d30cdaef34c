"""The match rules of saved searches, one query each, the whole evaluation, and what is built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..operators import match_blocks, rules
from ..session import settled
from .base import dec, query, table
from .cars import CTES, DAYS, FRESH, FX, PAIRS, cars, profiles
from .text import _p

_KM = "2 * 6371.0 * asin(sqrt(least(pow(sin(radians(c.lat - {z}.lat) / 2), 2) + cos(radians({z}.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - {z}.lon) / 2), 2), 1.0)))"
_STATE = "CASE WHEN {v} IS NULL THEN 'unknown' WHEN {g} THEN 'ok' ELSE 'fail' END"
_SELLER = "CASE WHEN coalesce(c.seller_type, '') = 'dealer' OR c.dealer_inferred THEN 'dealer' ELSE c.seller_type END"


def _asked(when: str, then: str) -> str:
    return f"CASE WHEN {when} THEN {then} END"


def _state(value: str, good: str) -> str:
    return _STATE.format(v=value, g=good)


def _price_in(currency: str) -> str:
    return f"""CASE WHEN c.price IS NULL OR c.price <= 0 THEN NULL WHEN c.currency IS NULL OR c.currency = {currency} THEN c.price
      WHEN {currency} = 'USD' THEN coalesce(c.price_usd, c.price / {FX}) ELSE c.price * {FX} END"""


_CURRENCY = "coalesce(upper(p.currency), CASE WHEN {a} >= 1000000 THEN 'ARS' ELSE 'USD' END)"
_LOW = "coalesce(p.year_min, list_min(p.year_list))"
_HIGH = "coalesce(p.year_max, list_max(p.year_list))"
_PRICE = _price_in(_CURRENCY.format(a="coalesce(p.price_max, p.price_min)"))
_TARGET = f"CASE WHEN NOT c.price_partial THEN {_price_in(_CURRENCY.format(a='p.price_target'))} END"
_DISTANCE = f"list_min(list_transform(p.zones, lambda z: {_KM.format(z='z')}))"
_WORDS = lambda c: f"string_split(replace({_p(c)}, '!', ''), ' ')"
_NO_VEHICLE = "p.make IS NULL AND p.model IS NULL"

HARD_SQL = {
    "model": f"CASE WHEN {_NO_VEHICLE} THEN CASE WHEN p.body_types IS NULL THEN 'fail' END WHEN (p.make IS NOT NULL AND NOT coalesce({_p('c.make')} = {_p('p.make')}, false)) OR (p.model IS NOT NULL AND NOT coalesce({_p('c.model')} = {_p('p.model')}, false)) THEN 'fail' ELSE 'ok' END",
    "year": _asked(f"{_LOW} IS NOT NULL OR {_HIGH} IS NOT NULL", _state("c.year", f"coalesce(c.year >= {_LOW}, true) AND coalesce(c.year <= {_HIGH}, true) AND coalesce(list_contains(p.year_list, c.year), true)")),
    "price": _asked("p.price_min IS NOT NULL OR p.price_max IS NOT NULL", f"CASE WHEN c.price_partial THEN 'unknown' ELSE {_state(f'({_PRICE})', f'coalesce(({_PRICE}) <= p.price_max, true) AND coalesce(({_PRICE}) >= p.price_min, true)')} END"),
    "km": _asked("p.km_min IS NOT NULL OR p.km_max IS NOT NULL", _state("c.km", "coalesce(c.km <= p.km_max, true) AND coalesce(c.km >= p.km_min, true)")),
    "transmission": _asked("p.transmission IS NOT NULL", _state("c.transmission", f"contains({_p('c.transmission')}, {_p('p.transmission')})")),
    "fuel": _asked("p.fuel IS NOT NULL", _state("c.fuel", f"contains({_p('c.fuel')}, {_p('p.fuel')})")),
    "body_type": _asked("p.body_types IS NOT NULL", f"CASE WHEN c.body_type IS NULL THEN CASE WHEN {_NO_VEHICLE} THEN 'fail' ELSE 'unknown' END WHEN list_contains(string_split(p.body_types, ','), c.body_type) THEN 'ok' ELSE 'fail' END"),
    "color": _asked("p.colors IS NOT NULL", """CASE WHEN coalesce(list_contains(string_split(p.colors, ','), c.color), false) THEN 'ok'
      WHEN c.color IS NULL OR coalesce(len(list_filter(string_split(c.maybe_colors, ','), lambda m: CAST(split_part(m, ':', 2) AS INTEGER) >= 30 AND list_contains(string_split(p.colors, ','), split_part(m, ':', 1)))), 0) > 0 THEN 'unknown' ELSE 'fail' END"""),
    "location": _asked("len(p.zones) > 0", f"CASE WHEN c.lat IS NOT NULL AND len(list_filter(p.zones, lambda z: {_KM.format(z='z')} <= z.radius)) > 0 THEN 'ok' ELSE 'fail' END"),
    "source": _asked("p.sources IS NOT NULL", "CASE WHEN list_contains(string_split(p.sources, ','), c.source) THEN 'ok' ELSE 'fail' END"),
    "seller": f"CASE WHEN c.dealer IS NOT NULL AND coalesce(p.seller_types = 'private', false) THEN 'fail' WHEN p.seller_types IS NOT NULL AND p.seller_filter THEN {_state(_SELLER, f'''list_contains(string_split(p.seller_types, ','), {_SELLER})''')} END",
    "trim": _asked("p.trims IS NOT NULL", _state("c.trim", f"len(list_filter(string_split(p.trims, '|'), lambda w: list_has_all({_WORDS('c.trim')}, {_WORDS('w')}))) > 0")),
}
SOFT_SQL = {
    "km_target": _asked("p.km_target IS NOT NULL", _state("c.km", "c.km <= p.km_target")),
    "price_target": _asked("p.price_target IS NOT NULL", _state(f"({_TARGET})", f"({_TARGET}) <= p.price_target")),
    "seller_type": _asked("NOT p.seller_filter AND p.seller_types IS NOT NULL", _state(_SELLER, f"{_SELLER} = split_part(p.seller_types, ',', 1)")),
    "max_distance": _asked("p.max_distance IS NOT NULL", _state(f"({_DISTANCE})", f"({_DISTANCE}) <= p.max_distance")),
}

_EVALUATED = f"""
WITH {CTES}, {FRESH}, {PAIRS},
wide AS (
  SELECT *, list_transform(string_split(years, ','), lambda y: CAST(y AS INTEGER)) AS year_list,
    list_concat(CASE WHEN radius IS NOT NULL THEN [{{'lat': CAST(lat AS DOUBLE), 'lon': CAST(lon AS DOUBLE), 'radius': CAST(radius AS DOUBLE)}}] ELSE [] END,
      CASE WHEN extra_zones IS NOT NULL THEN list_transform(string_split(extra_zones, '|'), lambda z: {{'lat': CAST(split_part(z, ';', 1) AS DOUBLE), 'lon': CAST(split_part(z, ';', 2) AS DOUBLE), 'radius': CAST(split_part(z, ';', 3) AS DOUBLE)}}) ELSE [] END) AS zones
  FROM profiles),
evaluated AS (
  SELECT k.search, k.id, {', '.join(f'{e} AS r_{k}' for k, e in (HARD_SQL | SOFT_SQL).items())}
  FROM pairs k JOIN wide p ON p.search = k.search JOIN fresh c ON c.id = k.id)
"""


def sides(spark: SparkSession, sf_dir: str, asking: str = "true", offered: str = "true") -> tuple[DataFrame, DataFrame]:
    """The searches, and the fresh offers with what rules and results read of them, worked out once; `age` is an offer's in days."""
    offers = cars(spark, sf_dir).drop("discount", "tax", "part", "seller")
    now = offers.agg(F.max("seen").alias("now"))
    fresh = offers.join(F.broadcast(now), F.col("seen") > F.date_sub("now", DAYS)).withColumn("age", F.datediff("now", "seen")).drop("now")
    return settled(profiles(spark, sf_dir).filter(asking)), settled(fresh.filter(offered))


def evaluated(searches: DataFrame, offers: DataFrame) -> DataFrame:
    """(s, o, r_<rule>) of the offers of the model that a search names: every rule's state, also of those that fail."""
    s, o = (lambda k: F.col(f"s.{k}")), (lambda k: F.col(f"o.{k}"))
    states = rules.hard(s, o, FX) | rules.soft(s, o, FX)
    return rules.by_model(searches, offers).select("s", "o", *[e.alias(f"r_{k}") for k, e in states.items()])


def _rule(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return match_blocks.states(*sides(spark, sf_dir), FX, name)

    run.__doc__ = f"The state of the rule {name} of every search that asks it, for each offer that it meets."
    return run


for _name in [*HARD_SQL, *SOFT_SQL]:
    query(f"{_EVALUATED} SELECT search, id, r_{_name} AS result FROM evaluated WHERE r_{_name} IS NOT NULL", name=f"rule_{_name}")(_rule(_name))


def _count(state: str, names: list[str]) -> Column:
    return sum((F.coalesce(F.col(f"r_{k}") == state, F.lit(False)).cast("long") for k in names), F.lit(0).cast("long"))


def _count_sql(state: str, names: list[str]) -> str:
    return "CAST(len(list_filter([" + ", ".join(f"r_{k}" for k in names) + f"], lambda x: x = '{state}')) AS BIGINT)"


_H, _S = list(HARD_SQL), list(SOFT_SQL)
_COUNTED = f"{_EVALUATED}, counted AS (SELECT *, {_count_sql('fail', _H)} AS fails, {_count_sql('unknown', _H)} AS unknowns, {_count_sql('ok', _H)} AS oks, {_count_sql('ok', _S)} AS soft_ok, {_count_sql('fail', _S)} AS soft_fail FROM evaluated)"


def counted(searches: DataFrame, offers: DataFrame) -> DataFrame:
    return evaluated(searches, offers).select("*", _count("fail", _H).alias("fails"), _count("unknown", _H).alias("unknowns"), _count("ok", _H).alias("oks"), _count("ok", _S).alias("soft_ok"), _count("fail", _S).alias("soft_fail"))


def totals(searches: DataFrame, offers: DataFrame, by_rule: bool = False) -> DataFrame:
    """Of each search that meets an offer: n, n_match, n_sure (nothing unknown), and by rule fail_ and only_, what it takes out alone."""
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("fails") == 0).alias("n_match"), F.count_if((F.col("fails") == 0) & (F.col("unknowns") == 0)).alias("n_sure")]
    for k in _H if by_rule else []:
        aggs += [F.count_if(F.col(f"r_{k}") == "fail").alias(f"fail_{k}"), F.count_if((F.col(f"r_{k}") == "fail") & (F.col("fails") == 1)).alias(f"only_{k}")]
    named = counted(searches, offers).groupBy("s.search").agg(*aggs)
    parts = named.unionByName(match_blocks.sums(searches, offers, FX, by_rule))
    return parts.groupBy("search").agg(*[F.sum(k).alias(k) for k in parts.columns if k != "search"])


def _missing() -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(F.col(f"r_{k}") == "unknown", k) for k in _H])), ",")


def pairs(searches: DataFrame, offers: DataFrame, keep: str) -> DataFrame:
    """(search, id, fails, oks, unknowns, soft_ok, soft_fail, missing) of the pairs that `match_blocks.pairs` keeps, and of those by model."""
    named = counted(searches, offers).filter({"match": "fails = 0", "ok2": "oks >= 2"}[keep])
    return named.select("s.search", "o.id", "fails", "oks", "unknowns", "soft_ok", "soft_fail", _missing().alias("missing")).unionByName(match_blocks.pairs(searches, offers, FX, keep))


@query(f"{_COUNTED} SELECT search, id, oks, unknowns, soft_ok, soft_fail, array_to_string(list_filter([{', '.join(f'''CASE WHEN r_{k} = 'unknown' THEN '{k}' END''' for k in _H)}], lambda x: x IS NOT NULL), ',') AS missing FROM counted WHERE fails = 0")
def match_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches under all hard rules, with what is unknown and how the preferences fare."""
    return pairs(*sides(spark, sf_dir), "match").drop("fails")


@query(f"""{_COUNTED}
SELECT search, count(*) AS n, count(*) FILTER (WHERE fails = 0) AS n_match, {', '.join(f"count(*) FILTER (WHERE r_{k} = 'fail') AS fail_{k}, count(*) FILTER (WHERE r_{k} = 'fail' AND fails = 1) AS only_{k}" for k in _H)} FROM counted GROUP BY search""")
def diagnosis_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each search: how many offers each rule takes out, and how many it takes out alone."""
    return totals(*sides(spark, sf_dir), by_rule=True).drop("n_sure")


_ORDER = ["location", "price", "trim", "year", *[k for k in _H if k not in ("location", "price", "trim", "year")]]


@query(f"""{_COUNTED},
alone AS (SELECT search, rule, count(*) AS gain FROM (SELECT search, CASE {' '.join(f"WHEN r_{k} = 'fail' THEN '{k}'" for k in _H)} END AS rule FROM counted WHERE fails = 1) GROUP BY search, rule)
SELECT search, rule AS blocker, gain FROM (SELECT *, row_number() OVER (PARTITION BY search ORDER BY gain DESC, list_position({_ORDER}, rule)) AS k FROM alone) WHERE k = 1""")
def main_blocker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that alone keeps most offers from a search; ties by zone, price, version, year, then the others."""
    gains = F.array(*[F.struct(F.col(f"only_{k}").alias("gain"), F.lit(-i).alias("p"), F.lit(k).alias("rule")) for i, k in enumerate(_ORDER)])
    best = totals(*sides(spark, sf_dir), by_rule=True).select("search", F.array_max(gains).alias("b"))
    return best.filter("b.gain > 0").select("search", F.col("b.rule").alias("blocker"), "b.gain")


_KNOWN = "sedan hatchback suv pickup rural monovolumen coupe convertible utilitario".split()  # fixed values


@query(f"""
WITH {CTES}
SELECT search, CASE WHEN make IS NOT NULL OR model IS NOT NULL THEN NULL WHEN search % 3 = 2 THEN 'plan_feature_unavailable'
  WHEN body_types IS NULL OR NOT list_has_all({_KNOWN}, string_split(body_types, ',')) THEN 'search_needs_model_or_body_type' WHEN coalesce(price_max, 0) <= 0 THEN 'search_needs_max_price' END AS problem FROM profiles""")
def search_filter_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a search can't be saved, the first reason that holds: only searches without a vehicle have rules. Plans of every third account lack them."""
    p = profiles(spark, sf_dir)
    asks = F.col("make").isNotNull() | F.col("model").isNotNull()
    unknown = F.col("body_types").isNull() | (F.size(F.array_except(F.split("body_types", ","), F.array(*map(F.lit, _KNOWN)))) > 0)
    problem = F.when(asks, F.lit(None).cast("string")).when(F.col("search") % 3 == 2, "plan_feature_unavailable").when(unknown, "search_needs_model_or_body_type").when(F.coalesce("price_max", F.lit(0)) <= 0, "search_needs_max_price")
    return p.select("search", problem.alias("problem"))


@query(f"""
WITH {CTES}, want AS (SELECT b AS body_type, max(price_max) * 1.05 AS ceiling, min(year_min) - 1 AS floor, max(km_max) AS km_max, count(*) FILTER (WHERE price_max IS NULL) AS open_price, count(*) FILTER (WHERE year_min IS NULL) AS open_year, count(*) FILTER (WHERE km_max IS NULL) AS open_km
  FROM (SELECT *, unnest(string_split(body_types, ',')) AS b FROM profiles) GROUP BY b)
SELECT c.id, c.body_type FROM cars c JOIN want w ON c.body_type = w.body_type
WHERE (open_year > 0 OR c.year IS NULL OR c.year >= floor) AND (open_km > 0 OR c.km IS NULL OR c.km <= w.km_max) AND (open_price > 0 OR c.price_usd IS NULL OR c.price_partial OR c.price_usd <= ceiling)""")
def body_type_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers worth keeping for the searches of a body type: under the highest bounds with a margin; the unknown passes."""
    p = profiles(spark, sf_dir).withColumn("b", F.explode(F.split("body_types", ",")))
    open_ = lambda c: F.count_if(F.col(c).isNull()) > 0
    want = p.groupBy(F.col("b").alias("body_type")).agg((F.max("price_max") * 1.05).alias("ceiling"), (F.min("year_min") - 1).alias("floor"), F.max("km_max").alias("most"), open_("price_max").alias("op"), open_("year_min").alias("oy"), open_("km_max").alias("ok"))
    keep = (F.col("oy") | F.col("year").isNull() | (F.col("year") >= F.col("floor"))) & (F.col("ok") | F.col("km").isNull() | (F.col("km") <= F.col("most")))
    keep &= F.col("op") | F.col("price_usd").isNull() | F.col("price_partial") | (F.col("price_usd") <= F.col("ceiling"))
    return cars(spark, sf_dir).join(F.broadcast(want), "body_type").filter(keep).select("id", "body_type")  # a row for each body type


@query(f"""
WITH {CTES}, d AS (SELECT s_suppkey AS dealer, s_acctbal > 0 AS approved FROM supplier), n AS (SELECT max(seen) AS now FROM cars)
SELECT c.id, CASE WHEN c.dealer IS NULL AND source <> 'directo' THEN NULL WHEN source <> 'directo' THEN CASE WHEN dealer_status IN ('reserved', 'sold') THEN 'not_available' END
  WHEN c.dealer IS NULL THEN 'no_dealer' WHEN NOT coalesce(approved, false) THEN 'not_approved' WHEN dealer_status IS DISTINCT FROM 'available' THEN 'not_available' WHEN seen < now - 30 THEN 'unconfirmed' END AS hidden
FROM cars c LEFT JOIN d ON c.dealer = d.dealer, n""")
def dealer_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an offer isn't shown, in order: no dealer, not approved, not available, not confirmed in 30 days; null if it is."""
    offers = cars(spark, sf_dir)
    now = F.broadcast(offers.agg(F.max("seen").alias("now")))
    dealers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("dealer"), (F.col("s_acctbal") > 0).alias("approved"))
    own, none = F.col("source") == "directo", F.lit(None).cast("string")
    hidden = F.when(~own, F.when(F.col("dealer").isNotNull() & F.col("dealer_status").isin("reserved", "sold"), "not_available").otherwise(none)).when(F.col("dealer").isNull(), "no_dealer")
    hidden = hidden.when(~F.coalesce("approved", F.lit(False)), "not_approved").when(~F.col("dealer_status").eqNullSafe("available"), "not_available").when(F.col("seen") < F.date_sub("now", 30), "unconfirmed")
    return offers.join(dealers, "dealer", "left").join(now).select("id", hidden.alias("hidden"))


#: What the list of results shows and how it is ordered; fixed values.
TABS = {"new": "unknowns = 0", "unsure": "unknowns > 0", "all": "true"}
SORTS = {"price": ("price_usd", False), "km": ("km", False), "recent": ("seen", True), "year": ("year", True)}


def results_page(spark: SparkSession, sf_dir: str, tab: str = "all", sort: str = "price", page: int = 0, size: int = 5) -> DataFrame:
    """A page of each search's matches: a tab's filter, an order with nulls last, ties by id."""
    column, down = SORTS[sort]
    searches, offers = sides(spark, sf_dir)
    value = F.unix_date(column) if column == "seen" else F.col(column)
    order = (-value if down else value).cast("double")
    top = (page + 1) * size
    near = match_blocks.first(searches, offers, FX, tab, order, top)  # of each block, so the shuffle has no more than these
    named = counted(searches, offers).filter("fails = 0").filter(TABS[tab]).select("s.search", "o.id")
    place = F.row_number().over(W.partitionBy("search").orderBy(F.col("order").asc_nulls_last(), "id"))
    shown = named.unionByName(near).join(offers.select("id", order.alias("order")), "id").withColumn("place", place)
    return shown.filter((F.col("place") > page * size) & (F.col("place") <= top)).select("search", "id", F.col("place").cast("long").alias("place"))


def _page_sql(tab: str, sort: str, page: int, size: int = 5) -> str:
    column, down = SORTS[sort]
    return f"""{_COUNTED} SELECT search, id, place FROM (SELECT k.search, k.id, row_number() OVER (PARTITION BY k.search ORDER BY c.{column} {'DESC' if down else 'ASC'} NULLS LAST, k.id) AS place
      FROM counted k JOIN fresh c ON c.id = k.id WHERE fails = 0 AND {TABS[tab]}) WHERE place > {page * size} AND place <= {(page + 1) * size}"""


for _tab, _sort, _page in (("all", "price", 0), ("new", "recent", 0), ("unsure", "km", 1)):
    query(_page_sql(_tab, _sort, _page), name=f"results_{_tab}_by_{_sort}")(lambda spark, sf_dir, a=_tab, b=_sort, c=_page: results_page(spark, sf_dir, a, b, c))


@query(f"""{_COUNTED}, plans AS (SELECT DISTINCT segment, segment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AS active, CASE segment WHEN 'BUILDING' THEN 50 WHEN 'MACHINERY' THEN 3 ELSE 1 END AS cap FROM profiles)
SELECT k.search, p.segment, active, count(*) AS n, CASE WHEN active THEN least(count(*), cap) ELSE 0 END AS visible, count(*) - CASE WHEN active THEN least(count(*), cap) ELSE 0 END AS hidden
FROM counted k JOIN profiles p ON p.search = k.search JOIN plans l ON l.segment = p.segment WHERE fails = 0 GROUP BY k.search, p.segment, active, cap""")
def access_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a search's matches its plan shows: none once it has ended, else up to the plan's cap."""
    active = F.col("segment").isin("BUILDING", "MACHINERY", "AUTOMOBILE")
    cap = F.when(F.col("segment") == "BUILDING", 50).when(F.col("segment") == "MACHINERY", 3).otherwise(1)
    searches, offers = sides(spark, sf_dir)
    n = totals(searches, offers).filter("n_match > 0").select("search", F.col("n_match").alias("n")).join(searches.select("search", "segment"), "search")
    shown = F.when(active, F.least("n", cap.cast("long"))).otherwise(0).cast("long")
    return n.select("search", "segment", active.alias("active"), "n", shown.alias("visible"), (F.col("n") - shown).alias("hidden"))


@query(f"{_COUNTED} SELECT search, count(*) AS n, round(min(({_DISTANCE})), 1) AS nearest_km FROM counted k JOIN wide p USING (search) JOIN fresh c ON c.id = k.id WHERE r_location IS NOT NULL GROUP BY search")
def zone_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near the nearest offer of a search with zones is, to a tenth of a km."""
    searches, offers = sides(spark, sf_dir)
    s = searches.select(F.explode(match_blocks.wanted()).alias("kind"), "search", rules.zones(F.col).alias("zones")).filter(F.size("zones") > 0)
    spots = offers.select(F.explode(match_blocks.offered()).alias("kind"), "lat", "lon").groupBy("kind", "lat", "lon").agg(F.count(F.lit(1)).alias("n"))
    far = F.array_min(F.transform("zones", lambda z: haversine_km(z["lat"], z["lon"], F.col("lat"), F.col("lon"))))
    asked = ["kind", "zones"]
    met = s.select(*asked).distinct().join(spots, "kind").groupBy(*asked).agg(F.sum("n").alias("n"), F.min(far).alias("km"))  # zones by places, not pairs
    return s.join(met, asked).groupBy("search").agg(F.sum("n").alias("n"), dec(F.min("km"), 1).alias("nearest_km"))
