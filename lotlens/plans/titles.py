"""Vehicles named in titles: phrases, misspellings, the cascade with its confidence, and the normalised listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vehicle as V
from . import normalize as N
from .base import query
from .text import _p

#: A small catalogue: make, model, name or alias, first and last year.
NAMES = [
    ("volkswagen", "gol", "gol", 1990, 2023), ("volkswagen", "gol trend", "gol trend", 2008, 2019), ("volkswagen", "amarok", "amarok", 2010, None), ("toyota", "corolla", "corolla", 1992, None),
    ("toyota", "corolla cross", "corolla cross", 2021, None), ("toyota", "hilux", "hilux", 1979, None), ("peugeot", "208", "208", 2013, None), ("peugeot", "2008", "2008", 2016, None),
    ("citroen", "c4", "c4", 2005, None), ("chevrolet", "onix", "onix", 2013, None), ("fiat", "palio", "palio", 1997, 2018), ("ford", "f-100", "f-100", 1960, 2012), ("ford", "f-100", "f100", 1960, 2012), ("ford", "ka", "ka", 1997, 2021),
]
_VALUES = ", ".join(f"('{a}', '{b}', '{c}', {d}, {e if e else 'NULL'})" for a, b, c, d, e in NAMES)
CATALOG = f"catalog AS (SELECT * FROM (VALUES {_VALUES}) AS t(make, model, name, year_from, year_to))"
BRAND_WORDS = {"vw": "volkswagen", "volks": "volkswagen", "chevy": "chevrolet", "citroen": "citroen"} | {m: m for m in {n[0] for n in NAMES}}
#: How sure each way is, and what a year outside of production takes off.
CONFIDENCE = {"source": 0.95, "title": 0.9, "title_model": 0.8, "fuzzy": 0.65, "target": 0.4, "source_raw": 0.35, "none": 0.0}
OUT_OF_YEARS, CUTOFF = 0.2, 0.88

_SQUEEZE = "trim(regexp_replace({t}, '[^a-z0-9+-]+', ' ', 'g'))"
_SEEN = f"""
seen AS (SELECT id, {_SQUEEZE.format(t=_p('title'))} AS t, CASE WHEN id % 3 = 0 THEN {_SQUEEZE.format(t=_p('model'))} END AS m, year, CASE WHEN id % 2 = 0 THEN 'ford' END AS target_make, CASE WHEN id % 2 = 0 THEN 'ka' END AS target_model FROM ads)
"""
_HAS = "contains(' ' || {t} || ' ', ' ' || {n} || ' ')"
_YEARLIKE = "regexp_matches({n}, '^(19|20)[0-9][0-9]$')"


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    squeeze = lambda c: F.trim(F.regexp_replace(T.plain(F.col(c)), "[^a-z0-9+-]+", " "))
    even = lambda v: F.when(F.col("id") % 2 == 0, v)
    return N.ads(spark, sf_dir).select("id", squeeze("title").alias("t"), F.when(F.col("id") % 3 == 0, squeeze("model")).alias("m"), "year", even("ford").alias("target_make"), even("ka").alias("target_model"))


def catalog(spark: SparkSession) -> DataFrame:
    return spark.sql(f"WITH {CATALOG} SELECT * FROM catalog")


def windows(c: Column, most: int = 3) -> Column:
    """All runs of one to three words."""
    words = F.split(c, " ")

    def of(n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))

    runs = [of(n) for n in range(1, most + 1)]
    return F.array_distinct(F.concat(*runs))


def named(texts: DataFrame, names: DataFrame, text: str) -> DataFrame:
    """(id, make, model, name) of the longest catalogue names in a text: its runs of words meet the names by equality."""
    runs = texts.select("id", F.explode(windows(F.col(text))).alias("name"))
    hits = runs.join(F.broadcast(names), "name")  # the catalogue: one row for each name of a model
    longest = hits.groupBy("id").agg(F.max(F.length("name")).alias("longest"))
    return hits.join(longest, "id").filter(F.length("name") == F.col("longest")).select("id", "make", "model", "name").distinct()


@query(f"""WITH {N.ADS}, {CATALOG}, {_SEEN},
hits AS (SELECT id, make, model, name FROM seen JOIN catalog ON {_HAS.format(t='t', n='name')})
SELECT DISTINCT h.id, make, model, name FROM hits h JOIN (SELECT id, max(length(name)) AS n FROM hits GROUP BY id) l ON l.id = h.id AND length(name) = n""")
def longest_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue names that stand in titles as whole words; the longest wins."""
    return named(seen(spark, sf_dir), catalog(spark), "t")


def _ratio(a: Column, b: Column) -> Column:
    """How alike two words are: twice the kept letters over both lengths, a changed letter counting as one out and one in."""
    gap = F.abs(F.length(a) - F.length(b))
    return 1 - (2 * F.levenshtein(a, b) - gap) / (F.length(a) + F.length(b))


_RATIO = "1 - (2 * levenshtein({a}, {b}) - abs(length({a}) - length({b}))) / (length({a}) + length({b}))"
_RUNS = "SELECT DISTINCT id, array_to_string(list_slice(w, i, i + n - 1), ' ') AS run FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT id, string_split(t, ' ') AS w, unnest([1, 2, 3]) AS n FROM seen))"
_FUZZY = f"""
runs AS ({_RUNS}),
close AS (SELECT id, make, model, name, {_RATIO.format(a='name', b='run')} AS score FROM runs JOIN catalog ON abs(length(run) - length(name)) <= 3 WHERE length(name) >= 4 AND NOT {_YEARLIKE.format(n='name')} AND {_RATIO.format(a='name', b='run')} >= {CUTOFF}),
fuzzy AS (SELECT id, make, model, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, length(name) DESC, make, model) AS k FROM close) WHERE k = 1)
"""


def fuzzy(texts: DataFrame) -> DataFrame:
    """(id, make, model, score): the catalogue name most like a run of the title's words. The names are a fixed list in the plan."""
    known = F.array(*[F.struct(F.lit(a).alias("make"), F.lit(b).alias("model"), F.lit(c).alias("name")) for a, b, c, _, _ in NAMES if len(c) >= 4 and not c.isdigit()])
    runs = texts.select("id", F.explode(windows(F.col("t"))).alias("run"))
    near = runs.select("id", "run", F.explode(F.filter(known, lambda c: F.abs(F.length(c["name"]) - F.length("run")) <= 3)).alias("c")).withColumn("score", _ratio(F.col("c.name"), F.col("run"))).filter(F.col("score") >= CUTOFF)
    best = near.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), (-F.length("c.name")).alias("l"), F.col("c.make").alias("make"), F.col("c.model").alias("model"))).alias("b"))
    return best.select("id", "b.make", "b.model", (-F.col("b.s")).alias("score"))


@query(f"WITH {N.ADS}, {CATALOG}, {_SEEN}, {_FUZZY} SELECT id, make, model, round(score, 4) AS score FROM fuzzy")
def fuzzy_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy(seen(spark, sf_dir)).withColumn("score", F.round("score", 4))


def _single(hits: DataFrame, way: Column) -> DataFrame:
    """Hits of texts whose longest names are all of one model."""
    one = hits.groupBy("id").agg(F.count_distinct("make", "model").alias("n"), F.min("make").alias("make"), F.min("model").alias("model")).filter("n = 1")
    return one.select("id", "make", "model", way.alias("way"))


_BRANDS = "brands AS (SELECT DISTINCT id, make FROM (" + " UNION ALL ".join(f"SELECT id, '{m}' AS make FROM seen WHERE {_HAS.format(t='t', n=repr(w))}" for w, m in sorted(BRAND_WORDS.items())) + "))"
_LONGEST = "SELECT id, min(make) AS make, min(model) AS model FROM (SELECT *, max(length(name)) OVER (PARTITION BY id) AS top FROM {hits}) WHERE length(name) = top GROUP BY id HAVING count(DISTINCT make || '/' || model) = 1"


@query(f"""WITH {N.ADS}, {CATALOG}, {_SEEN}, {_BRANDS}, {_FUZZY},
src AS (SELECT id, make, model, name FROM seen JOIN catalog ON {_HAS.format(t='m', n='name')}),
branded AS (SELECT s.id, c.make, c.model, c.name FROM seen s JOIN brands b ON b.id = s.id JOIN catalog c ON c.make = b.make AND {_HAS.format(t='t', n='name')}),
bare AS (SELECT s.id, c.make, c.model, c.name FROM seen s JOIN catalog c ON {_HAS.format(t='t', n='name')} WHERE s.id NOT IN (SELECT id FROM brands) AND NOT {_YEARLIKE.format(n='name')}),
ways AS (
  SELECT id, make, model, 'source' AS way, 1 AS rank FROM ({_LONGEST.format(hits='src')})
  UNION ALL SELECT id, make, model, 'title', 2 FROM ({_LONGEST.format(hits='branded')})
  UNION ALL SELECT id, make, model, 'title_model', 3 FROM ({_LONGEST.format(hits='bare')})
  UNION ALL SELECT id, make, model, 'fuzzy', 4 FROM fuzzy
  UNION ALL SELECT id, target_make, target_model, 'target', 5 FROM seen WHERE target_model IS NOT NULL
  UNION ALL SELECT id, NULL, m, 'source_raw', 6 FROM seen WHERE m IS NOT NULL
  UNION ALL SELECT id, NULL, NULL, 'none', 7 FROM seen),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank) AS k FROM ways) WHERE k = 1),
years AS (SELECT make, model, min(year_from) AS y0, max(year_to) AS y1 FROM catalog GROUP BY make, model)
SELECT p.id, p.make, p.model, way, round(CASE way {' '.join(f"WHEN '{k}' THEN {v}" for k, v in CONFIDENCE.items())} END - CASE WHEN s.year < y0 OR s.year > y1 THEN {OUT_OF_YEARS} ELSE 0 END, 2) AS confidence
FROM picked p JOIN seen s ON s.id = p.id LEFT JOIN years y ON y.make = p.make AND y.model = p.model""")
def vehicle_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Make and model of each ad by the surest way that settles one model: the source's own, the title with or without its
    brand, a misspelling, the crawl's target, the source's raw value; less sure where the year is outside of production."""
    s, names = seen(spark, sf_dir), catalog(spark).select("make", "model", "name")
    words = spark.createDataFrame(sorted(BRAND_WORDS.items()), "word string, brand string")
    brands = s.select("id", F.explode(windows(F.col("t"), 2)).alias("word")).join(F.broadcast(words), "word").select("id", F.col("brand").alias("make")).distinct()
    runs = s.select("id", F.explode(windows(F.col("t"))).alias("name")).join(F.broadcast(names), "name")
    branded = runs.join(brands, ["id", "make"])
    bare = runs.filter(~F.col("name").rlike("^(19|20)[0-9][0-9]$")).join(brands.select("id").distinct(), "id", "left_anti")

    def longest(hits: DataFrame) -> DataFrame:
        return hits.join(hits.groupBy("id").agg(F.max(F.length("name")).alias("top")), "id").filter(F.length("name") == F.col("top"))

    none = F.lit(None).cast("string")
    ways = [
        _single(named(s.filter("m IS NOT NULL"), names, "m"), F.lit("source")), _single(longest(branded), F.lit("title")), _single(longest(bare), F.lit("title_model")),
        fuzzy(s).select("id", "make", "model", F.lit("fuzzy").alias("way")), s.filter("target_model IS NOT NULL").select("id", F.col("target_make").alias("make"), F.col("target_model").alias("model"), F.lit("target").alias("way")),
        s.filter("m IS NOT NULL").select("id", none.alias("make"), F.col("m").alias("model"), F.lit("source_raw").alias("way")), s.select("id", none.alias("make"), none.alias("model"), F.lit("none").alias("way")),
    ]
    every = ways[0].withColumn("rank", F.lit(1))
    for k, w in enumerate(ways[1:], 2):
        every = every.unionByName(w.withColumn("rank", F.lit(k)))
    picked = every.groupBy("id").agg(F.min_by(F.struct("make", "model", "way"), "rank").alias("p")).select("id", "p.*")
    years = catalog(spark).groupBy("make", "model").agg(F.min("year_from").alias("y0"), F.max("year_to").alias("y1"))
    sure = F.element_at(F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair]), F.col("way"))
    outside = F.coalesce((F.col("year") < F.col("y0")) | (F.col("year") > F.col("y1")), F.lit(False))
    full = picked.join(s.select("id", "year"), "id").join(F.broadcast(years), ["make", "model"], "left")
    return full.select("id", "make", "model", "way", F.round(sure - F.when(outside, OUT_OF_YEARS).otherwise(0.0), 2).alias("confidence"))


@query(f"""WITH {N.ADS}, x AS (SELECT *, {N._CUR} AS read_as, {N._BRAND} AS brand_, array_to_string(list_slice(string_split({_p('model')}, ' '), 1, 2), ' ') AS base_ FROM ads)
SELECT id, brand_ AS brand, base_ AS base_model, coalesce({N._gear('trim')}, {N._gear('title')}, {N._gear('description')}) AS transmission, coalesce({N._chosen(_p('title'), V.FUELS)}, {N._chosen(_p('description'), V.FUELS)}) AS fuel,
  CASE WHEN coalesce(CASE WHEN read_as = 'USD' THEN price BETWEEN 1000 AND 1000000 WHEN read_as = 'ARS' THEN price >= 500000 END, false) THEN round(price, 2) END AS price,
  CASE WHEN coalesce(CASE WHEN read_as = 'USD' THEN price BETWEEN 1000 AND 1000000 WHEN read_as = 'ARS' THEN price >= 500000 END, false) THEN read_as END AS currency,
  regexp_matches({_p('title')}, {N._b(V.PARTIAL)}) OR coalesce(regexp_matches({_p('description')}, {N._b(V.BLANK_TOTAL)}), false) AS price_partial, coalesce(year, CAST(nullif(regexp_extract(title, '(19[89][0-9]|20[0-3][0-9])', 1), '') AS INTEGER)) AS year,
  md5(concat_ws('|', brand_, base_, coalesce(CAST(km AS VARCHAR), ''), coalesce(trim, ''))) AS fingerprint FROM x""")
def normalized_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole ad normalised in one pass: make, model, gearbox, fuel, a price that can be one, year and fingerprint."""
    a = N.ads(spark, sf_dir).withColumn("read_as", V.price_currency(*map(F.col, ("price", "currency", "sign", "make")))).withColumn("brand_", V.brand(F.col("make"))).withColumn("base_", V.base_model(F.col("model")))
    good = V.plausible(F.col("price"), F.col("read_as"))
    t = [F.col(c) for c in ("trim", "title", "description")]
    year = F.coalesce("year", F.nullif(F.regexp_extract("title", "(19[89][0-9]|20[0-3][0-9])", 1), F.lit("")).cast("int"))
    return a.select(
        "id", F.col("brand_").alias("brand"), F.col("base_").alias("base_model"), V.transmission(*t).alias("transmission"), V.fuel(*t[1:]).alias("fuel"), F.when(good, F.round("price", 2)).alias("price"), F.when(good, F.col("read_as")).alias("currency"),
        V.partial_reason(t[1], t[2]).isNotNull().alias("price_partial"), year.alias("year"), F.md5(F.concat_ws("|", "brand_", "base_", F.coalesce(F.col("km").cast("string"), F.lit("")), F.coalesce("trim", F.lit("")))).alias("fingerprint"),
    )
