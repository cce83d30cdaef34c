"""What an ad's words say: queries over ads made from all parts, each with its twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vehicle as V
from .base import query, table
from .text import _p


def _pick(key: str, words: list[str | None]) -> str:
    rows = " ".join(f"WHEN {i} THEN " + ("NULL" if w is None else "'" + w.replace("'", "''") + "'") for i, w in enumerate(words))
    return f"CASE ({key}) % {len(words)} {rows} END"


_K = "p_partkey"
_FIRST = ["Vendo", "Busco", "2012", "Paragolpe delantero de", "Volkswagen", "VW", "Repuestos para", "Permuto", "Auto a control remoto", "Kit de embrague", "Oportunidad", "2008 Busco", "Desarme", "Compro, vendo", "Puerta", "No es desarme:"]
_MODEL = ["Gol Trend", "Toyota Corola", "Corolla Cross XEI", "Peugeot 208 Allure", "Citroën C4 Picasso", "Hilux SRX", "Amarok", "Chevy Onix Plus", "Fiat Palio Weekend", "F-100", "Mercedes Benz GLC", "land-rover Defender", "Ford Ka"]
_MORE = ["1.6 Manual 5p", "Automática CVT nafta", "caja mecanica TDI", "Tiptronic y manual", "hatchback 3 puertas", "sedán 5 puertas", "Coupé", "pick up 4x4", "120.000 km", "chocado", "nunca chocado", "no es chocado", "color blanco", "anticipo y 48 cuotas", "plan de ahorro", "escala 1:24", "GNC", "híbrido", "SUV coupé", "0km", "granizado, sin siniestrados"]
_TELL = [
    "Único dueño, papeles al día.", "Interior color negro, pintura roja", "Color exterior es gris. Llantas negras", "Financiamos. Tomamos tu usado", "no financiamos", "Solo con DNI y cuotas fijas en pesos", "Somos agencia, horario de atención",
    "LLEVATE este Polo (2024) por . Solo $6.000.000", "color azul, techo color negro", None, "VTV y titular", "Crédito prendario, consignación", "Service oficial; color: verde. Pintura blanca", "", "Vehículo a nombre, km reales, pintura en bordó",
]
_SELLER = ["Autos S. A.", "Autos SA", "0341 15 555-1234", "+54 9 341 555-1234", "Particular", "J. R. Motors S.R.L.", "AB", None, "Dueño Directo", "★ Juan Pérez ★", "4444-5555", "12345", "O'Brien", "0054 11 4444 5555", "x y zeta"]
_VALUE = ["Hatch", "Off-Road", "Camioneta", None, "Station Wagon", "sedan", "Furgón", "desconocido", "PICK UP"]
_ALLOWED = [None, "hatchback,sedan", "suv", "sedan,hatchback,rural", "pickup"]
_LABEL = ["Particular", "Concesionaria oficial", "vendedor profesional", None, "Agencia", "dueño directo", "?", "Tienda Oficial"]
_COLOR = ["Blanco Oxford", "Plata Sirius", "Metalizado Gris", "Azul Mónaco", None, "Bordó", "Summit White", "12", "Champagne", "verde oliva", "Perla Nera"]
ADS = f"""
ads AS (
  SELECT {_K} AS id, {_pick(_K, _FIRST)} || ' ' || {_pick(_K, _MODEL)} || ' ' || {_pick(_K, _MORE)} AS title, {_pick(_K, _TELL)} AS description, {_pick(_K, _SELLER)} AS seller, {_pick(_K, _VALUE)} AS body_value,
    {_pick(_K, _ALLOWED)} AS allowed, {_pick(_K, _LABEL)} AS label, {_pick(_K, _COLOR)} AS color_value, {_pick(_K, ["SE Plus", "Sportback", None, "Cabrio", "5p", "weekend"])} AS trim,
    {_pick(_K, ["VW", "Peugeut", "BMW", "Alfa", "Great  Wall", None, "Citroën", "Toyota"])} AS make, {_pick(_K, _MODEL)} AS model,
    CASE WHEN {_K} % 6 = 0 THEN 2012 END AS year, CASE WHEN {_K} % 4 = 0 THEN 90000 END AS km,
    CASE {_K} % 6 WHEN 0 THEN p_retailprice * 1000 WHEN 1 THEN p_retailprice * 100 WHEN 2 THEN p_retailprice * 10 WHEN 3 THEN p_retailprice WHEN 4 THEN p_retailprice / 10 ELSE NULL END AS price,
    {_pick(_K, ["USD", "USD", "ARS", None, "USD", "EUR"])} AS currency, {_pick(_K, ["$", "US$", None, "u$s", "$"])} AS sign, p_brand AS brand, p_type AS kind
  FROM part)
"""


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(f"WITH {ADS} SELECT * FROM ads")


def _b(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _chosen(text: str, kinds: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {_b(p)}) THEN '{k}'" for k, p in kinds.items()) + " END"


def _map(text: str, pairs: dict[str, str]) -> str:
    return "CASE " + text + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


@query(f"WITH {ADS} SELECT id, coalesce({_map(_p('make'), V.BRAND_ALIAS)}, {_p('make')}) AS brand, array_to_string(list_slice(string_split({_p('model')}, ' '), 1, 2), ' ') AS base_model FROM ads")
def brand_and_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands under one spelling, models by their first two words."""
    return ads(spark, sf_dir).select("id", V.brand(F.col("make")).alias("brand"), V.base_model(F.col("model")).alias("base_model"))


def _gear(t: str) -> str:
    m, a = f"regexp_matches({_p(t)}, {_b(V.MANUAL)})", f"regexp_matches({_p(t)}, {_b(V.AUTOMATIC)})"
    return f"CASE WHEN {m} <> {a} THEN CASE WHEN {m} THEN 'manual' ELSE 'automatic' END END"


_SELLER_WORDS = "CASE " + " ".join(f"WHEN regexp_matches({_p('label')}, '{chr(92)}b{w}{chr(92)}b') THEN '{k}'" for w, k in V.SELLERS.items()) + " END"


@query(f"""WITH {ADS} SELECT id, coalesce({_gear('trim')}, {_gear('title')}, {_gear('description')}) AS transmission, coalesce({_chosen(_p('title'), V.FUELS)}, {_chosen(_p('description'), V.FUELS)}) AS fuel,
  coalesce({_map(_p('label'), V.SELLERS)}, {_SELLER_WORDS}) AS seller_type FROM ads""")
def gearbox_fuel_seller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each from the first text that settles it."""
    t = [F.col(c) for c in ("trim", "title", "description")]
    return ads(spark, sf_dir).select("id", V.transmission(*t).alias("transmission"), V.fuel(*t[1:]).alias("fuel"), V.seller_type(F.col("label")).alias("seller_type"))


_DOORS = lambda t: f"CAST(nullif(regexp_extract({_p(t)}, '{chr(92)}b([345]) ?(p|ptas?|pts|puertas){chr(92)}b', 1), '') AS INTEGER)"


def _body_words(t: str) -> str:
    hit = _chosen(_p(t), V.BODY_WORDS)
    return f"CASE WHEN {hit} = 'suv coupe' THEN 'suv' WHEN {hit} = 'sedan' AND coalesce({_DOORS(t)} IN (3, 5), false) THEN CASE WHEN regexp_matches({_p(t)}, {_b(V.BODY_WORDS['hatchback'])}) THEN 'hatchback' END ELSE {hit} END"


@query(f"""WITH {ADS}, x AS (
  SELECT id, coalesce({_body_words('trim')}, {_body_words('title')}) AS words, {_map(f"trim(regexp_replace({_p('body_value')}, '[{chr(92)}s_/-]+', ' ', 'g'))", {c: c for c in V.BODY_CODES} | V.BODY_SOURCE)} AS stated,
    string_split(allowed, ',') AS allowed, coalesce(len(string_split(allowed, ',')), 0) AS known, coalesce({_DOORS('trim')}, {_DOORS('title')}) AS n FROM ads),
y AS (SELECT *, stated IS NOT NULL AND (known = 0 OR coalesce(list_contains(allowed, stated), false)) AS fits, CASE WHEN n IN (3, 5) THEN 'hatchback' WHEN n = 4 THEN 'sedan' END AS by_doors FROM x),
z AS (SELECT *, known > 1 AND coalesce(list_contains(allowed, by_doors), false) AS doors_fit FROM y)
SELECT id, CASE WHEN words IS NOT NULL THEN words WHEN fits THEN stated WHEN doors_fit THEN by_doors WHEN known = 1 THEN allowed[1] END AS body_type,
  CASE WHEN words IS NOT NULL THEN 'keyword' WHEN fits THEN 'source' WHEN doors_fit THEN 'doors' WHEN known = 1 THEN 'catalog' ELSE 'none' END AS method FROM z""")
def body_type_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, the source's value, doors, the catalogue: the first that settles the body, and which it was."""
    code, method = V.body_type(F.col("trim"), F.col("title"), F.col("body_value"), F.split("allowed", ","))
    return ads(spark, sf_dir).select("id", code.alias("body_type"), method.alias("method"))


def _color_sql(w: str) -> str:
    return "CASE " + " ".join(f"WHEN {w} IN ({', '.join(repr(x) for x in words.split())}) THEN '{code}'" for code, words in V.COLOR_WORDS.items()) + " END"


_W = lambda t: f"string_split(trim(regexp_replace({_p(t)}, '[^a-z]+', ' ', 'g')), ' ')"
_ELSE = ", ".join(repr(w) for w in V.COLOR_ELSEWHERE)


@query(f"""WITH {ADS}, w AS (SELECT id, {_W('color_value')} AS v, {_W('description')} AS d FROM ads),
anchors AS (
  SELECT id, CASE WHEN d[i + 1] = 'exterior' THEN CASE WHEN coalesce(d[i + 2], '') IN ('es', 'en') THEN d[i + 3] ELSE d[i + 2] END WHEN coalesce(d[i + 1], '') IN ('es', 'en') THEN d[i + 2] ELSE d[i + 1] END AS word
  FROM (SELECT id, d, unnest(range(1, len(d) + 1)) AS i FROM w)
  WHERE d[i] IN ('color', 'pintura') AND (i < 2 OR d[i - 1] NOT IN ({_ELSE})) AND (i < 3 OR d[i - 2] NOT IN ({_ELSE})) AND (i < 4 OR d[i - 3] NOT IN ({_ELSE}))),
written AS (SELECT id, min({_color_sql('word')}) AS code FROM anchors GROUP BY id HAVING count(DISTINCT {_color_sql('word')}) = 1)
SELECT w.id, list_filter(list_transform(v, lambda x: {_color_sql('x')}), lambda c: c IS NOT NULL)[1] AS stated, t.code AS written,
  coalesce(list_filter(list_transform(v, lambda x: {_color_sql('x')}), lambda c: c IS NOT NULL)[1], t.code) AS color FROM w LEFT JOIN written t ON t.id = w.id""")
def color_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source's colour, else one that the text states of the paint."""
    stated, written = V.color_stated(F.col("color_value")), V.color_written(F.col("description"))
    return ads(spark, sf_dir).select("id", stated.alias("stated"), written.alias("written"), F.coalesce(stated, written).alias("color"))


@query(f"""WITH {ADS} SELECT id, coalesce('keyword: ' || trim(nullif(regexp_extract({_p('title')}, {_b('(' + V.PARTIAL + ')')}, 1), '')), CASE WHEN regexp_matches({_p('description')}, {_b(V.BLANK_TOTAL)}) THEN 'keyword: precio total en blanco' END) AS reason FROM ads""")
def partial_price_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Down payments, instalments and plans by the title's words, or a total left blank."""
    return ads(spark, sf_dir).select("id", V.partial_reason(F.col("title"), F.col("description")).alias("reason"))


@query(f"""WITH {ADS}, m AS (SELECT kind, quantile_cont(price, 0.5) AS median FROM ads WHERE price > 0 GROUP BY kind)
SELECT id, CASE WHEN (1 - price / median) * 100 >= 65 THEN 'partial' WHEN (1 - price / median) * 100 >= 50 THEN 'suspicious' END AS verdict FROM ads JOIN m ON ads.kind = m.kind WHERE price > 0""")
def partial_price_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices 65 % under the median are no totals; from 50 % on they are doubtful."""
    a = ads(spark, sf_dir).filter("price > 0")
    m = a.groupBy("kind").agg(F.percentile("price", F.lit(0.5)).alias("median"))
    off = (1 - F.col("price") / F.col("median")) * 100
    return a.join(m, "kind").select("id", F.when(off >= 65, "partial").when(off >= 50, "suspicious").alias("verdict"))


_T = f"trim(regexp_replace(regexp_replace({_p('title')}, '[^{chr(92)}w{chr(92)}s,./:-]', ' ', 'g'), '{chr(92)}s+', ' ', 'g'))"


@query(f"""WITH {ADS}, x AS (SELECT id, year IS NOT NULL AND km IS NOT NULL AS known, {_T} AS t, concat_ws(' ', {_T}, {_p('description')}) AS both_, trim(regexp_replace({_T}, {_b(V.NOT_PART)}, ' ', 'g')) AS p FROM ads)
SELECT id, CASE WHEN regexp_matches(t, {_b(V.WANTED)}) AND NOT regexp_matches(t, {_b(V.OFFERS)}) AND NOT known THEN 'wanted'
  WHEN NOT (known OR regexp_matches(t, {_b(V.YEAR_FIRST)}) OR regexp_matches(t, {_b(V.KM_IN_TITLE)}) OR regexp_matches(both_, {_b(V.CAR_WORDS)}))
  THEN CASE WHEN regexp_matches(p, {_b(V.PART)}) OR regexp_matches(p, {_b(V.PART_ANYWHERE)}) THEN 'part' WHEN regexp_matches(t, {_b(V.TOY)}) THEN 'toy' END END AS kind FROM x""")
def not_a_vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, toys and wanted posts among ads; a whole car's signs outweigh a part's words."""
    return ads(spark, sf_dir).select("id", V.not_vehicle(*map(F.col, ("title", "description", "year", "km"))).alias("kind"))


_BARE = f"regexp_replace({_p('title')}, {_b(chr(92) + 'b' + V.NEGATION + chr(92) + 's+(' + chr(92) + 'w+' + chr(92) + 's+)?' + V.DAMAGE + chr(92) + 'b')}, ' ', 'g')"
_VOICE = f"regexp_replace({_p('description')}, {_b(chr(92) + 'bno ' + V.AGENCY_STRONG + chr(92) + 'b')}, ' ', 'g')"


@query(f"""WITH {ADS} SELECT id, regexp_matches({_BARE}, {_b(chr(92) + 'b' + V.DAMAGE + chr(92) + 'b')}) AS damaged,
  coalesce(regexp_matches({_VOICE}, {_b(chr(92) + 'b' + V.AGENCY_STRONG + chr(92) + 'b')}) OR {' + '.join(f"CAST(regexp_matches({_p('description')}, {_b(p)}) AS INTEGER)" for p in V.AGENCY_WEAK)} >= 2, false) AS agency_voice FROM ads""")
def damage_and_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage that the title states and doesn't deny; a private seller who writes like a dealer."""
    return ads(spark, sf_dir).select("id", V.damaged(F.col("title")).alias("damaged"), V.agency_voice(F.col("description")).alias("agency_voice"))


_BRAND = f"coalesce({_map(_p('make'), V.BRAND_ALIAS)}, {_p('make')})"
_CUR = f"""CASE WHEN coalesce(currency = 'USD' AND price >= 100000 AND NOT coalesce(regexp_matches(lower(trim(sign)), '^(us{chr(92)}$|u{chr(92)}$s|usd|u{chr(92)}$d)$'), false) AND NOT coalesce({_BRAND} IN ({', '.join(map(repr, V.HIGH_END))}), false), false)
  THEN CASE WHEN price >= 1000000 THEN 'ARS' END ELSE currency END"""


@query(f"""WITH {ADS}, x AS (SELECT id, price, {_CUR} AS read_as FROM ads)
SELECT id, read_as, coalesce(CASE WHEN read_as = 'USD' THEN price BETWEEN 1000 AND 1000000 WHEN read_as = 'ARS' THEN price >= 500000 END, false) AS plausible FROM x""")
def currency_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The currency of a bare sign by size, sign and make, and whether a vehicle can cost that."""
    a = ads(spark, sf_dir).withColumn("read_as", V.price_currency(*map(F.col, ("price", "currency", "sign", "make"))))
    return a.select("id", "read_as", V.plausible(F.col("price"), F.col("read_as")).alias("plausible"))


_KEY0 = f"trim(regexp_replace(regexp_replace(regexp_replace({_p('seller')}, '[.''’`´]', '', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '{chr(92)}s+', ' ', 'g'))"
_LOCAL = "CASE WHEN length(d) = 12 AND substr(d, 3, 2) = '15' THEN substr(d, 1, 2) || substr(d, 5) WHEN length(d) = 12 AND substr(d, 4, 2) = '15' THEN substr(d, 1, 3) || substr(d, 6) WHEN length(d) = 12 AND substr(d, 5, 2) = '15' THEN substr(d, 1, 4) || substr(d, 7) ELSE d END"


@query(f"""WITH {ADS}, a AS (SELECT id, {_KEY0} AS t FROM ads),
b AS (SELECT id, t, regexp_replace(replace(t, ' ', ''), '^00', '') AS d0 FROM a),
c AS (SELECT id, t, CASE WHEN d0 LIKE '54%' AND length(d0) > 10 THEN CASE WHEN substr(d0, 3) LIKE '9%' AND length(substr(d0, 3)) > 10 THEN substr(d0, 4) ELSE substr(d0, 3) END ELSE d0 END AS d1 FROM b),
e AS (SELECT id, t, CASE WHEN d1 LIKE '0%' THEN substr(d1, 2) ELSE d1 END AS d FROM c),
j AS (SELECT id, t, {_LOCAL} AS n, trim(regexp_replace(regexp_replace(' ' || t || ' ', ' ([a-z]) ([a-z]) ([a-z]) ', ' {chr(92)}1{chr(92)}2{chr(92)}3 ', 'g'), ' ([a-z]) ([a-z]) ', ' {chr(92)}1{chr(92)}2 ', 'g')) AS joined FROM e)
SELECT id, CASE WHEN t IS NULL OR t = '' THEN NULL WHEN regexp_matches(replace(t, ' ', ''), '^[0-9]+$') THEN CASE WHEN length(n) >= 8 THEN 'tel:' || right(n, 10) END
  WHEN length(joined) >= 3 AND joined NOT IN ({', '.join(map(repr, V.SELLER_STOPLIST))}) THEN joined END AS key FROM j""")
def seller_key_national(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key under which one seller's spellings meet: initials joined, phones as national numbers, labels of no one as null."""
    return ads(spark, sf_dir).select("id", V.seller_key(F.col("seller")).alias("key"))
