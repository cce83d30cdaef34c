"""What a description states: amounts with their labels, mileage, the effective price, claims with evidence; and templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .base import query, table
from .normalize import _b, _chosen, _pick
from .text import _p

_SAY = [
    "Anticipo $ 3.000.000 y 24 cuotas de $ 150.000. Contado $ 12.500.000", "Precio de lista u$s 15.500, contado efectivo u$s 14.200", "Modelo 2015 con 98.000 km reales, $ 9.800.000", "Cubiertas con 20.000 km, auto con 130.000 km",
    "Entrega u$s 5.000 y cuotas fijas", "Vendo u$s 12.000 no permuto", "Valor $ 18 millones, anticipo $ 6 millones", "Km 45000. Precio contado u$s 21.000. Lista u$s 23.500", "Sin precio, consultar", "Financiado $ 14.000.000 o contado $ 11.200.000; service oficial",
    None, "Unico dueño, nunca chocado, service al dia", "No es unico dueño. Chocado de atras", "Acepta permuta. Correa de distribucion cambiada", "No tiene service, sin permuta",
]
SAID = f"said AS (SELECT p_partkey AS id, {_pick('p_partkey', _SAY)} AS text, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 10000 WHEN p_partkey % 3 = 1 THEN p_retailprice * 10 END AS published, CASE WHEN p_partkey % 3 = 0 THEN 'ARS' ELSE 'USD' END AS currency FROM part)"
RATE, FX_TOLERANCE = 1000.0, 0.03
#: Words before an amount that say what it is, and shares between which a cash price can be.
AMOUNT = r"([a-z ,.;:0-9]{0,45}?)(u\$s|us\$|usd|\$) ?(\d{1,3}(\.\d{3})+|\d+)( millones| mil)?"
KINDS = {"down_payment": r"(anticipo|entrega)[a-z ]*$", "installment": r"cuotas?[a-z ]*$", "cash": r"(contado|efectivo)[a-z ]*$", "list": r"(lista|financiado)[a-z ]*$"}
SUBJECT = {"single_owner": r"\b(unico|primer) (dueno|titular)\b", "service": r"\b(service|mantenimiento)\b", "trade_in": r"\b(permut\w*|canje\w*)\b", "damage": r"\b(choc\w*|granizo|golp\w*)\b"}
NEGATIVE = r"\b(no|sin|nunca|jamas)\b"
MIN_CASH, DOWN_RATIO = 0.5, 1.6


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(f"WITH {SAID} SELECT * FROM said")


def amounts(c: Column) -> Column:
    """Array of (kind, amount, currency), in the text's order: a currency sign, a number, its scale, and the words before."""
    t = T.plain(c)
    part = lambda k: F.regexp_extract_all(t, F.lit(AMOUNT), F.lit(k))
    zipped = F.arrays_zip(part(1).alias("before"), part(2).alias("sign"), part(3).alias("number"), part(5).alias("scale"))

    def one(a: Column) -> Column:
        kind = F.when(F.lit(False), F.lit(""))
        for name, pattern in KINDS.items():
            kind = kind.when(a["before"].rlike(pattern), name)
        value = F.replace(a["number"], F.lit("."), F.lit("")).cast("double") * F.when(a["scale"] == " millones", 1e6).when(a["scale"] == " mil", 1e3).otherwise(1.0)
        return F.struct(F.coalesce(kind, F.lit("generic")).alias("kind"), value.alias("amount"), F.when(a["sign"] == "$", F.when(value >= 1_000_000, "ARS").otherwise("USD")).otherwise("USD").alias("currency"))

    return F.transform(zipped, one)


_AMOUNTS = f"""
parts AS (SELECT id, published, currency, text, regexp_extract_all({_p('text')}, {_b(AMOUNT)}, 1) AS b, regexp_extract_all({_p('text')}, {_b(AMOUNT)}, 2) AS s, regexp_extract_all({_p('text')}, {_b(AMOUNT)}, 3) AS n, regexp_extract_all({_p('text')}, {_b(AMOUNT)}, 5) AS m FROM said),
each AS (SELECT id, i, coalesce({_chosen('b[i]', KINDS)}, 'generic') AS kind, s[i] AS sign, CAST(replace(n[i], '.', '') AS DOUBLE) * CASE m[i] WHEN ' millones' THEN 1e6 WHEN ' mil' THEN 1e3 ELSE 1 END AS amount FROM (SELECT *, unnest(range(1, len(n) + 1)) AS i FROM parts)),
amounts AS (SELECT id, i, kind, amount, CASE WHEN sign = '$' THEN CASE WHEN amount >= 1000000 THEN 'ARS' ELSE 'USD' END ELSE 'USD' END AS currency FROM each)
"""


@query(f"WITH {SAID}, {_AMOUNTS} SELECT id, CAST(i - 1 AS INTEGER) AS place, kind, amount, currency FROM amounts")
def description_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each amount of a description: what it is by the words before it, in which currency."""
    return said(spark, sf_dir).select("id", F.posexplode(amounts(F.col("text"))).alias("place", "a")).select("id", "place", "a.kind", "a.amount", "a.currency")


_KM = r"(^|[^a-z0-9])(km|kilometros)[ :]*(\d{1,3}(\.\d{3})+|\d{3,6})\b|(\d{1,3}(\.\d{3})+|\d{3,6}) ?(km|kms|kilometros)\b( reales)?"
_KM_OTHER = r"(cubiertas|neumaticos|service)[a-z ]*con (\d{1,3}(\.\d{3})+|\d+) ?km"


@query(f"""WITH {SAID}, t AS (SELECT id, regexp_replace({_p('text')}, {_b(_KM_OTHER)}, ' ', 'g') AS k, {_p('text')} AS p FROM said)
SELECT id, CAST(replace(nullif(coalesce(nullif(regexp_extract(k, {_b(_KM)}, 3), ''), nullif(regexp_extract(k, {_b(_KM)}, 5), '')), ''), '.', '') AS BIGINT) AS km,
  CAST(nullif(regexp_extract(p, '(modelo|ano) (19[89][0-9]|20[0-3][0-9])', 2), '') AS INTEGER) AS year,
  coalesce(regexp_matches(p, '(financi[a-z]*|cuotas?|anticipo)'), false) AS financing, CAST(nullif(regexp_extract(p, '([0-9]+) cuotas', 1), '') AS INTEGER) AS installments FROM t""")
def description_mileage_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mileage that is the car's and not its tyres', a stated year, and whether and over how long it is financed."""
    p = T.plain(F.col("text"))
    k = F.regexp_replace(p, _KM_OTHER, " ")
    km = F.coalesce(*[F.nullif(F.regexp_extract(k, _KM, g), F.lit("")) for g in (3, 5)])
    num = lambda pattern, g: F.nullif(F.regexp_extract(p, pattern, g), F.lit("")).cast("int")
    return said(spark, sf_dir).select("id", F.replace(km, F.lit("."), F.lit("")).cast("long").alias("km"), num("(modelo|ano) (19[89][0-9]|20[0-3][0-9])", 2).alias("year"), F.coalesce(p.rlike("(financi[a-z]*|cuotas?|anticipo)"), F.lit(False)).alias("financing"), num("([0-9]+) cuotas", 1).alias("installments"))


@query(f"""WITH {SAID}, {_AMOUNTS},
u AS (SELECT a.*, CASE WHEN a.currency = 'USD' THEN a.amount ELSE a.amount / {RATE} END AS usd, published, CASE WHEN s.currency = 'USD' THEN published ELSE published / {RATE} END AS pub FROM amounts a JOIN said s ON s.id = a.id WHERE published IS NOT NULL),
g AS (SELECT id, min_by(kind, i) FILTER (WHERE abs(usd - pub) <= {FX_TOLERANCE} * greatest(usd, pub)) AS published_kind,
  min(usd) FILTER (WHERE kind = 'cash' AND abs(usd - pub) > {FX_TOLERANCE} * greatest(usd, pub) AND usd >= {MIN_CASH} * pub AND usd < pub) AS cheaper,
  min(usd) FILTER (WHERE kind = 'cash' AND usd > pub * (1 + {FX_TOLERANCE})) AS cash_above, max(usd) FILTER (WHERE kind IN ('list', 'generic') AND usd > pub * (1 + {FX_TOLERANCE})) AS total_above,
  min(usd) FILTER (WHERE kind = 'cash' AND usd >= {DOWN_RATIO} * pub) AS cash_far, max(usd) FILTER (WHERE kind = 'generic' AND usd >= {DOWN_RATIO} * pub) AS generic_far FROM u GROUP BY id),
w AS (SELECT s.id, CASE WHEN s.currency = 'USD' THEN published ELSE published / {RATE} END AS pub, g.* EXCLUDE (id) FROM said s LEFT JOIN g ON g.id = s.id WHERE published IS NOT NULL)
SELECT id, published_kind, round(CASE WHEN published_kind IN ('down_payment', 'installment') THEN coalesce(cash_above, total_above, pub) WHEN published_kind IS DISTINCT FROM 'cash' AND cheaper IS NOT NULL THEN cheaper WHEN published_kind IS NULL THEN coalesce(cash_far, generic_far, pub) ELSE pub END, 2) AS effective_usd,
  coalesce(published_kind IN ('down_payment', 'installment') AND coalesce(cash_above, total_above) IS NULL, false) AS price_partial FROM w""")
def effective_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the car costs: the published number, or the text's cash or total price where the number is a part of it."""
    usd = lambda a, c: F.when(c == "USD", a).otherwise(a / RATE)
    s = said(spark, sf_dir).filter("published IS NOT NULL").select("id", usd(F.col("published"), F.col("currency")).alias("pub"), F.coalesce(amounts(F.col("text")), F.array().cast("array<struct<kind:string,amount:double,currency:string>>")).alias("a"))
    s = s.withColumn("a", F.transform("a", lambda x: F.struct(x["kind"].alias("kind"), usd(x["amount"], x["currency"]).alias("usd"))))
    pub = F.col("pub")
    same = lambda x: F.abs(x["usd"] - pub) <= FX_TOLERANCE * F.greatest(x["usd"], pub)

    def of(keep, kinds: tuple[str, ...]) -> Column:
        return F.transform(F.filter("a", lambda x: x["kind"].isin(*kinds) & keep(x)), lambda x: x["usd"])

    above = lambda x: x["usd"] > pub * (1 + FX_TOLERANCE)
    far = lambda x: x["usd"] >= DOWN_RATIO * pub
    kind = F.get(F.transform(F.filter("a", same), lambda x: x["kind"]), F.lit(0))
    cheaper = F.array_min(of(lambda x: ~same(x) & (x["usd"] >= MIN_CASH * pub) & (x["usd"] < pub), ("cash",)))
    total = F.coalesce(F.array_min(of(above, ("cash",))), F.array_max(of(above, ("list", "generic"))))
    beyond = F.coalesce(F.array_min(of(far, ("cash",))), F.array_max(of(far, ("generic",))))
    k = F.col("published_kind")
    part = F.coalesce(k.isin("down_payment", "installment"), F.lit(False))
    price = F.when(part, F.coalesce(total, pub)).when(~k.eqNullSafe("cash") & cheaper.isNotNull(), cheaper).when(k.isNull(), F.coalesce(beyond, pub)).otherwise(pub)
    return s.withColumn("published_kind", kind).select("id", "published_kind", F.round(price, 2).alias("effective_usd"), (part & total.isNull()).alias("price_partial"))


_FIELDS = list(SUBJECT)
_QUOTES = {"single_owner": "unico dueno", "service": "service", "trade_in": "permuta", "damage": "chocado"}
_CLAIMS = "claims AS (SELECT id, text, " + " ".join(["CASE id % 4", *[f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FIELDS)], "END AS field,"]) + " " + " ".join(["CASE id % 4", *[f"WHEN {i} THEN '{_QUOTES[f]}'" for i, f in enumerate(_FIELDS)], "END AS quote,"]) + " id % 8 < 4 AS value FROM said)"


@query(f"""WITH {SAID}, {_CLAIMS}, c AS (SELECT id, field, value, quote, regexp_extract({_p('text')}, '([^.,]*)' || quote || '[^.,]*', 0) AS around FROM claims)
SELECT id, field, value FROM c WHERE coalesce(around, '') <> '' AND CASE field {' '.join(f"WHEN '{f}' THEN regexp_matches(quote, {_b(p)})" for f, p in SUBJECT.items())} END AND regexp_matches(around, {_b(NEGATIVE)}) <> value""")
def grounded_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of which the quote stands in the text, is of the field's subject, and agrees in its clause's negation."""
    said(spark, sf_dir).createOrReplaceTempView("said_now")
    c = spark.sql(f"WITH said AS (SELECT * FROM said_now), {_CLAIMS} SELECT * FROM claims")
    around = F.call_function("regexp_extract", T.plain(F.col("text")), F.concat(F.lit("([^.,]*)"), F.col("quote"), F.lit("[^.,]*")), F.lit(0))
    subject = F.when(F.lit(False), F.lit(False))
    for f, p in SUBJECT.items():
        subject = subject.when(F.col("field") == f, F.col("quote").rlike(p))
    return c.withColumn("around", around).filter((F.coalesce("around", F.lit("")) != "") & subject & (F.col("around").rlike(NEGATIVE) != F.col("value"))).select("id", "field", "value")


_TEMPLATES = ["Hola {name}, vi tu {car} a {price}.", "Buenas, sigue la {car}? Soy {me}", "{name}: ofrezco {price} por {car}", "Consulta por {car} {year}"]


@query(f"""WITH t AS (SELECT p_partkey AS id, {_pick('p_partkey', _TEMPLATES)} AS template, p_name AS car, p_brand AS name, '$ ' || CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) AS price FROM part),
f AS (SELECT id, replace(replace(replace(template, '{{name}}', name), '{{car}}', car), '{{price}}', price) AS message FROM t)
SELECT id, message, CASE WHEN regexp_matches(message, '[{{][a-z]+[}}]') THEN 'unfilled' WHEN length(message) > 45 THEN 'long' WHEN message LIKE '%  %' THEN 'spaces' END AS problem FROM f""")
def template_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages from templates, with what is wrong with them: a field left open, too long, double spaces."""
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    t = spark.sql(f"SELECT p_partkey AS id, {_pick('p_partkey', _TEMPLATES)} AS template, p_name AS car, p_brand AS name, concat('$ ', CAST(floor(p_retailprice) AS BIGINT)) AS price FROM part")
    m = F.col("template")
    for k in ("name", "car", "price"):
        m = F.replace(m, F.lit("{" + k + "}"), F.col(k))
    t = t.select("id", m.alias("message"))
    return t.select("id", "message", F.when(F.col("message").rlike("[{][a-z]+[}]"), "unfilled").when(F.length("message") > 45, "long").when(F.col("message").contains("  "), "spaces").alias("problem"))


_URLS = ["https://x.com/?utm_source=google&utm_medium=cpc", "https://x.com/a?utm_source=newsletter&utm_medium=email&utm_campaign=may", "https://x.com/b", "https://x.com/?fbclid=123", "https://x.com/?gclid=9", "https://x.com/?utm_source=instagram"]
_REFS = ["https://www.google.com/search", None, "https://l.facebook.com/", "https://t.co/x", "https://chat.openai.com/", "https://blog.example.org/post", "android-app://com.google"]
_PAID = "regexp_matches(medium, '^(cpc|ppc|paid.*)$')"


@query(f"""WITH v AS (SELECT event_id, user_id, {_pick('event_id', _URLS)} AS url, {_pick('event_id', _REFS)} AS referrer FROM events),
p AS (SELECT event_id, regexp_extract(url, '[?&]utm_source=([^&]*)', 1) AS source, regexp_extract(url, '[?&]utm_medium=([^&]*)', 1) AS medium, url, coalesce(regexp_extract(referrer, '^[a-z-]+://([^/]+)', 1), '') AS host FROM v),
c AS (SELECT event_id, CASE WHEN regexp_matches(url, '[?&]gclid=') OR {_PAID} THEN 'paid_search' WHEN medium = 'email' THEN 'email' WHEN regexp_matches(url, '[?&]fbclid=') OR regexp_matches(source, '^(facebook|instagram)$') OR regexp_matches(host, '(facebook[.]com|instagram[.]com|^t[.]co)$') THEN 'social'
  WHEN source <> '' THEN 'campaign' WHEN regexp_matches(host, '(google|bing|duckduckgo)[.]') THEN 'organic' WHEN regexp_matches(host, 'openai[.]com$') THEN 'assistant' WHEN host <> '' THEN 'referral' ELSE 'direct' END AS channel FROM p)
SELECT channel, count(*) AS n FROM c GROUP BY channel""")
def channel_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channel of each visit: paid, mail, social, campaign, organic, assistant, referral, direct, in that order."""
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    v = spark.sql(f"SELECT {_pick('event_id', _URLS)} AS url, {_pick('event_id', _REFS)} AS referrer FROM events")
    url = F.col("url")
    source, medium = F.regexp_extract(url, "[?&]utm_source=([^&]*)", 1), F.regexp_extract(url, "[?&]utm_medium=([^&]*)", 1)
    host = F.coalesce(F.regexp_extract("referrer", "^[a-z-]+://([^/]+)", 1), F.lit(""))
    channel = F.when(url.rlike("[?&]gclid=") | medium.rlike("^(cpc|ppc|paid.*)$"), "paid_search").when(medium == "email", "email").when(url.rlike("[?&]fbclid=") | source.rlike("^(facebook|instagram)$") | host.rlike("(facebook[.]com|instagram[.]com|^t[.]co)$"), "social")
    channel = channel.when(source != "", "campaign").when(host.rlike("(google|bing|duckduckgo)[.]"), "organic").when(host.rlike("openai[.]com$"), "assistant").when(host != "", "referral").otherwise("direct")
    return v.groupBy(channel.alias("channel")).agg(F.count(F.lit(1)).alias("n"))
