"""Text operators over documents and pages: numbers, kinds, keys, markup, addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vehicle as V
from ..sources import html
from .base import ORACLE, query, table, tables

_PLAIN = f"trim(regexp_replace(lower(translate({{c}}, '{T.ACCENTED}', '{T.PLAIN}')), '\\s+', ' ', 'g'))"


def _p(c: str) -> str:
    return _PLAIN.format(c=c)


@query(f"SELECT doc_id, {_p('text')} AS plain, length(text) AS n, len(string_split({_p('text')}, ' ')) AS words FROM documents")
def normalized_text_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of each text; normalized_text shows the first 200 characters only."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.plain(F.col("text")).alias("plain"), F.length("text").cast("bigint").alias("n"))
    return docs.select("doc_id", "plain", "n", F.size(F.split("plain", " ")).cast("bigint").alias("words"))


query(ORACLE["normalized_text_whole"], name="normalized_text")(normalized_text_whole)  # under its older name, which once read a part only


@query(r"""
WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'USD ' || (p_partkey * 37) WHEN 1 THEN (p_partkey % 900 + 100) || '.500.000' WHEN 2 THEN (p_partkey % 90 + 1) || ',5 millones' WHEN 3 THEN '$ ' || p_partkey || ' mil' ELSE p_name END AS t FROM part),
n AS (SELECT p_partkey, t, TRY_CAST(replace(replace(nullif(regexp_extract(t, '(\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:,\d+)?)', 1), ''), '.', ''), ',', '.') AS DOUBLE) * CASE WHEN regexp_matches(t, '\d\s*millones\b') THEN 1000000 WHEN regexp_matches(t, '\d\s*mil\b') THEN 1000 ELSE 1 END AS amount FROM p)
SELECT p_partkey, amount, CASE WHEN contains(t, 'USD') THEN 'USD' WHEN amount >= 1000000 THEN 'ARS' WHEN amount IS NOT NULL THEN 'USD' END AS currency, coalesce(amount BETWEEN 500 AND 5e8, false) AS plausible FROM n
""")
def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    t = F.when(k % 5 == 0, F.concat(F.lit("USD "), s(k * 37))).when(k % 5 == 1, F.concat(s(k % 900 + 100), F.lit(".500.000"))).when(k % 5 == 2, F.concat(s(k % 90 + 1), F.lit(",5 millones"))).when(k % 5 == 3, F.concat(F.lit("$ "), s(k), F.lit(" mil"))).otherwise(F.col("p_name"))
    p = table(spark, sf_dir, "part").select("p_partkey", t.alias("t")).withColumn("amount", T.number(F.col("t")))
    return p.select("p_partkey", "amount", T.currency(F.col("amount"), F.col("t")).alias("currency"), F.coalesce(F.col("amount").between(500, 5e8), F.lit(False)).alias("plausible"))


@query(f"""
SELECT doc_id, CASE WHEN regexp_matches({_p('text')}, '\\b(license|licensed)\\b') THEN 'licence' WHEN regexp_matches({_p('text')}, '\\b(password|token)\\b') THEN 'secret' WHEN contains(text, '***') THEN 'noise' ELSE 'plain' END AS kind,
  regexp_extract(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}})', 1) AS mail FROM documents
""")
def keyword_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that a text meets, and the first address in it."""
    t = T.plain(F.col("text"))
    kind = F.when(t.rlike(r"\b(license|licensed)\b"), "licence").when(t.rlike(r"\b(password|token)\b"), "secret").when(F.col("text").contains("***"), "noise").otherwise("plain")
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), F.regexp_extract("text", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", 1).alias("mail"))


@query(r"""
WITH p AS (SELECT p_partkey, p_name, p_type, CASE WHEN regexp_matches(lower(p_name), '\b(ring|gear)\b') THEN 'part' WHEN regexp_matches(lower(p_name), '\b(widget|bolt)\b') THEN 'tool' WHEN regexp_matches(lower(p_type), 'small|economy') THEN 'light' WHEN regexp_matches(lower(p_type), 'large') THEN 'heavy' END AS kind FROM part)
SELECT p_partkey, kind, CASE WHEN kind IN ('part', 'tool') THEN 0.9::DOUBLE WHEN kind IS NOT NULL THEN 0.65::DOUBLE ELSE 0.35::DOUBLE END AS confidence FROM p
""")
def kind_resolution_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name settles the kind if it can, else the type; confidence says which did."""
    by_name = T.first_of([F.col("p_name")], [("part", r"\b(ring|gear)\b"), ("tool", r"\b(widget|bolt)\b")])
    by_type = T.first_of([F.col("p_type")], [("light", "small|economy"), ("heavy", "large")])
    p = table(spark, sf_dir, "part").select("p_partkey", by_name.alias("a"), by_type.alias("b"))
    return p.select("p_partkey", F.coalesce("a", "b").alias("kind"), F.when(F.col("a").isNotNull(), 0.9).when(F.col("b").isNotNull(), 0.65).otherwise(0.35).alias("confidence"))


@query(r"""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
  trim(regexp_replace(regexp_replace(url, '^https?://[^/?#]*|[?#].*$', '', 'g'), '[/_\-.]+', ' ', 'g')) AS words, length(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^>]*>', ' ', 'g')) AS visible FROM pages
""")
def html_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", html.title(F.col("html")).alias("title"), html.language(F.col("html")).alias("lang"), F.size(html.links(F.col("html"))).cast("bigint").alias("links"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), T.path_words(F.col("url")).alias("words"), F.length(html.visible(F.col("html"))).cast("bigint").alias("visible"))


@query(r"""
WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN ' Jo.Ann+' || c_custkey || '@GMail.com ' ELSE 'u.' || (c_custkey % 50) || '@Example.org' END AS m FROM customer),
e AS (SELECT c_custkey, lower(trim(m)) AS m FROM a)
SELECT CASE WHEN split_part(m, '@', 2) = 'gmail.com' THEN replace(regexp_replace(split_part(m, '@', 1), '\+.*$', ''), '.', '') ELSE regexp_replace(split_part(m, '@', 1), '\+.*$', '') END || '@' || split_part(m, '@', 2) AS mail, count(*) AS accounts, min(c_custkey) AS first FROM e GROUP BY 1
""")
def canonical_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    m = F.when(k % 2 == 0, F.concat(F.lit(" Jo.Ann+"), k.cast("string"), F.lit("@GMail.com "))).otherwise(F.concat(F.lit("u."), (k % 50).cast("string"), F.lit("@Example.org")))
    return table(spark, sf_dir, "customer").groupBy(T.email(m).alias("mail")).agg(F.count(F.lit(1)).alias("accounts"), F.min("c_custkey").alias("first"))


@query("""
SELECT p_partkey, md5(p_brand || '|' || p_type || '|' || p_size) AS attrs, sha1(p_name) AS fingerprint, sha256(p_name || p_brand) AS digest FROM part
""")
def attribute_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.md5(F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string")).cast("binary")).alias("attrs"), F.sha1(F.col("p_name").cast("binary")).alias("fingerprint"), F.sha2(F.concat("p_name", "p_brand").cast("binary"), 256).alias("digest"))


@query("""
SELECT CAST(props->>'$.k' AS INTEGER) AS k, event_type, count(*) AS n, json_exists(any_value(props), '$.k') AS has_k FROM events GROUP BY 1, 2
""")
def json_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return table(spark, sf_dir, "events").groupBy(v.alias("k"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.first(F.get_json_object("props", "$.k").isNotNull()).alias("has_k"))


@query("""
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 12 AS n FROM orders),
s AS (SELECT o_orderkey, d, n, list_filter(generate_series(d + 1, d + 30, INTERVAL 1 DAY), lambda x: isodow(x) < 6) AS w FROM d)
SELECT o_orderkey, strftime(CASE WHEN n > 0 THEN w[n] WHEN isodow(d) < 6 THEN d ELSE d - CAST(isodow(d) - 5 AS INTEGER) END, '%Y-%m-%d') AS due FROM s
""")
def business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(T.add_business_days(F.to_date("o_orderdate"), (F.col("o_orderkey") % 12).cast("int")), "yyyy-MM-dd").alias("due"))


@query(f"""
WITH f AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS prev FROM conversations WHERE text IS NOT NULL),
s AS (SELECT conv_id, turn, list_distinct(string_split({_p('text')}, ' ')) AS a, list_distinct(string_split({_p('prev')}, ' ')) AS b FROM f WHERE prev IS NOT NULL)
SELECT conv_id, turn, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM s
""")
def question_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's words against the same role's turn before it."""
    from pyspark.sql import Window as W

    f = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").withColumn("prev", F.lag("text").over(W.partitionBy("conv_id", "role").orderBy("turn"))).filter("prev IS NOT NULL")
    return f.select("conv_id", "turn", F.round(T.token_jaccard(F.col("text"), F.col("prev")), 6).alias("jaccard"))


@query(r"""
SELECT s_suppkey, trim(regexp_replace(regexp_replace(replace(lower('The ' || s_name || ' S.A.'), '.', ''), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM supplier
""")
def seller_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", V.seller_key(F.concat(F.lit("The "), "s_name", F.lit(" S.A."))).alias("key"))


@query("""
SELECT n_name AS nation, r_name AS region, strlen(n_name) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name NOT LIKE '%\\_1%' ESCAPE '\\'
""")
def place_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = tables(spark, sf_dir, "nation", "region")
    return nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).filter(~F.col("n_name").contains("_1")).select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.length("n_name").cast("bigint").alias("n"))
