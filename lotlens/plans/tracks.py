"""Histories: price tracks, weekly market rows, reposts, sellers, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.mutual_pairs import mutual_pairs
from ..session import settled
from .base import ORACLE, LISTINGS, dec, exact, listings, query, table


@query("""
WITH s AS (SELECT user_id AS id, ts, event_id, value AS price, lag(value) OVER w AS before FROM events WHERE value IS NOT NULL AND event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT * FROM s WHERE before IS NULL OR price <> before),
t AS (SELECT *, lag(price) OVER w AS prev, row_number() OVER w AS k, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) AS kd FROM c WINDOW w AS (PARTITION BY id ORDER BY ts, event_id))
SELECT id, count(*) AS n, count(*) FILTER (WHERE price <= prev * 0.99) AS drops, count(*) FILTER (WHERE price >= prev * 1.01) AS rises,
  max(price) FILTER (WHERE k = 1) AS first_price, max(price) FILTER (WHERE kd = 1) AS last_price,
  round((1 - max(price) FILTER (WHERE kd = 1) / max(price) FILTER (WHERE k = 1)) * 100, 1) AS cum_pct,
  strftime(max(ts) FILTER (WHERE price <= prev * 0.99), '%Y-%m-%d %H:%M:%S') AS last_drop_at
FROM t GROUP BY id
""")
def price_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    seen = table(spark, sf_dir, "events").filter("value IS NOT NULL AND event_type IN ('view', 'click')").withColumn("before", F.lag("value").over(w))
    kept = seen.filter("before IS NULL OR value <> before").withColumn("prev", F.lag("value").over(w))
    drop, rise = F.col("value") <= F.col("prev") * 0.99, F.col("value") >= F.col("prev") * 1.01
    first, last = F.min_by("value", F.struct("ts", "event_id")), F.max_by("value", F.struct("ts", "event_id"))
    cum = F.when(first != 0, 1 - last / F.nullif(first, F.lit(0.0))).when(last > 0, F.lit(float("-inf"))).when(last < 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))  # a first price of zero
    return kept.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(drop).alias("drops"), F.count_if(rise).alias("rises"), first.alias("first_price"), last.alias("last_price"), dec(cum * 100, 1).alias("cum_pct"), F.date_format(F.max(F.when(drop, F.col("ts"))), "yyyy-MM-dd HH:mm:ss").alias("last_drop_at"))


@query("""
SELECT event_id, round(CASE WHEN prev > value THEN (1 - value / prev) * 100 END, 2) AS drop_pct
FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev FROM events)
""")
def price_drop_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev = F.lag("value").over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", "value", prev.alias("prev")).select("event_id", dec(F.when(F.col("prev") > F.col("value"), (1 - F.col("value") / F.col("prev")) * 100), 2).alias("drop_pct"))


@query("""
WITH f AS (
  SELECT p_brand AS make, p_type AS model, r_name AS region, CAST(floor(year(l_shipdate) / 2) * 2 AS INTEGER) AS band, l_extendedprice AS price,
    CAST(date_trunc('week', l_shipdate - INTERVAL 3 HOUR) AS DATE) AS week, l_returnflag AS source, l_orderkey
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT week, 'model:' || make || '/' || model AS grp, region, band, price, source, l_orderkey FROM f UNION ALL SELECT week, 'body:' || model, region, band, price, source, l_orderkey FROM f),
z AS (SELECT *, region AS zone FROM g UNION ALL SELECT *, 'all' FROM g)
SELECT strftime(week, '%Y-%m-%d') AS week, grp, zone, band, count(*) AS active, count(*) FILTER (WHERE source = 'N') AS fresh, count(*) FILTER (WHERE source = 'R') AS gone, count(DISTINCT l_orderkey) AS orders,
  CASE WHEN count(*) >= 8 THEN round(quantile_cont(price, 0.25), 4) END AS p25, CASE WHEN count(*) >= 5 THEN round(quantile_cont(price, 0.5), 4) END AS median, CASE WHEN count(*) >= 8 THEN round(quantile_cont(price, 0.75), 4) END AS p75
FROM z GROUP BY week, grp, zone, band
""")
def weekly_market_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each offer counts in several groups and zones.

    Counts are plain aggregates, orders are counted after their repeats have gone, and only groups large enough to show a
    median have their prices gathered.
    """
    line, part, supplier, nation, region = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation", "region"))
    place = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    facts = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(place, F.col("l_suppkey") == F.col("s_suppkey"))
    local = F.col("l_shipdate").cast("timestamp") - F.expr("INTERVAL 3 HOURS")
    groups = F.array(F.concat(F.lit("model:"), "p_brand", F.lit("/"), "p_type"), F.concat(F.lit("body:"), "p_type"))
    wide = facts.select(F.date_format(F.date_trunc("week", local), "yyyy-MM-dd").alias("week"), (F.floor(F.year("l_shipdate") / 2) * 2).cast("int").alias("band"), F.col("l_extendedprice").alias("price"), "l_returnflag", "l_orderkey", F.explode(groups).alias("grp"), "r_name")
    wide = wide.withColumn("zone", F.explode(F.array("r_name", F.lit("all"))))
    keys = ["week", "grp", "zone", "band"]
    counts = wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("active"), F.count_if(F.col("l_returnflag") == "N").alias("fresh"), F.count_if(F.col("l_returnflag") == "R").alias("gone"))
    orders = wide.select(*keys, "l_orderkey").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("orders"))
    prices = wide.join(counts.filter("active >= 5").select(*keys), keys).groupBy(*keys).agg(F.percentile("price", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"))
    agg = counts.join(orders, keys).join(prices, keys, "left")
    p = [dec(F.get("p", F.lit(k)), 4) for k in range(3)]
    return agg.select("week", "grp", "zone", "band", "active", "fresh", "gone", "orders", F.when(F.col("active") >= 8, p[0]).alias("p25"), F.when(F.col("active") >= 5, p[1]).alias("median"), F.when(F.col("active") >= 8, p[2]).alias("p75"))


@query("""
WITH o AS (SELECT o_orderkey AS id, o_custkey AS fp, CAST(o_orderdate AS DATE) AS d, o_totalprice AS price FROM orders),
hit AS (SELECT a.id, min_by(b.id, (b.d, b.id)) AS root FROM o a JOIN o b ON a.fp = b.fp AND b.d >= a.d - 60 AND (b.d < a.d OR (b.d = a.d AND b.id < a.id)) AND abs(b.price - a.price) < a.price * 0.1 GROUP BY a.id)
SELECT o.id, coalesce(h2.root, h1.root) AS repost_of FROM o LEFT JOIN hit h1 ON o.id = h1.id LEFT JOIN hit h2 ON h1.root = h2.id
""")
def repost_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest earlier offer with the fingerprint, within 60 days and 10 % of the price; a chain's step goes to the root's own.

    Fingerprints are met by day blocks of 60 days, so one fingerprint with many offers is spread over its days.
    """
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("fp"), F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").alias("price"))
    block = F.floor(F.unix_date("d") / 60)
    mine = o.withColumn("block", F.explode(F.array(block, block - 1)))
    theirs = o.select("fp", F.col("id").alias("b_id"), F.col("d").alias("b_d"), F.col("price").alias("b_price"), block.alias("block"))
    earlier = (F.col("b_d") < F.col("d")) | ((F.col("b_d") == F.col("d")) & (F.col("b_id") < F.col("id")))
    close = (F.col("b_d") >= F.date_sub("d", 60)) & (F.abs(F.col("b_price") - F.col("price")) < F.col("price") * 0.1)
    hit = mine.join(theirs, ["fp", "block"]).filter(earlier & close).groupBy("id").agg(F.min_by("b_id", F.struct("b_d", "b_id")).alias("root"))
    up = hit.select(F.col("id").alias("root"), F.col("root").alias("above"))
    return o.join(hit, "id", "left").join(up, "root", "left").select("id", F.coalesce("above", "root").alias("repost_of"))


@query(f"""
WITH {LISTINGS}, n AS (SELECT max(seen) AS now FROM listings),
c AS (SELECT source, seller, count(DISTINCT part) AS cars FROM listings, n WHERE seen > now - 180 GROUP BY source, seller)
SELECT source, seller, cars, CASE WHEN cars >= 6 THEN 'dealer' WHEN s_acctbal > 5000 THEN 'dealer' ELSE 'private' END AS kind, CASE WHEN s_acctbal > 5000 THEN 'stated' WHEN cars >= 6 THEN 'inferred' ELSE 'default' END AS how
FROM c JOIN supplier ON seller = s_suppkey
""")
def seller_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = listings(spark, sf_dir)
    now = offers.agg(F.max("seen").alias("now"))
    counts = offers.join(F.broadcast(now), F.col("seen") > F.date_sub("now", 180)).groupBy("source", "seller").agg(F.count_distinct("part").alias("cars"))
    many, stated = F.col("cars") >= 6, F.col("s_acctbal") > 5000
    return counts.join(table(spark, sf_dir, "supplier"), F.col("seller") == F.col("s_suppkey")).select("source", "seller", "cars", F.when(many | stated, "dealer").otherwise("private").alias("kind"), F.when(stated, "stated").when(many, "inferred").otherwise("default").alias("how"))


@query(f"""
WITH {LISTINGS},
p AS (SELECT a.id AS a, b.id AS b FROM listings a JOIN listings b ON a.make = b.make AND a.model = b.model AND a.year = b.year AND a.trim = b.trim AND a.source <> b.source AND a.id < b.id
  WHERE abs(a.price - b.price) <= 0.05 * a.price AND (a.km IS NULL OR b.km IS NULL OR abs(a.km - b.km) <= 2)),
na AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p) GROUP BY id)
SELECT a, b FROM p JOIN na x ON a = x.id JOIN na y ON b = y.id WHERE x.n = 1 AND y.n = 1
""")
def duplicate_pairs_mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of two sources that look like one car, kept only where each is the other's single candidate."""
    return mutual_pairs(listings(spark, sf_dir))


@query("""
WITH w AS (SELECT doc_id, string_split(lower(coalesce(text, '')), ' ') AS w FROM documents),
s AS (SELECT doc_id, ('0x' || substr(md5(unnest([array_to_string(w[i : i + 2], ' ') FOR i IN range(1, greatest(len(w) - 1, 2))])), 1, 15))::BIGINT AS h FROM w),
b AS (SELECT doc_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS votes FROM s, (SELECT CAST(unnest(range(60)) AS INTEGER) AS i) GROUP BY doc_id, i),
f AS (SELECT doc_id, CAST(sum(CASE WHEN votes > 0 THEN 1::BIGINT << i ELSE 0 END) AS BIGINT) AS h FROM b GROUP BY doc_id),
c AS (SELECT h, min(doc_id) AS first FROM f GROUP BY h)
SELECT first AS a, doc_id AS b, 0 AS distance FROM f JOIN c USING (h) WHERE doc_id <> first
UNION ALL
SELECT least(x.first, y.first), greatest(x.first, y.first), CAST(bit_count(xor(x.h, y.h)) AS INTEGER) FROM c x JOIN c y ON x.h < y.h AND bit_count(xor(x.h, y.h)) <= 3
""")
def hamming_near_dupes_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all shingles of three words of the whole text: 60 bits, each by the votes of the shingles' hashes.

    Equal fingerprints are a class: each member stands beside the least id, at distance 0. Pairs at distances 1 to 3 are
    made between distinct fingerprints only; with 3 differing bits in 4 parts of 15, one part at least is equal.
    """
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), " ")
    docs = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    made = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.conv(F.substring(F.md5(F.array_join(F.slice("w", i, 3), " ").cast("binary")), 1, 15), 16, 10).cast("bigint"))
    hashes = docs.select("doc_id", F.explode(made).alias("h"))
    votes = hashes.groupBy("doc_id").agg(*[F.sum(F.shiftright("h", i).bitwiseAND(1) * 2 - 1).alias(f"v{i}") for i in range(60)])
    h = sum((F.when(F.col(f"v{i}") > 0, F.lit(1 << i)).otherwise(0).cast("bigint") for i in range(60)), F.lit(0).cast("bigint"))
    prints = settled(votes.select("doc_id", h.alias("h")))  # read twice; the texts are hashed once
    firsts = prints.groupBy("h").agg(F.min("doc_id").alias("first"))
    same = prints.join(firsts, "h").filter(F.col("doc_id") != F.col("first")).select(F.col("first").alias("a"), F.col("doc_id").alias("b"), F.lit(0).alias("distance"))
    keyed = firsts.withColumn("k", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.shiftright("h", 15 * i).bitwiseAND(32767).alias("b")) for i in range(4)])))
    met = keyed.select(F.col("first").alias("x"), F.col("h").alias("hx"), "k").join(keyed.select(F.col("first").alias("y"), F.col("h").alias("hy"), "k"), "k").filter("hx < hy")
    near = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.bit_count(F.col("hx").bitwiseXOR(F.col("hy"))).cast("int").alias("distance")).filter("distance <= 3")
    return same.unionByName(near.distinct())


query(ORACLE["hamming_near_dupes_whole"], name="hamming_near_dupes")(hamming_near_dupes_whole)  # under its older name, which once read a part only


@query(f"""
WITH {LISTINGS}, w AS (SELECT date_trunc('month', seen) AS m, source, seller, id, price FROM listings)
SELECT strftime(m, '%Y-%m') AS month, source, count(*) AS n, count(DISTINCT seller) AS sellers, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS worth,
  CAST(sum(CAST(sum(CAST(price AS DECIMAL(18,2))) AS DECIMAL(28,2))) OVER (PARTITION BY source ORDER BY m) AS DECIMAL(38,2)) AS running
FROM w GROUP BY m, source
""")
def monthly_running_worth(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_format("seen", "yyyy-MM")
    agg = listings(spark, sf_dir).groupBy(month.alias("month"), "source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seller").alias("sellers"), F.sum(exact("price")).cast("decimal(28,2)").alias("worth"))
    return agg.withColumn("running", F.sum("worth").over(W.partitionBy("source").orderBy("month")).cast("decimal(38,2)"))


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS j FROM orders),
i AS (SELECT o_custkey, o_orderstatus, k - j AS island, count(*) AS n FROM r GROUP BY 1, 2, 3)
SELECT o_custkey AS source, max(n) FILTER (WHERE o_orderstatus = 'F') AS longest_failure, max(n) FILTER (WHERE o_orderstatus = 'O') AS longest_ok, count(*) AS islands FROM i GROUP BY o_custkey
""")
def health_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and islands: the longest runs of one status."""
    order = ["o_orderdate", "o_orderkey"]
    k, j = F.row_number().over(W.partitionBy("o_custkey").orderBy(*order)), F.row_number().over(W.partitionBy("o_custkey", "o_orderstatus").orderBy(*order))
    islands = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", (k - j).alias("island")).groupBy("o_custkey", "o_orderstatus", "island").agg(F.count(F.lit(1)).alias("n"))
    longest = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("n")))
    return islands.groupBy(F.col("o_custkey").alias("source")).agg(longest("F").alias("longest_failure"), longest("O").alias("longest_ok"), F.count(F.lit(1)).alias("islands"))


@query("""
WITH run AS (SELECT o_custkey AS target, max(o_orderdate) FILTER (WHERE o_orderstatus <> 'F') AS covered FROM orders GROUP BY 1),
seen AS (SELECT o_orderkey AS id, o_custkey AS target, max(l_shipdate) AS seen FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT target, count(*) AS n, count(*) FILTER (WHERE coalesce(covered > seen + INTERVAL 36 HOUR, false)) AS unconfirmed FROM seen LEFT JOIN run USING (target) GROUP BY target
""")
def unconfirmed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A complete read that covers the offer happened over 36 hours after it was last seen."""
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    run = orders.groupBy(F.col("o_custkey").alias("target")).agg(F.max(F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate"))).alias("covered"))
    last = line.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("seen"))
    seen = orders.join(last, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("target"), "seen")
    stale = F.coalesce(F.col("covered") > F.col("seen") + F.expr("INTERVAL 36 HOURS"), F.lit(False))
    return seen.join(run, "target", "left").groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count_if(stale).alias("unconfirmed"))
