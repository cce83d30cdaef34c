"""What to write, drop, read again or score again: merges field by field, diffs, purges, queues and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import newest, query, table
from .cars import CTES, cars, profiles
from .rules import _COUNTED, pairs, sides, totals

c = F.col
#: What is stored of each offer and what the next read brings: cards lack fields, details and surer readings have them.
_MERGE = f"""{CTES},
old AS (SELECT id, price_usd AS price, km, trim, id % 10 AS sure, id % 2 = 0 AS detail, seen AS published FROM cars),
new AS (SELECT id, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN price_usd * 0.9 ELSE price_usd END AS price, CASE WHEN id % 3 = 0 THEN NULL ELSE km + 4000 END AS km, CASE WHEN id % 5 = 0 THEN NULL ELSE 'XLT' END AS trim, id * 7 % 10 AS sure, id % 4 = 1 AS detail, seen + CAST(id % 5 - 2 AS INTEGER) AS published FROM cars)"""
_MERGED = """merged AS (
  SELECT o.id, o.price AS price_before, CASE WHEN n.price IS NOT NULL AND (o.price IS NULL OR n.published >= o.published) THEN n.price ELSE o.price END AS price,
    CASE WHEN o.detail AND NOT n.detail THEN coalesce(o.km, n.km) ELSE coalesce(n.km, o.km) END AS km, o.km AS km_before,
    CASE WHEN o.trim IS NULL OR (n.trim IS NOT NULL AND n.sure > o.sure) THEN coalesce(n.trim, o.trim) ELSE o.trim END AS trim, o.trim AS trim_before FROM old o JOIN new n ON n.id = o.id)"""
_CHANGE = "CASE WHEN price IS DISTINCT FROM price_before THEN 'price' WHEN km IS DISTINCT FROM km_before THEN 'mileage' WHEN trim IS DISTINCT FROM trim_before THEN 'attrs' END"


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing value never erases; a detail page beats a card; the surer vehicle and the newest published price win."""
    o = cars(spark, sf_dir).select("id", c("price_usd").alias("price_before"), c("km").alias("km_before"), c("trim").alias("trim_before"), (c("id") % 10).alias("sure"), (c("id") % 2 == 0).alias("detail"), c("seen").alias("published"))
    n = cars(spark, sf_dir).select(
        "id", F.when(c("id") % 4 == 1, c("price_usd") * 0.9).when(c("id") % 4 != 0, c("price_usd")).alias("p"), F.when(c("id") % 3 != 0, c("km") + 4000).alias("k"), F.when(c("id") % 5 != 0, "XLT").alias("t"),
        (c("id") * 7 % 10).alias("s"), (c("id") % 4 == 1).alias("d"), F.date_add("seen", (c("id") % 5 - 2).cast("int")).alias("at"),
    )
    price = F.when(c("p").isNotNull() & (c("price_before").isNull() | (c("at") >= c("published"))), c("p")).otherwise(c("price_before"))
    km = F.when(c("detail") & ~c("d"), F.coalesce("km_before", "k")).otherwise(F.coalesce("k", "km_before"))
    trim = F.when(c("trim_before").isNull() | (c("t").isNotNull() & (c("s") > c("sure"))), F.coalesce("t", "trim_before")).otherwise(c("trim_before"))
    return o.join(n, "id").select("id", "price_before", price.alias("price"), km.alias("km"), "km_before", trim.alias("trim"), "trim_before")


@query(f"WITH {_MERGE}, {_MERGED} SELECT id, round(price, 4) AS price, km, trim FROM merged")
def field_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select("id", F.round("price", 4).alias("price"), "km", "trim")


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    differs = lambda a: ~c(a).eqNullSafe(c(f"{a}_before"))
    return merged(spark, sf_dir).withColumn("change", F.when(differs("price"), "price").when(differs("km"), "mileage").when(differs("trim"), "attrs"))


@query(f"WITH {_MERGE}, {_MERGED} SELECT id, {_CHANGE} AS change, round(price, 4) AS price, km FROM merged WHERE {_CHANGE} IS NOT NULL")
def snapshot_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot only of what changed, under its most important change."""
    return changed(spark, sf_dir).filter("change IS NOT NULL").select("id", "change", F.round("price", 4).alias("price"), "km")


@query(f"""WITH {_MERGE}, {_MERGED}, x AS (SELECT *, {_CHANGE} AS change FROM merged)
SELECT id, 'listing_updated' AS event FROM x WHERE change IS NOT NULL UNION ALL SELECT id, 'price_drop' FROM x WHERE price < price_before
UNION ALL SELECT id, 'listing_new' FROM x WHERE price_before IS NULL AND price IS NOT NULL UNION ALL SELECT id, 'listing_gone' FROM cars WHERE status = 'gone'""")
def event_emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event of a batch: updated, cheaper, new, gone."""
    gone = cars(spark, sf_dir).select("id", (c("status") == "gone").alias("gone"))
    events = F.array_compact(F.array(F.when(c("change").isNotNull(), "listing_updated"), F.when(c("price") < c("price_before"), "price_drop"), F.when(c("price_before").isNull() & c("price").isNotNull(), "listing_new"), F.when(c("gone"), "listing_gone")))
    return changed(spark, sf_dir).join(gone, "id").select("id", F.explode(events).alias("event"))


_HALVES = "mid AS (SELECT TIMESTAMP '2024-01-16 00:00:00' AS cut), "


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events before and from the middle of the month."""
    e = table(spark, sf_dir, "events")
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return e.filter(c("ts") < cut), e.filter(c("ts") >= cut)


@query(f"""WITH {_HALVES}
old AS (SELECT user_id, event_type, max(value) AS score, min(event_id) % 2 = 0 AS is_backfill FROM events, mid WHERE ts < cut GROUP BY ALL),
new AS (SELECT user_id, event_type, max(value) AS score FROM events, mid WHERE ts >= cut GROUP BY ALL)
SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.event_type, o.event_type) AS event_type, coalesce(n.score, o.score) AS score, coalesce(o.is_backfill, false) AS is_backfill, o.user_id IS NULL AS inserted
FROM old o FULL JOIN new n ON o.user_id = n.user_id AND o.event_type = n.event_type""")
def scored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New scores over old rows; the backfill mark of an old row stays, and new rows are told."""
    old, new = halves(spark, sf_dir)
    keys = ["user_id", "event_type"]
    o = old.groupBy(keys).agg(F.max("value").alias("was"), (F.min("event_id") % 2 == 0).alias("is_backfill"))
    n = new.groupBy(keys).agg(F.max("value").alias("score"))
    return o.join(n, keys, "full").select(*keys, F.coalesce("score", "was").alias("score"), F.coalesce("is_backfill", F.lit(False)).alias("is_backfill"), c("was").isNull().alias("inserted"))


@query(f"""WITH {_HALVES}
old AS (SELECT user_id, event_type, CASE WHEN count(*) > 6 THEN 'many' ELSE 'few' END AS kind FROM events, mid WHERE ts < cut GROUP BY user_id, event_type), new AS (SELECT user_id, event_type, CASE WHEN count(*) > 6 THEN 'many' ELSE 'few' END AS kind FROM events, mid WHERE ts >= cut GROUP BY user_id, event_type)
SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.event_type, o.event_type) AS event_type, CASE WHEN n.kind IS NULL THEN 'delete' WHEN o.kind IS NULL THEN 'insert' WHEN o.kind <> n.kind THEN 'update' ELSE 'keep' END AS action FROM old o FULL JOIN new n ON o.user_id = n.user_id AND o.event_type = n.event_type""")
def pair_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to write so that stored pairs become the found ones; a pair of the same kind is left as it is."""
    kind = F.when(F.count("*") > 6, "many").otherwise("few")
    keys = ["user_id", "event_type"]
    o, n = (h.groupBy(keys).agg(kind.alias(a)) for h, a in zip(halves(spark, sf_dir), ("was", "now"), strict=True))
    return o.join(n, keys, "full").select(*keys, F.when(c("now").isNull(), "delete").when(c("was").isNull(), "insert").when(c("was") != c("now"), "update").otherwise("keep").alias("action"))


@query("""WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_type, count(*) FILTER (WHERE date_trunc('week', ts) >= date_trunc('week', now) - INTERVAL 14 DAY) AS kept, count(*) FILTER (WHERE date_trunc('week', ts) < date_trunc('week', now) - INTERVAL 14 DAY) AS purged FROM events, n GROUP BY event_type""")
def week_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole weeks go: how much of each kind is kept and purged."""
    e = table(spark, sf_dir, "events")
    old = F.date_trunc("week", "ts") < F.date_trunc("week", "now") - F.expr("INTERVAL 14 DAYS")
    return e.join(newest(e, "ts")).groupBy("event_type").agg(F.count_if(~old).alias("kept"), F.count_if(old).alias("purged"))


@query(f"""WITH {CTES}, n AS (SELECT max(seen) AS now FROM cars) SELECT id, CASE WHEN body_type IS NULL AND trim IS NULL THEN 'not_a_car' WHEN status = 'active' AND seen < now - 45 THEN 'unseen' END AS reason FROM cars, n WHERE status = 'active' AND (seen < now - 45 OR (body_type IS NULL AND trim IS NULL))""")
def soft_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active offers that end without being deleted: no cars after all, or unseen for 45 days."""
    o = cars(spark, sf_dir)
    none, old = c("body_type").isNull() & c("trim").isNull(), c("seen") < F.date_sub("now", 45)
    return o.join(newest(o, "seen")).filter((c("status") == "active") & (old | none)).select("id", F.when(none, "not_a_car").otherwise("unseen").alias("reason"))


@query("""SELECT page_id, sha256(url) AS key, sha256(coalesce(html, '')) AS content, min(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS stored_as, octet_length(encode(coalesce(html, ''))) AS n_bytes FROM pages""")
def raw_page_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages by content: each is kept once, under the first page that had it."""
    p = table(spark, sf_dir, "pages").select("page_id", F.sha2("url", 256).alias("key"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("content"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("n_bytes"))
    return p.join(p.groupBy("content").agg(F.min("page_id").alias("stored_as")), "content").select("page_id", "key", "content", "stored_as", "n_bytes")


@query(f"""WITH {CTES}, p AS (SELECT id, source, CASE WHEN price_partial THEN 0 WHEN km IS NULL THEN 1 ELSE 2 END AS tier, seen FROM cars WHERE status = 'active' AND (km IS NULL OR trim IS NULL OR price_partial))
SELECT id, source, place FROM (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY tier, seen DESC, id) AS place FROM p) WHERE place <= 20""")
def enrichment_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 20 offers of each source to read in full: doubtful prices first, then missing mileage, newest first."""
    tier = F.when(c("price_partial"), 0).when(c("km").isNull(), 1).otherwise(2)
    due = cars(spark, sf_dir).filter("status = 'active' AND (km IS NULL OR trim IS NULL OR price_partial)")
    place = F.row_number().over(W.partitionBy("source").orderBy(tier, c("seen").desc(), "id"))
    return due.select("id", "source", place.cast("long").alias("place")).filter("place <= 20")


@query(f"""WITH {CTES}, n AS (SELECT max(seen) AS now FROM cars), m AS (SELECT id, id % 3 AS version, seen, CASE WHEN id % 7 = 0 THEN NULL ELSE (id % 200) - 50.0 END AS margin FROM cars WHERE status = 'active')
SELECT id, CASE WHEN version < 2 THEN 'version' WHEN margin IS NULL THEN 'no_margin' ELSE 'implausible_margin' END AS reason FROM m, n WHERE seen >= now - 60 AND (version < 2 OR margin IS NULL OR margin NOT BETWEEN -40 AND 120)""")
def rescore_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent matches to score again: of an older version, without a margin, or with one that can't be."""
    o = cars(spark, sf_dir)
    m = o.filter("status = 'active'").select("id", (c("id") % 3).alias("version"), "seen", F.when(c("id") % 7 != 0, c("id") % 200 - 50.0).alias("margin"))
    due = (c("version") < 2) | c("margin").isNull() | ~c("margin").between(-40, 120)
    return m.join(newest(o, "seen")).filter((c("seen") >= F.date_sub("now", 60)) & due).select("id", F.when(c("version") < 2, "version").when(c("margin").isNull(), "no_margin").otherwise("implausible_margin").alias("reason"))



@query(f"""{_COUNTED}, stored AS (SELECT search, id, CAST(50 + id % 40 AS BIGINT) AS score FROM counted WHERE oks >= 2)
SELECT s.search, s.id, CASE WHEN k.fails > 0 THEN 'delete' WHEN 50 + 10 * k.oks <> s.score THEN 'update' ELSE 'keep' END AS action FROM stored s JOIN counted k ON k.search = s.search AND k.id = s.id""")
def rescore_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored matches after their searches are evaluated again: those that no longer fit go, other scores are rewritten."""
    k = pairs(*sides(spark, sf_dir), "ok2")
    return k.select("search", "id", F.when(c("fails") > 0, "delete").when(50 + 10 * c("oks") != 50 + c("id") % 40, "update").otherwise("keep").alias("action"))


@query(f"""{_COUNTED} SELECT k.search, count(*) AS n_candidates, count(*) FILTER (WHERE fails = 0) AS n_match FROM counted k JOIN profiles p ON p.search = k.search WHERE p.year_min IS NULL GROUP BY k.search""")
def rematch_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a changed search is matched with again, in one batch: here those without a least year."""
    return totals(*sides(spark, sf_dir, "year_min IS NULL")).select("search", c("n").alias("n_candidates"), "n_match")


@query(f"""{_COUNTED} SELECT k.search, k.id FROM counted k JOIN profiles p ON p.search = k.search WHERE p.make IS NULL AND p.model IS NULL AND fails = 0""")
def modelless_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offers that searches by body type alone start with."""
    return pairs(*sides(spark, sf_dir, "make IS NULL AND model IS NULL"), "match").select("search", "id")


@query(f"""{_COUNTED}, n AS (SELECT max(seen) AS now FROM cars)
SELECT k.search, count(*) AS missed FROM counted k JOIN fresh f ON f.id = k.id JOIN profiles p ON p.search = k.search, n WHERE fails = 0 AND segment = 'FURNITURE' AND f.seen > now - 30 AND f.status = 'active' AND f.repost_of IS NULL GROUP BY k.search""")
def missed_after_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches first seen after a plan's end, 30 days ago: news only, no reposts of old stock."""
    k = totals(*sides(spark, sf_dir, "segment = 'FURNITURE'", "status = 'active' AND repost_of IS NULL AND age < 30"))
    return k.filter("n_match > 0").select("search", c("n_match").alias("missed"))


@query(f"""WITH {CTES}, tiers AS (SELECT id, 0 AS tier FROM cars WHERE repost_of IS NOT NULL UNION ALL SELECT id, 1 FROM cars WHERE seller_type = 'private' AND dealer_inferred UNION ALL SELECT id, 2 FROM cars WHERE status = 'active'),
b AS (SELECT id, min(tier) AS tier FROM tiers GROUP BY id) SELECT id, tier, place FROM (SELECT b.id, tier, row_number() OVER (ORDER BY tier, seen DESC, b.id) AS place FROM b JOIN cars ON cars.id = b.id) WHERE place <= 100""")
def photo_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next hundred offers to hash: reposts, then odd sellers, then the rest, newest first. Each in its best tier."""
    o = cars(spark, sf_dir)
    tier = F.when(c("repost_of").isNotNull(), 0).when((c("seller_type") == "private") & c("dealer_inferred"), 1).when(c("status") == "active", 2)
    top = o.select("id", tier.alias("tier"), "seen").filter("tier IS NOT NULL").orderBy("tier", c("seen").desc(), "id").limit(100)
    return top.select("id", "tier", F.row_number().over(W.orderBy("tier", c("seen").desc(), "id")).cast("long").alias("place"))  # of the hundred


@query(f"""WITH {CTES}, plans AS (SELECT * FROM (VALUES ('BUILDING', 20, 'instant'), ('MACHINERY', 5, 'instant'), ('AUTOMOBILE', 2, 'daily')) AS t(segment, cap, fastest))
SELECT search, p.segment, CAST(coalesce(cap, 0) AS INTEGER) AS cap, CASE WHEN cap IS NULL THEN 'off' WHEN fastest = 'daily' OR search % 3 = 0 THEN 'daily' ELSE 'instant' END AS frequency FROM profiles p LEFT JOIN plans ON plans.segment = p.segment""")
def plan_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily cap and the frequency that a search's plan allows, no faster than what it asks."""
    plans = spark.createDataFrame([("BUILDING", 20, "instant"), ("MACHINERY", 5, "instant"), ("AUTOMOBILE", 2, "daily")], "segment string, cap int, fastest string")
    p = profiles(spark, sf_dir).join(F.broadcast(plans), "segment", "left")
    return p.select("search", "segment", F.coalesce("cap", F.lit(0)).alias("cap"), F.when(c("cap").isNull(), "off").when((c("fastest") == "daily") | (c("search") % 3 == 0), "daily").otherwise("instant").alias("frequency"))


@query("""WITH n AS (SELECT max(ts) AS now FROM events), first AS (SELECT user_id, min(ts) AS joined FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT f.user_id FROM first f, n WHERE joined < now - INTERVAL 7 DAY AND f.user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60) AND EXISTS (SELECT 1 FROM events e WHERE e.user_id = f.user_id AND e.event_type = 'view')
  AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = f.user_id AND e.event_type = 'error' AND e.ts > now - INTERVAL 1 HOUR) ORDER BY joined, f.user_id LIMIT 50""")
def ledger_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is due for a message: a week in, active, not in the ledger yet, nothing in the way; the oldest fifty."""
    e = table(spark, sf_dir, "events")
    now = newest(e, "ts")
    of = lambda t, more="true": e.filter((c("event_type") == t) & F.expr(more)).select("user_id").distinct()
    joined = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("joined")).join(now).filter(c("joined") < c("now") - F.expr("INTERVAL 7 DAYS"))
    blocked = e.filter("event_type = 'error'").join(now).filter(c("ts") > c("now") - F.expr("INTERVAL 1 HOUR")).select("user_id").distinct()
    due = joined.join(of("purchase", "value > 60"), "user_id", "left_anti").join(of("view"), "user_id", "left_semi").join(blocked, "user_id", "left_anti")
    return due.orderBy("joined", "user_id").limit(50).select("user_id")


@query(f"""WITH {CTES}, known AS (SELECT make, trim, min(seen) AS published FROM cars WHERE km IS NOT NULL GROUP BY make, trim) SELECT c.id, coalesce(CASE WHEN c.km IS NOT NULL THEN c.seen END, k.published) AS published, c.km IS NULL AND k.published IS NOT NULL AS reused FROM cars c LEFT JOIN known k ON k.make = c.make AND k.trim = c.trim""")
def publication_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An offer's date, or where it has none the known date of its make and version."""
    o = cars(spark, sf_dir)
    known = o.filter("km IS NOT NULL").groupBy("make", "trim").agg(F.min("seen").alias("published"))
    return o.join(known, ["make", "trim"], "left").select("id", F.coalesce(F.when(c("km").isNotNull(), c("seen")), "published").alias("published"), (c("km").isNull() & c("published").isNotNull()).alias("reused"))


@query("""WITH q AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id), l AS (SELECT c_custkey AS user_id, CASE c_mktsegment WHEN 'BUILDING' THEN 50 WHEN 'MACHINERY' THEN 12 ELSE 5 END AS cap FROM customer)
SELECT l.user_id, CAST(cap AS BIGINT) AS cap, coalesce(n, 0) AS n, greatest(coalesce(n, 0) - cap, 0) AS hidden FROM l LEFT JOIN q ON q.user_id = l.user_id""")
def quota_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account's limit and how much lies beyond it."""
    n = table(spark, sf_dir, "events").filter("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("n"))
    seg = c("c_mktsegment")
    l = table(spark, sf_dir, "customer").select(c("c_custkey").alias("user_id"), F.when(seg == "BUILDING", 50).when(seg == "MACHINERY", 12).otherwise(5).cast("long").alias("cap"))  # noqa: E741
    return l.join(n, "user_id", "left").select("user_id", "cap", F.coalesce("n", F.lit(0)).alias("n"), F.greatest(F.coalesce("n", F.lit(0)) - c("cap"), F.lit(0)).alias("hidden"))
