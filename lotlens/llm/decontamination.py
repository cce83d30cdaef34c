"""Benchmark decontamination: MinHash containment search, then exact shingle containment.

A test item leaks into a document if at least THRESHOLD of the item's distinct word shingles (SHINGLE words; an item of
fewer words is one shingle) occur anywhere in it. An item's sketch is its k least shingle hashes under one hash function
(bottom-k MinHash): an unbiased draw of its shingles, so the share of the sketch met in a document estimates the
containment, however long the document is.

Items are partitioned by size. Class 0 holds those up to SKETCH shingles, which are sketched whole; class c those of
SKETCH * 2^(c-1) to SKETCH * 2^c. Each class has its own k, which grows with it, and its own least number of hits: so few
that a true leak is missed with a probability below MISS, and the more a class draws, the larger the share it may ask
for, which keeps long items from being candidates wherever a common passage stands. A document probes only the items
that it has shingles enough to hold. Candidates are verified against all shingles of the item and of the document. Items
with the same shingles are looked for once.

Documents are shingled in place and probed against the sketches: nothing of them is shuffled but sketch hits. The
sketches are broadcast if their rows, counted, are within BROADCAST_ROWS, else both sides are shuffled by hash. The
second pass over the text reads the candidates' documents only.

Cases: rows with a null id are not searched under doc_id (a pipeline names rows by their text instead); null or wordless texts match nothing; rows with one id are one document;
wordless items leak nowhere; items repeated under other ids are reported under each; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .license_scan import WORD

SHINGLE = 5
THRESHOLD = 0.8
SKETCH = 24
BROADCAST_ROWS = 500_000
CLASSES, STEP = 8, 8  # size classes above the first, the last one open; rows that each adds to the sketch
MISS = 1e-6


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def shingles(words: Column, width: int) -> Column:
    """Distinct hashes of the shingles of so many words; empty if there are fewer words."""
    places = F.sequence(F.lit(0), F.size(words) - width)
    made = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]))
    return F.when(F.size(words) >= width, F.array_distinct(made)).otherwise(F.array().cast("array<bigint>"))


def item_shingles(items: DataFrame, item: str = "item_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(item, width, h, n): a row for each distinct shingle of an item, n of them."""
    words = items.select(F.col(item).alias("item"), words_of(F.col(text)).alias("w")).filter(F.size("w") > 0)
    sized = words.withColumn("width", F.least(F.size("w"), F.lit(width)))
    by_width = F.when(F.lit(False), F.array().cast("array<bigint>"))
    for k in range(1, width + 1):
        by_width = by_width.when(F.col("width") == k, shingles(F.col("w"), k))
    held = sized.withColumn("h", by_width).select("item", "width", F.size("h").alias("n"), F.explode("h").alias("h"))
    return held.dropDuplicates(["item", "width", "h"]).select("item", "width", "h", "n")


def least_hits(k: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """The most hits to ask for of k draws, so that a containment of the threshold falls short with a probability under miss."""
    below, m = 0.0, 0
    while (below := below + math.comb(k, m) * threshold**m * (1 - threshold) ** (k - m)) < miss:
        m += 1
    return m


def size_class(n: Column, size: int = SKETCH) -> Column:
    """0 for up to size shingles, then a class for each doubling."""
    c = F.lit(0)
    for k in range(CLASSES):
        c = F.when(n > size * 2**k, k + 1).otherwise(c)
    return c


def sketches(held: DataFrame, size: int = SKETCH, threshold: float = THRESHOLD) -> DataFrame:
    """(item, width, class, least, need, h): bottom-k sketches; least hits make a candidate, of documents with need shingles."""
    sized = held.withColumn("class", size_class(F.col("n"), size))
    k, least = F.lit(size), F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int")
    for c in range(1, CLASSES + 1):
        k = F.when(F.col("class") == c, size + STEP * (c - 1)).otherwise(k)
        least = F.when(F.col("class") == c, least_hits(size + STEP * (c - 1), threshold)).otherwise(least)
    by_item = sized.groupBy("item", "width", "class").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("h")).alias("s"))
    need = F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int")
    return by_item.select("item", "width", "class", least.alias("least"), need.alias("need"), F.explode(F.slice("s", F.lit(1), k)).alias("h"))


def distinct_items(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """held of one item of those with the same shingles, and (item, of): which item stands for each."""
    sets = held.groupBy("item", "width").agg(F.array_sort(F.collect_list("h")).alias("s"))
    named = sets.select("item", "width", F.sha2(F.concat_ws(",", F.transform("s", lambda x: x.cast("string"))), 256).alias("name"))
    least = named.groupBy("width", "name").agg(F.min("item").alias("of"))
    stands = cut(named.join(least, ["width", "name"]).select("item", "of"))
    return held.join(stands.filter(F.col("item") == F.col("of")).select("item"), "item", "left_semi"), stands


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def contaminated(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of each leak."""
    every = cut(item_shingles(items, item, item_text))
    n_held = every.count()
    held, stands = distinct_items(every)
    held = cut(held)
    widths = sorted(r["width"] for r in held.select("width").distinct().collect())  # five at most
    sketch = cut(sketches(held, threshold=threshold))
    n_sketch = sketch.count()
    rows = docs.filter(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    # of rows that repeat an id each may hold a part of an item, so their own sizes tell nothing
    repeated = cut(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("doc", F.lit(True).alias("again")))
    n_repeated = repeated.count()
    rows = rows.join(bounded(repeated, n_repeated), "doc", "left") if n_repeated else rows.withColumn("again", F.lit(False))

    def size(h: Column) -> Column:
        return F.when(F.col("again"), F.lit(2**31 - 1)).otherwise(F.size(h)).alias("has")

    def probes(source: DataFrame) -> DataFrame:
        """(doc, width, has, h) of the shingles of the widths that items have; has is how many the document has."""
        words = source.select("doc", "again", words_of(F.col("text")).alias("w"))
        sets = F.array(*[F.struct(F.lit(k).alias("width"), shingles(F.col("w"), k).alias("h")) for k in widths]) if len(widths) > 1 else None
        if sets is None:
            width = widths[0] if widths else SHINGLE
            one = words.select("doc", "again", shingles(F.col("w"), width).alias("s"))
            # outer: for an inner one Spark would infer a filter on the array and work it out once more for each word
            return one.select("doc", F.lit(width).alias("width"), size(F.col("s")), F.explode_outer("s").alias("h"))
        each = words.select("doc", "again", F.explode(sets).alias("s"))
        return each.select("doc", F.col("s.width").alias("width"), size(F.col("s.h")), F.explode_outer("s.h").alias("h"))

    hits = probes(rows).join(bounded(sketch, n_sketch), ["width", "h"]).filter(F.col("has") >= F.col("need")).groupBy("doc", "item").agg(F.count_distinct("h").alias("hits"), F.first("least").alias("least"))
    candidates = cut(hits.filter(F.col("hits") >= F.col("least")).select("doc", "item"))
    n_candidates = candidates.count()
    suspects = candidates.select("doc").distinct()
    again = probes(rows.join(bounded(suspects, n_candidates), "doc", "left_semi"))
    wanted = held.join(bounded(candidates.select("item").distinct(), n_candidates), "item", "left_semi")
    shared = again.join(bounded(wanted, n_held), ["width", "h"]).groupBy("doc", "item").agg(F.count_distinct("h").alias("n_shared"), F.first("n").alias("n"))
    verified = shared.join(candidates, ["doc", "item"], "left_semi").filter(F.col("n_shared") >= F.col("n") * F.lit(threshold) - 1e-9)
    alike = stands.withColumnRenamed("item", "each").withColumnRenamed("of", "item")
    verified = verified.join(bounded(alike, n_held), "item").drop("item").withColumnRenamed("each", "item")
    return verified.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("n_shared").cast("long").alias("n_shared"), F.col("n").cast("long").alias("n_shingles"), (F.col("n_shared") / F.col("n")).alias("containment"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = rf"""
WITH w AS (
  SELECT doc_id AS id, 0 AS kind, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT item_id, 1, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') FROM benchmark),
items AS (
  SELECT DISTINCT id, least(len(w), 5) AS width, unnest([array_to_string(w[i : i + least(len(w), 5) - 1], ' ') FOR i IN range(1, len(w) - least(len(w), 5) + 2)]) AS s
  FROM w WHERE kind = 1 AND len(w) > 0),
sized AS (SELECT id, width, s, count(*) OVER (PARTITION BY id) AS n FROM items),
widths AS (SELECT DISTINCT width FROM items),
docs AS (
  SELECT DISTINCT id, width, unnest([array_to_string(w[i : i + width - 1], ' ') FOR i IN range(1, len(w) - width + 2)]) AS s
  FROM w, widths WHERE kind = 0)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, any_value(i.n) AS n_shingles, count(*) / any_value(i.n) AS containment
FROM docs d JOIN sized i ON d.s = i.s AND d.width = i.width
GROUP BY d.id, i.id
HAVING count(*) >= 0.8 * any_value(i.n) - 1e-9
"""
