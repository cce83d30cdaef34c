"""Which results a trial admits, in order of time: so many in all, and of old stock at most a part.

An attempt is a row of person, listing, at, stock (whether the listing is old stock for it: published before the search, long
ago, or found by a first read; null counts as stock). A listing is admitted once. Of two caps and no others there is nothing
to fold: stock is admitted while fewer than its cap came before it, so the stock that can come in are the first of it; what
can come in does so while fewer than the limit came before. Both are row numbers with a bound, of which Spark keeps the first
in each task before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def admitted(attempts: DataFrame, limit: int, stock_most: int | None = None) -> DataFrame:
    """(person, listing, at, stock, place) of what comes in; place from 1. Without stock_most stock has no cap of its own.

    A listing tried as stock and later as news comes in as news if stock was full. Equal times are taken by listing, of one listing as stock first. Rows
    with a null person, listing or time are no attempts.
    """
    tried = attempts.select("person", "listing", "at", F.coalesce("stock", F.lit(True)).alias("stock")).dropna(subset=["person", "listing", "at"])
    first = tried.groupBy("person", "listing").agg(F.min(F.when(F.col("stock"), F.col("at"))).alias("as_stock"), F.min(F.when(~F.col("stock"), F.col("at"))).alias("as_news"))
    stock_first = F.col("as_stock").isNotNull() & (F.col("as_news").isNull() | (F.col("as_stock") <= F.col("as_news")))
    if stock_most is None:
        early = first.filter(stock_first).select("person", "listing")
    else:
        order = Window.partitionBy("person").orderBy("as_stock", "listing")
        early = first.filter(stock_first).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= stock_most).select("person", "listing")
    known = first.join(early.withColumn("early", F.lit(True)), ["person", "listing"], "left").withColumn("early", F.coalesce("early", F.lit(False)))
    able = known.select("person", "listing", F.when(F.col("early"), F.col("as_stock")).otherwise(F.col("as_news")).alias("at"), F.col("early").alias("stock")).filter(F.col("at").isNotNull())
    place = F.row_number().over(Window.partitionBy("person").orderBy("at", "listing"))
    return able.withColumn("place", place).filter(F.col("place") <= limit)
