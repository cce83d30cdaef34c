"""Least, median and most of a market's prices and mileages for each asked (group, years), without meeting its offers.

Values are counted as runs (group, kind, year, value), laid in order of (group, kind, value) over range partitions, so a
group that holds most offers is spread over many, and written with the number of their partition, their block. A block is
summed up by year: how many, least, most. What is asked joins these sums, never offers: the blocks' counts in order say in
which block the middle values are and at which place. Only there rows are looked at: a block's runs and the questions that
end in it, and a wavelet order over (year, value) answers all of them at once. Equal questions are asked once, so those of
one group and block are as many as pairs of years, whatever the searches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settled

BLOCK_ROWS = 200_000  # runs that a block has, about
OPEN_LOW, OPEN_HIGH = -1_000_000, 1_000_000  # years that bound nothing; an unknown year is under both
UNKNOWN = -2_000_000


def _kth_in_block(runs: pd.DataFrame, asked: pd.DataFrame) -> np.ndarray:
    """The value at place k (from 0) among the block's values of the years y0 to y1, for each question."""
    order = np.argsort(runs["value"].to_numpy(), kind="stable")
    value, year, n = (runs[c].to_numpy()[order] for c in ("value", "year", "n"))
    years = np.unique(year)
    low, high = np.searchsorted(years, asked["y0"].to_numpy()), np.searchsorted(years, asked["y1"].to_numpy(), side="right")
    left, right = np.zeros(len(asked), np.int64), np.full(len(asked), len(value), np.int64)
    k = asked["k"].to_numpy()
    # halves of the values in order, the counts of each by year: a question goes down the half that holds its place
    place, code = np.arange(len(value)), np.searchsorted(years, year)
    by_year = np.argsort(code, kind="stable")
    start = np.searchsorted(code[by_year], np.arange(len(years) + 1))
    sums = np.concatenate(([0], np.cumsum(n[by_year])))
    rank = place[by_year]

    def counted(upto: np.ndarray) -> np.ndarray:
        """Values of the asked years at places under upto."""
        total = np.zeros(len(upto), np.int64)
        for y in range(len(years)):
            inside = (low <= y) & (y < high)
            if inside.any():
                s, e = start[y], start[y + 1]
                at = s + np.searchsorted(rank[s:e], upto[inside])
                total[inside] += sums[at] - sums[s]
        return total

    while (left < right).any():
        middle = (left + right) // 2
        more = counted(middle + 1) > k
        right, left = np.where(more, middle, right), np.where(more, left, middle + 1)
        left = np.minimum(left, right)
    return value[np.minimum(left, len(value) - 1)]


def spreads(offers: DataFrame, asked: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(g, y0, y1, kind, n, least, median, most) for each distinct asked (g, y0, y1) and kind with a value.

    offers: g, year, price, km; any may be null but g. asked: g, y0, y1; a null bound is open, and offers of an unknown year
    count only where both are.
    """
    long = offers.select("g", F.coalesce("year", F.lit(UNKNOWN)).cast("int").alias("year"), F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("double").alias("value")) for c in ("price", "km")])).alias("x"))
    runs = settled(long.select("g", "year", "x.*").filter(F.col("value").isNotNull()).groupBy("g", "kind", "year", "value").agg(F.count(F.lit(1)).alias("n")))
    parts = max(1, -(-runs.count() // block_rows))
    laid = settled(runs.repartitionByRange(parts, "g", "kind", "value").withColumn("block", F.spark_partition_id()))
    sums = laid.groupBy("g", "kind", "block", "year").agg(F.sum("n").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    open_ = F.col("y0").isNull() & F.col("y1").isNull()
    questions = asked.select("g", F.when(open_, UNKNOWN).otherwise(F.coalesce("y0", F.lit(OPEN_LOW))).cast("int").alias("y0"), F.coalesce("y1", F.lit(OPEN_HIGH)).cast("int").alias("y1")).filter(F.col("g").isNotNull()).distinct()
    questions = settled(questions.withColumn("q", F.monotonically_increasing_id()))
    key = ["q", "g", "y0", "y1", "kind"]
    held = questions.join(sums, "g").filter(F.col("year").between(F.col("y0"), F.col("y1")))
    per = settled(held.groupBy(*key, "block").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")))
    whole = per.groupBy(*key).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy(*key))
    placed = per.withColumn("before", before).withColumn("total", total).withColumn("at", F.explode(F.array(F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2))))
    wanted = placed.filter((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("n"))).select(*key, "block", (F.col("at") - F.col("before")).alias("k"))

    def answer(key_: tuple, runs_: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"q": asked_["q"].to_numpy(np.int64), "is_price": np.full(len(asked_), key_[1] == "price"), "value": _kth_in_block(runs_, asked_) if len(asked_) else np.empty(0)})

    group = ["g", "kind", "block"]
    middle = laid.groupBy(*group).cogroup(wanted.groupBy(*group)).applyInPandas(answer, "q long, is_price boolean, value double")
    medians = middle.groupBy("q", F.when(F.col("is_price"), "price").otherwise("km").alias("kind")).agg(F.avg("value").alias("median"))  # of the two middle values
    told = whole.join(medians, ["q", "kind"])
    closed = lambda c, none: F.when(~F.col(c).isin(*none), F.col(c)).alias(c)
    return told.select("g", closed("y0", (OPEN_LOW, UNKNOWN)), closed("y1", (OPEN_HIGH,)), "kind", "n", "least", "median", "most")
