"""Structured Streaming forms: deduplication, windows, keyed alert caps, ingest batches.

State is keyed and bounded by watermarks or by the day it counts, so it doesn't grow with the age of the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import merge

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
SENT = "event_id long, user_id long, day string, decision string, n long"


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, so many files a batch."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def first_of_key(events: DataFrame, keys: list[str], late: str = "30 days") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, width: str = "7 days", slide: str | None = None, start: str | None = None, late: str = "2 days") -> DataFrame:
    """Counts and means by window; weeks that begin on Monday at 0:00 of UTC-3 by default, other widths and slides at 0:00 of UTC-3."""
    weeks = width == "7 days" and slide is None
    w = F.window("ts", width, slide or width, start or ("4 days 3 hours" if weeks else "3 hours"))
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def capped_alerts(events: DataFrame, cap: int = 3, late: str = "1 day") -> DataFrame:
    """send or digest for each event: a user gets so many a day, in the order (time, id) within a batch.

    State is one count for each user and day, so an event of an earlier day that comes late counts under its own day; it
    ends two days after the watermark has passed the day's last event.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last = state.get if state.exists else (0, 0)
        rows = pd.concat([f[["event_id", "ts"]] for f in frames]).sort_values(["ts", "event_id"])
        place = n + np.arange(1, len(rows) + 1)
        last = max(last, int(rows["ts"].iloc[-1].timestamp() * 1000), state.getCurrentWatermarkMs())
        state.update((int(place[-1]), last))
        state.setTimeoutTimestamp(last + 2 * 24 * 3600 * 1000)
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "user_id": key[0], "day": key[1], "decision": np.where(place <= cap, "send", "digest"), "n": place})

    day = F.date_format(F.col("ts") - F.expr("INTERVAL 3 HOURS"), "yyyy-MM-dd")
    timed = events.withWatermark("ts", late).withColumn("day", day)
    return timed.groupBy("user_id", "day").applyInPandasWithState(step, SENT, "n long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def muted(batch: DataFrame, number: int, published: str = "ts", news: str = "30 days") -> DataFrame:
    """The batch with whether its rows are to be told of: never those of the first batch, which is the stock as it was found,
    nor those published long before the batch's newest."""
    newest = batch.agg(F.max(published).alias("__newest"))
    old = F.col(published) < F.col("__newest") - F.expr(f"INTERVAL {news}")
    return batch.join(F.broadcast(newest)).withColumn("muted", F.lit(number == 0) | F.coalesce(old, F.lit(True))).drop("__newest")


def upsert_stream(batches: DataFrame, path: str, keys: list[str], order: list[str], tracked: list[str], checkpoint: str, keep: int = 2):
    """Keeps the table of a folder up to date: each batch is merged and written as a new version, its changes beside it.

    A batch's number names its version, so a batch that is run again writes the same. A batch whose predecessor's version is
    missing fails: it would start the table anew. Of the versions the last ones are kept. Where the batches have a column
    `complete`, the watermark file (the newest of the first order column) moves only with batches that are complete in
    every row; the others are merged as well.
    """
    root = path.rstrip("/")

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.drop("complete")
        before = f"{root}/version={number - 1}"
        if number and not _exists(spark, before):
            raise FileNotFoundError(f"{before}: batch {number} needs the version before it")
        current = spark.read.parquet(before) if number else rows.limit(0)
        merged = merge.upsert(current, rows, keys, order, tracked).persist()
        try:
            merged.drop("change").write.mode("overwrite").parquet(f"{root}/version={number}")
            merged.filter("change IS NOT NULL").write.mode("overwrite").parquet(f"{root}_changes/batch={number}")
        finally:
            merged.unpersist()
        whole = "complete" not in batch.columns or batch.filter(~F.coalesce("complete", F.lit(False))).limit(1).count() == 0
        if whole:
            rows.agg(F.max(order[0]).alias("covered_until")).write.mode("overwrite").parquet(f"{root}_watermark")
        if number >= keep:
            _remove(spark, f"{root}/version={number - keep}")

    return batches.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _path(spark: SparkSession, path: str) -> tuple:
    """The path's own file system, whichever it is, and the path in it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    store, p = _path(spark, path)
    return store.exists(p)


def _remove(spark: SparkSession, path: str) -> None:
    store, p = _path(spark, path)
    store.delete(p, True)
