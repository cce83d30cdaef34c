"""Price tracks on values that a division can't take."""

from pyspark.sql import functions as F


def test_price_track_from_zero(spark, tmp_path):
    """A first price of zero has no percentage that is finite; SQL's is minus infinity, or no number."""
    from lotlens.plans.registry import QUERIES

    rows = [(1, "2024-01-01 00:00:00", 7, "view", 0.0), (2, "2024-01-02 00:00:00", 7, "click", 5.0), (3, "2024-01-01 00:00:00", 8, "view", 0.0), (4, "2024-01-01 00:00:00", 9, "view", 4.0), (5, "2024-01-02 00:00:00", 9, "view", 3.0)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    got = {x["id"]: x["cum_pct"] for x in QUERIES["price_track"](spark, str(tmp_path)).collect()}
    assert got[7] == float("-inf") and got[8] != got[8] and got[9] == 25.0
