"""Streams run to their end against the same thing in batch."""

import datetime
import os
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lotlens.streaming import events as E


@pytest.fixture()
def folder(spark, data, tmp_path):
    spark.read.parquet(f"{data}/events.parquet").repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def drained(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_windows(spark, folder, data, tmp_path):
    got = drained(E.windowed(E.read_events(spark, folder)), "weeks", tmp_path, "complete")
    batch = E.windowed(spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_dedupe(spark, folder, data, tmp_path):
    got = drained(E.first_of_key(E.read_events(spark, folder, 4), ["user_id", "event_type"]), "firsts", tmp_path)
    want = spark.read.parquet(f"{data}/events.parquet").select("user_id", "event_type").distinct().count()
    assert got.count() == want == got.select("user_id", "event_type").distinct().count()


def test_alert_caps(spark, folder, data, tmp_path):
    got = drained(E.capped_alerts(E.read_events(spark, folder, 4)), "alerts", tmp_path)
    day = F.date_format(F.col("ts").cast("timestamp") - F.expr("INTERVAL 3 HOURS"), "yyyy-MM-dd")
    n = spark.read.parquet(f"{data}/events.parquet").groupBy("user_id", day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    want = {(r["user_id"], r["day"]): min(3, r["n"]) for r in n.collect()}
    sent = {(r["user_id"], r["day"]): r["k"] for r in got.filter("decision = 'send'").groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("k")).collect()}
    assert sent == want


def test_upsert_stream(spark, tmp_path):
    schema = "k string, price double, seq int"
    for i, rows in enumerate(([("a", 1.0, 1), ("b", 2.0, 1)], [("a", 3.0, 2), ("c", None, 2)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    (tmp_path / "drop").mkdir()
    for i in range(2):
        part = next(Path(tmp_path / f"in{i}").glob("part-*.parquet"))
        shutil.copy(part, tmp_path / "drop" / f"{i}.parquet")
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "drop"))
        E.upsert_stream(stream, str(tmp_path / "table"), ["k"], ["seq"], ["price"], str(tmp_path / "ck")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "table/version=1")).select("k", "price").collect()))
    assert got == [("a", 3.0), ("b", 2.0), ("c", None)]
    changes = sorted((r["k"], r["change"]) for r in spark.read.parquet(str(tmp_path / "table_changes/batch=1")).collect())
    assert changes == [("a", "price"), ("c", "new")]


def feed(spark, tmp_path, name, schema, parts):
    """A stream of one file a batch, in this order."""
    folder = tmp_path / name
    folder.mkdir()
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}{i}"))
        part = next(Path(tmp_path / f"{name}{i}").glob("part-*.parquet"))
        shutil.copy(part, folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + i * 60,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_late_days_count_under_their_own_day(spark, tmp_path):
    t = lambda d, h: datetime.datetime(2024, 1, d, h)
    parts = [[(1, t(2, 12), 7), (2, t(2, 13), 7)], [(3, t(3, 12), 7)], [(4, t(2, 14), 7), (5, t(2, 15), 7), (6, t(3, 13), 7)]]
    stream = feed(spark, tmp_path, "late", "event_id long, ts timestamp, user_id long", parts)
    got = {r["event_id"]: (r["day"], r["n"], r["decision"]) for r in drained(E.capped_alerts(stream, late="3 days"), "late_alerts", tmp_path).collect()}
    assert got == {1: ("2024-01-02", 1, "send"), 2: ("2024-01-02", 2, "send"), 3: ("2024-01-03", 1, "send"), 4: ("2024-01-02", 3, "send"), 5: ("2024-01-02", 4, "digest"), 6: ("2024-01-03", 2, "send")}


def test_incomplete_batches_and_lost_versions(spark, tmp_path):
    schema = "k string, price double, seq int, complete boolean"
    parts = [[("a", 1.0, 1, True)], [("a", 2.0, 2, True), ("b", 1.0, 2, False)], [("c", 1.0, 3, True)], [("c", 4.0, 4, None)]]
    table, ck = str(tmp_path / "t"), str(tmp_path / "tck")
    run = lambda: E.upsert_stream(feed_once, table, ["k"], ["seq"], ["price"], ck).awaitTermination()
    feed_once = feed(spark, tmp_path, "whole", schema, parts)
    run()
    assert sorted(map(tuple, spark.read.parquet(f"{table}/version=3").select("k", "price").collect())) == [("a", 2.0), ("b", 1.0), ("c", 4.0)]
    assert spark.read.parquet(f"{table}_watermark").first()["covered_until"] == 3
    assert sorted(p.name for p in Path(table).iterdir()) == ["version=2", "version=3"]
    shutil.rmtree(f"{table}/version=3")
    shutil.copy(tmp_path / "whole" / "3.parquet", tmp_path / "whole" / "4.parquet")
    with pytest.raises(Exception, match="needs the version before it"):
        run()


def test_first_batch_and_old_stock_are_muted(spark):
    t = lambda d: datetime.datetime(2024, 3, 1) - datetime.timedelta(days=d)
    batch = spark.createDataFrame([(1, t(0)), (2, t(29)), (3, t(31)), (4, None)], "id long, ts timestamp")
    assert all(r["muted"] for r in E.muted(batch, 0).collect())
    assert {r["id"]: r["muted"] for r in E.muted(batch, 1).collect()} == {1: False, 2: False, 3: True, 4: True}


def test_sliding_windows(spark, folder, data, tmp_path):
    got = drained(E.windowed(E.read_events(spark, folder), "7 days", "1 day"), "sliding", tmp_path, "complete")
    days = spark.read.parquet(f"{data}/events.parquet").count()
    assert sum(r["n"] for r in got.collect()) == 7 * days
