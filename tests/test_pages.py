"""The data source of saved pages: batch and stream agree with a plain parse."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lotlens.sources import pages

BLOCK = '<html lang="es"><title>x</title><script type="application/ld+json">%s</script></html>'
ODD = [
    (1, "https://Shop.example.com:80/a?b", BLOCK % '{"@type": "Car", "name": "Gol", "offers": {"price": "9000", "priceCurrency": "USD", "availability": "https://schema.org/SoldOut"}}'),
    (2, "https://user@shop.example.com/b", BLOCK % "not json"),
    (3, None, None),
    (4, "no address", "<title>cut"),
    (None, "http://other.example/", '<html><a href="1"><a href="2"></html>  '),
    (5, "http://other.example/", BLOCK % '[1]' + "x"),
    (6, "http://x.example", (BLOCK % '{"@type": "Product", "name": 5, "offers": []}').replace("</html>", BLOCK % '{"@type": "Vehicle", "name": "Polo", "offers": {"price": true}}')),
]


def write(path, rows, size=2):
    table = pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": pa.array([r[1] for r in rows], pa.string()), "html": pa.array([r[2] for r in rows], pa.string()), "source": pa.array(["clash"] * len(rows))})
    pq.write_table(table, path, row_group_size=size)


@pytest.fixture
def fmt(spark):
    spark.dataSource.register(pages.ListingPages)
    return "listing_pages"


def plain(rows, only=None):
    return sorted((pages.parsed(*r) for r in rows if only is None or pages.host(r[1]) == only), key=repr)


def test_what_a_page_says():
    assert pages.parsed(*ODD[0]) == ("shop.example.com", 1, ODD[0][1], "x", "es", 0, "Gol", 9000.0, "USD", True, True)
    assert pages.parsed(*ODD[2]) == ("", 3, None, None, None, 0, None, None, None, False, False)
    assert pages.parsed(*ODD[6])[6:9] == ("Polo", None, None)


def test_batch_is_a_plain_parse(spark, fmt, tmp_path):
    write(tmp_path / "a.parquet", ODD)
    read = lambda: spark.read.format(fmt).option("path", str(tmp_path))
    assert sorted(map(tuple, read().load().collect()), key=repr) == plain(ODD)
    assert read().load().rdd.getNumPartitions() == 4
    assert sorted(map(tuple, read().option("source", "other.example").load().collect()), key=repr) == plain(ODD, "other.example")
    got = {r.source: (r.pages, r.complete) for r in pages.coverage(read().load()).collect()}
    assert got == {"shop.example.com": (2, True), "": (2, False), "other.example": (2, False), "x.example": (1, True)}
    empty = tmp_path / "none"
    empty.mkdir()
    assert spark.read.format(fmt).option("path", str(empty)).load().collect() == []


def test_stream_goes_on_from_its_offset(spark, fmt, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        stream = spark.readStream.format(fmt).option("path", str(folder)).option("groups", 3).load()
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).start(str(tmp_path / "out"))
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(map(tuple, spark.read.schema(pages.SCHEMA).parquet(str(tmp_path / "out")).collect()), key=repr), q.recentProgress

    write(folder / "a.parquet", ODD)
    got, progress = run()
    assert got == plain(ODD) and len([p for p in progress if p.numInputRows]) == 2
    more = [(100 + k, f"https://late.example/{k}", BLOCK % "{}") for k in range(5)]
    write(folder / "0-before.parquet", more)
    assert run()[0] == plain(ODD + more)
    assert run()[0] == plain(ODD + more)
