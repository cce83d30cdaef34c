"""Pages read through the library's own data source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.pages import ListingPages, coverage
from .base import query


@query(r"""
WITH p AS (SELECT lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS source, coalesce(html, '') AS html FROM pages)
SELECT source, count(*) AS pages, count(*) FILTER (WHERE regexp_matches(html, '<title>[^<]*</title>')) AS titled, CAST(sum(len(regexp_extract_all(html, '<a href="'))) AS BIGINT) AS links,
  count(*) FILTER (WHERE regexp_matches(html, '(?i)"availability": ?"https?://schema.org/(discontinued|soldout|outofstock)"')) AS gone, bool_and(ends_with(rtrim(html, chr(10) || chr(9) || chr(13) || ' '), '</html>')) AS complete
FROM p GROUP BY source
""")
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch read got of each source, and whether the read was complete."""
    spark.dataSource.register(ListingPages)
    return coverage(spark.read.format("listing_pages").option("path", f"{sf_dir}/pages.parquet").load())
