"""Listing sources by name: parsers of saved pages into rows.

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html

PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def source(name: str):
    def register(f: Callable[[DataFrame], DataFrame]):
        PARSERS[name] = f
        return f

    return register


@source("json_ld")
def from_json_ld(pages: DataFrame) -> DataFrame:
    """(page_id, url, name, price, currency) of pages (page_id, url, html) with a Product or Vehicle block."""
    block = F.coalesce(html.json_ld_of(F.col("html"), "Vehicle"), html.json_ld_of(F.col("html"), "Car"), html.json_ld_of(F.col("html"), "Product"))
    get = lambda path, kind: F.try_variant_get(F.col("b"), path, kind)
    return pages.select("page_id", "url", block.alias("b")).filter("b IS NOT NULL").select("page_id", "url", get("$.name", "string").alias("name"), get("$.offers.price", "double").alias("price"), get("$.offers.priceCurrency", "string").alias("currency"))


@source("titles")
def from_titles(pages: DataFrame) -> DataFrame:
    """(page_id, url, name) of any page with a title."""
    return pages.select("page_id", "url", F.trim(html.title(F.col("html"))).alias("name")).filter("name <> ''")


def parse(pages: DataFrame, name: str) -> DataFrame:
    return PARSERS[name](pages)


def published_day(text, seen):
    """The day that a page says it was published, as a column: relative words against the day it was seen, else a date."""
    t = F.lower(text)
    n = F.regexp_extract(t, r"hace (\d+) (?:dia|día|semana|mes)", 1).try_cast("int")
    unit = F.when(t.rlike(r"hace \d+ semana"), 7).when(t.rlike(r"hace \d+ mes"), 30).otherwise(1)
    day = F.try_to_date(F.regexp_extract(t, r"(\d{1,2}/\d{1,2}/\d{4})", 1), "d/M/yyyy")
    return F.when(t.rlike(r"\bhoy\b"), seen).when(t.rlike(r"\bayer\b"), F.date_sub(seen, 1)).when(n.isNotNull(), F.date_sub(seen, n * unit)).otherwise(day)
