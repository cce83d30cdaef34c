"""Fields of saved HTML pages as column expressions: title, links, JSON-LD blocks, visible text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title(html: Column) -> Column:
    return F.regexp_extract(html, "<title>([^<]*)</title>", 1)


def language(html: Column) -> Column:
    return F.regexp_extract(html, '<html lang="([a-z]+)"', 1)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))


def json_ld(html: Column) -> Column:
    """The bodies of all JSON-LD blocks as variants; what doesn't parse is null."""
    bodies = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    return F.transform(bodies, F.try_parse_json)


def json_ld_of(html: Column, kind: str) -> Column:
    """The first JSON-LD block of a type."""
    return F.get(F.filter(json_ld(html), lambda v: F.try_variant_get(v, "$['@type']", "string") == kind), F.lit(0))


def visible(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, "(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
