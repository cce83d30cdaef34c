"""All queries of the library, by name, with their SQL twins."""

from __future__ import annotations

from . import alerts, demand, documents, duplicates, facts, ingest, market, matching, metrics, names, news, normalize, pricing, queues, red_flags, relational, reports, rules, sources, spreads, text, titles, tracks, trials  # noqa: F401
from .base import ORACLE, QUERIES  # noqa: F401
