"""Registered queries: each reads the given tables and has an SQL counterpart where SQL can express it."""

from __future__ import annotations

from importlib import import_module

from plangauge.catalog.base import Catalog, Query
from plangauge.session import configure

MODULES = ("sources", "tpch", "plans", "scoring", "benchmarks", "series", "text", "streams")


def _configured(query: Query) -> Query:
    """The query on a session that has the settings it relies on."""
    return lambda spark, directory: query(configure(spark), directory)


def all_queries() -> Catalog:
    whole = Catalog()
    for name in MODULES:
        whole.merge(import_module(f"plangauge.catalog.{name}").CATALOG)
    whole.queries = {key: _configured(query) for key, query in whole.queries.items()}
    return whole
