"""Shared pieces of the registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plangauge.sources.standins import standin, with_views
from plangauge.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalog:
    """Queries by key, with the SQL that must give the same rows."""

    queries: dict[str, Query] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def add(self, key: str, query: Query, views: tuple[str, ...] = (), sql: str | None = None) -> None:
        self.queries[key] = query
        if sql is not None:
            prefix = with_views(*views) if views else ""
            # a body that brings its own CTEs continues the list
            if prefix and sql.lstrip().upper().startswith("WITH RECURSIVE "):
                sql = prefix.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + sql.lstrip()[15:]
            elif prefix and sql.lstrip().upper().startswith("WITH "):
                sql = prefix.rstrip() + ",\n" + sql.lstrip()[5:]
            else:
                sql = prefix + sql
            self.oracles[key] = sql

    def query(self, key: str, views: tuple[str, ...] = (), sql: str | None = None):
        """Decorator form of :meth:`add`."""

        def register(function: Query) -> Query:
            self.add(key, function, views, sql)
            return function

        return register

    def merge(self, other: "Catalog") -> None:
        self.queries.update(other.queries)
        self.oracles.update(other.oracles)


def tables(spark: SparkSession, directory: str, *names: str) -> dict[str, DataFrame]:
    """Typed relations by name; ``partsupp`` is derived."""
    return {n: standin(spark, directory, n) if n == "partsupp" else read_table(spark, directory, n) for n in names}


def plain(df: DataFrame, digits: int = 6, **by_name: int) -> DataFrame:
    """Rounded doubles and 64-bit counts, so that engines can be compared value by value."""
    out = []
    for f in df.schema.fields:
        column = F.col(f.name)
        if isinstance(f.dataType, (T.DecimalType, T.DoubleType, T.FloatType)):
            column = F.round(column, by_name.get(f.name, digits)).cast("double")
            column = F.when(column == 0, F.lit(0.0)).otherwise(column)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("long")
        out.append(column.alias(f.name))
    return df.select(*out)
