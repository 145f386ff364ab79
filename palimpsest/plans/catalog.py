"""A catalogue of queries: each a function of (spark, sf_dir), with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
        """Registers the decorated function under its name; ``views``: names of the derived tables that ``sql`` reads."""

        def take(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                from ..sources import fixtures

                self.sql[f.__name__] = fixtures.with_views(views.split()) + sql
            return f

        return take
