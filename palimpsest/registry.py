"""Every query over the given tables, by name, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import files, geometry, layout, ledger, spans, streams, translation

CATALOGS = [m.catalog for m in (ledger, translation, layout, spans, geometry, streams, files)]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for c in CATALOGS for k, f in c.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for c in CATALOGS for k, s in c.sql.items()}
