"""Registry of named queries: a function of ``Views`` and, where SQL can say it, the same as a DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larder.plans.views import Views, with_views
from larder.runtime import ship

_QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its oracle."""

    def keep(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def _load() -> None:
    from larder.plans import functions_catalog, health_catalog, matching_catalog, search_catalog, tables_catalog  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bound(f: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(Views(spark, sf_dir))

        return run

    return {name: bound(f) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: with_views(sql) for name, sql in _SQL.items()}
