"""Queries of the core by name, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skarn.session import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query of a table getter under its name."""

    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            _SQL[f.__name__] = sql.strip()
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from skarn.plans import catalogue, lookups, search, values  # noqa: F401  (they register their queries)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
