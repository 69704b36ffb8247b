"""Registry of the queries the repository answers and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardlight.catalog.views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL that must agree with it."""
    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = with_views(sql, *views) if views else sql.strip()
        return run

    return register


def r(expression: str, places: int = 4) -> str:
    """SQL text of half-even rounding."""
    factor = 10**places
    return f"round_even(({expression}) * {factor}.0::DOUBLE, 0) / {factor}.0::DOUBLE"


def flag(condition: str) -> str:
    """SQL text of a 0/1 flag that is 0 where the condition is unknown."""
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"
