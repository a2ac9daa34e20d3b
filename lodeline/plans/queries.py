"""Registered queries of the core operators, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

MAIN = "sva_dom_edu_wraps_head"

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows."""

    def keep(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Round the named columns to six decimals, for comparison."""
    return df.select(*[F.round(F.col(c).cast("double"), 6).alias(c) if c in names else F.col(c) for c in df.columns])


def _load() -> None:
    from . import compare_queries, crosswalk_queries, guard_queries, label_queries, mine_queries, model_queries, prepare_queries, relational_queries, serve_queries, vector_queries  # noqa: F401


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return queries()["class_movement_two_periods"](spark, d)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
