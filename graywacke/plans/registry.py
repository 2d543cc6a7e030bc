"""The registered queries of the library, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Adds a query (spark, sf_dir) -> DataFrame under a name, and the SQL for the same rows where there is one."""

    def add(query: Query) -> Query:
        _QUERIES[name] = query
        if sql:
            _SQL[name] = sql
        return query

    return add


def _load() -> None:
    from graywacke.plans import audit_queries, heartbeat_queries, log_queries, manuscript_queries, model_queries, pooling_queries, regression_queries, report_queries, revision_queries, robust_queries, shape_queries, signal_queries, statistics_queries, choice_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
