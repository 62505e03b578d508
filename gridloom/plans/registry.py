"""All queries of the analytics engine, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    import gridloom.plans.audit_queries  # noqa: F401
    import gridloom.plans.chain_queries  # noqa: F401
    import gridloom.plans.covariance_queries  # noqa: F401
    import gridloom.plans.detail_queries  # noqa: F401
    import gridloom.plans.facility_queries  # noqa: F401
    import gridloom.plans.firm_queries  # noqa: F401
    import gridloom.plans.fit_queries  # noqa: F401
    import gridloom.plans.join_queries  # noqa: F401
    import gridloom.plans.model_queries  # noqa: F401
    import gridloom.plans.rollup_queries  # noqa: F401
    import gridloom.plans.series_queries  # noqa: F401
    import gridloom.plans.source_queries  # noqa: F401
    import gridloom.plans.stream_queries  # noqa: F401
