"""All registered queries of the library proper, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "caller_rollup"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def load() -> None:
    """Import the modules that register queries."""
    from tallyhawk.plans import queries_assess, queries_callers, queries_estate, queries_files, queries_findings, queries_history, queries_logs, queries_scans, queries_texts  # noqa: F401
