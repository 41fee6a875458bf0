"""Named queries with their DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallylog.session import configure
from workload.tables import TABLES, table_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_tables(sql: str, *names: str) -> str:
    """Prefix DuckDB SQL with the derived tables it uses."""
    parts = [f"{name} as ({table_sql(name, 'duckdb')})" for name in names]
    sql = sql.strip()
    if not parts:
        return sql
    if sql.lower().startswith("with recursive "):
        return f"with recursive {', '.join(parts)}, {sql[15:]}"
    if sql.lower().startswith("with "):
        return f"with {', '.join(parts)}, {sql[5:]}"
    return f"with {', '.join(parts)} {sql}"


def query(name: str, sql: str | None = None, tables: tuple[str, ...] = ()):
    """Register a query; ``sql`` may use the derived tables named in ``tables``."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(configure(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(sql, *tables)
        return build

    assert all(t in TABLES for t in tables)
    return register
