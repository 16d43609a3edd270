"""All queries of the library by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from velum.plans import message_queries, record_queries, table_queries, text_queries

MODULES = (text_queries, table_queries, record_queries, message_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()} | message_queries.SQL_ELSEWHERE
