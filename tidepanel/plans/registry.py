"""Collects queries with their SQL; the modules beside it fill it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from tidepanel.functions.columns import rounded

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(columns: str, sql: str | None = None, name: str | None = None):
    """Registers a function as a query (under ``name``, its own by default) with these result columns, its SQL beside it.

    ``columns``: names with a kind each, ``i`` whole number (long), ``d`` double (rounded to six decimals in both
    engines), ``s`` text, ``b`` boolean.
    """
    kinds = [c.split(":") for c in columns.split()]
    spark_column = {"i": lambda c: F.col(c).cast("long").alias(c), "d": lambda c: rounded(F.col(c).cast("double")).alias(c), "s": lambda c: F.col(c).cast("string").alias(c), "b": lambda c: F.col(c)}
    sql_column = {"i": "CAST({0} AS BIGINT) AS {0}", "d": "floor(CAST({0} AS DOUBLE) * 1000000.0 + 0.37) / 1000000.0 AS {0}", "s": "CAST({0} AS VARCHAR) AS {0}", "b": "{0}"}

    def add(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = lambda spark, d: f(spark, d).select(*(spark_column[k](c) for c, k in kinds))
        if sql:
            SQL[name or f.__name__] = f"SELECT {', '.join(sql_column[k].format(c) for c, k in kinds)} FROM ({sql}) AS result"
        return f

    return add
