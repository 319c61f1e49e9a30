"""Named queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, casts: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``casts`` ("column TYPE, ...") sets types the SQL would widen."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql if casts is None else _cast(sql, casts)
        return fn

    return register


def _cast(sql: str, casts: str) -> str:
    pairs = [pair.split() for pair in casts.split(",")]
    replaced = ", ".join(f"CAST({column} AS {kind}) AS {column}" for column, kind in pairs)
    return f"SELECT * REPLACE ({replaced}) FROM ({sql})"
