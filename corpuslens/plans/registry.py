"""Registry of queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with SQL over the same tables if there is any."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def sql_case(column: str, values: dict[str, str]) -> str:
    """A CASE expression for a fixed table."""
    branches = " ".join(f"WHEN '{key}' THEN '{value}'" for key, value in values.items())
    return f"CASE {column} {branches} END"


def sql_list(values) -> str:
    return "(" + ", ".join(f"'{value}'" for value in values) + ")"
