"""Queries with the SQL that gives the same rows, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Named queries; ``sql`` holds the equivalent DuckDB text of those that have one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Decorator: register a query under ``name``."""

        def take(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is there already")
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return take

    def join(self, other: Registry) -> None:
        """Add all queries of ``other``."""
        for name, query in other.queries.items():
            self.add(name, other.sql.get(name))(query)
