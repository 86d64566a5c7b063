"""Named queries, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable


class Catalogue:
    """Collects queries and their SQL under one name."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            key = name or f.__name__
            self.queries[key] = f
            if sql:
                self.sql[key] = sql
            return f

        return add

    def also_named(self, suffix: str, *queries: Callable) -> None:
        """A second name for each query, under which users may know it."""
        for f in queries:
            self.query(self.sql[f.__name__], f.__name__ + suffix)(f)
