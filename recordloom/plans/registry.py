"""Queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable] = {}
        self.SQL: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f: Callable) -> Callable:
            self.QUERIES[f.__name__] = f
            if sql is not None:
                self.SQL[f.__name__] = sql
            return f

        return add
