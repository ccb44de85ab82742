"""Queries beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable


class Catalogue:
    def __init__(self):
        self._queries: dict[str, Callable] = {}
        self._sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Registers a function of (spark, folder) under its name; ``sql`` is the equivalent for the same tables."""

        def add(f: Callable) -> Callable:
            self._queries[f.__name__] = f
            if sql is not None:
                self._sql[f.__name__] = sql
            return f

        return add

    def queries(self) -> dict[str, Callable]:
        return dict(self._queries)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self._sql)
