"""Registering queries: a name, a function of (spark, sf_dir), and SQL for the same rows if SQL can express it."""

from __future__ import annotations

from collections.abc import Callable


class Book:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add
