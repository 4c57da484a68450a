"""A small decorator that pairs a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def wrap(function: Callable) -> Callable:
            self.queries[name] = function
            if sql is not None:
                self.oracle[name] = sql
            return function

        return wrap
