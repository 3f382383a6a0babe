"""Registration of queries with their oracles."""

from __future__ import annotations


class Registry:
    """Queries and oracle SQL by name."""

    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(function):
            self.queries[function.__name__] = function
            if sql:
                self.oracles[function.__name__] = sql
            return function

        return add
