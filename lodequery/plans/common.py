"""The register that each module of queries keeps."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Queries by name and the SQL twins of those that have one."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add
