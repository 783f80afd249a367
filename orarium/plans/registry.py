"""Registers queries with the DuckDB statement that each is compared with."""

from __future__ import annotations

from collections.abc import Callable


def register(queries: dict, oracles: dict) -> Callable:
    """query(sql): puts a function under its own name, and its statement beside it where there is one."""

    def query(sql: str | None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return query
