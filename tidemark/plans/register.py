"""A registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    """(queries, oracles, decorator): the decorator registers a function under its name, with its SQL if any."""
    queries: dict = {}
    oracles: dict = {}

    def query(sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query


#: Added before rounding sums, so that decimals that end in 5 don't sit on a boundary.
OFF_TIES = 0.0000012345
