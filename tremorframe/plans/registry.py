"""Named queries: a Spark plan, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Registers a function (spark, sf_dir) under its name; ctes go before the SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = ("WITH " + ", ".join(ctes) + " " if ctes else "") + sql
        return f

    return add
