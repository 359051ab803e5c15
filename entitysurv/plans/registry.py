"""query name -> (Spark query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers f(spark, sf_dir) under its name, without a leading q_; sql gives the same rows in DuckDB."""

    def add(f):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add
