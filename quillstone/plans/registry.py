"""Where the plans register their queries, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, roles: bool = True) -> Callable[[Query], Query]:
    """Register a function under its own name; ``roles`` puts the role tables before its SQL."""

    def register(f: Query) -> Query:
        from quillstone.plans.roles import ROLES_SQL

        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            head, own = "WITH", body
            for start in ("WITH RECURSIVE ", "WITH "):
                if body.upper().startswith(start):
                    head, own = start.strip(), ", " + body[len(start) :]
                    break
            ORACLES[f.__name__] = f"{head} {ROLES_SQL} {own}" if roles else body
        return f

    return register
