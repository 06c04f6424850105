"""All registered queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if it has any."""

    def register(run: Query) -> Query:
        name = run.__name__.rstrip("_")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


from . import arrays, expressions, extras, facade, stores  # noqa: E402, F401 - they register themselves
