"""Named queries and their SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.bridge import with_relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, relations: str = "", recursive: bool = False):
    """Registers a query. `sql` gives the same rows over the star-schema tables and the named relations."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_relations(relations, sql, recursive)
        return f

    return add
