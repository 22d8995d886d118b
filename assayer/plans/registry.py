"""The registry of queries and their SQL forms; the catalogs fill it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.views import Tables

Query = Callable[[Tables], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in REGISTRY:
            raise ValueError(f"{key} is registered twice")
        REGISTRY[key] = (f, sql)
        return f

    return add
