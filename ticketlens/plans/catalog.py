"""Registry of named queries: a Spark builder plus, where SQL can say it, DuckDB SQL.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole driver tables; the SQL text runs in DuckDB over the same tables
(registered as views) and must give the same rows and column names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def load_all() -> dict[str, Query]:
    """Import every plan module so its queries register themselves."""
    from . import (  # noqa: F401
        columns_queries,
        extra_queries,
        file_queries,
        impute_queries,
        issue_queries,
        linear_queries,
        model_queries,
        nested_queries,
        null_group_queries,
        project_queries,
        stats_queries,
    )
    return REGISTRY
