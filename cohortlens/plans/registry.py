"""Query registry: each entry is (spark, root) -> DataFrame plus, where the
result is SQL-expressible, the independent SQL that must give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
HEADLINE: list[str] = []


def query(name: str, sql: str | None = None, headline: bool = False):
    """Register a query under ``name`` with optional oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        if headline:
            HEADLINE.append(name)
        return fn
    return deco


def r6(df: DataFrame, big: dict[str, int] | None = None) -> DataFrame:
    """Round floating columns to 6 digits (or per-column digits in ``big``)."""
    big = big or {}
    return df.withColumns({f.name: F.round(F.col(f.name), big.get(f.name, 6))
                           for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def load_all() -> None:
    """Import the catalog modules so their decorators run."""
    from cohortlens.plans import catalog_models, catalog_reports, catalog_rules, catalog_tables  # noqa: F401
