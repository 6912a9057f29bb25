"""Query registry: each query is a Spark builder ``(spark, sf_dir) -> DataFrame``
plus, where SQL can express it, the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: QueryFn
    sql: str | None
    operators: str


REGISTRY: dict[str, Query] = {}


def query(name: str, operators: str, sql: str | None = None):
    """Register a query builder under ``name`` with its oracle SQL."""
    def wrap(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, operators)
        return fn
    return wrap


def rounded(df: DataFrame, cols: list[str], digits: int = 9) -> DataFrame:
    """Round double columns whose value depends on floating-point summation
    order, so engines that add in a different order agree."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


# --- SQL building blocks for the oracle side (DuckDB dialect) -------------

def sql_norm(expr: str) -> str:
    """DuckDB form of ``normalize_text``: strip whitespace both ends, lower."""
    return f"lower(regexp_replace({expr}, '^\\s+|\\s+$', '', 'g'))"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def col_round(c: Column | str, digits: int = 9) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)
