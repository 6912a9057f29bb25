"""Distinct counts of many columns.

Exact: every row gives (column, value) once a column; a first aggregate by both
leaves each distinct value once, tasks reducing theirs before the shuffle, and a
second one counts them. All columns share one scan and two shuffles of single
values, where a countDistinct per column copies whole rows.

Sketches: a HyperLogLog sketch per group and column is a few KB and merges with
others, so years written one by one give any span of years without a new scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sketches have 2^LG_K registers; their standard error is 1.04 / sqrt(2^LG_K), 0.8 %.
LG_K = 14


def _text(df: DataFrame, c: str) -> Column:
    """A value as text, one text for what counts as one value."""
    kind = dict(df.dtypes)[c]
    if kind in ("double", "float"):
        return (F.col(f"`{c}`") + F.lit(0.0)).cast("string")  # -0.0 is 0.0
    if kind == "binary":
        return F.hex(f"`{c}`")
    if kind.startswith(("array", "struct", "map", "variant")):
        return F.to_json(F.struct(F.col(f"`{c}`")))
    return F.col(f"`{c}`").cast("string")


def _values(df: DataFrame, cols: Sequence[str], *keys: str) -> DataFrame:
    """(keys, at, value): a row for each of the columns."""
    pairs = F.array(*[F.struct(F.lit(i).alias("at"), _text(df, c).alias("value")) for i, c in enumerate(cols)])
    return df.select(*keys, F.explode(pairs).alias("v")).select(*keys, "v.*")


def distinct_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, rows, nulls, distinct) for each column, exact."""
    values = _values(df, cols, *by).groupBy(*by, "at", "value").agg(F.count(F.lit(1)).alias("n"))
    out = values.groupBy(*by, "at").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
                                        F.count("value").alias("distinct"))
    names = F.array(*[F.lit(c) for c in cols])
    return out.select(*by, F.element_at(names, F.col("at") + 1).alias("column"), "rows", "nulls", "distinct")


def sketches(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), lg_k: int = LG_K) -> DataFrame:
    """(by, column, rows, sketch): mergeable sketches of the distinct values."""
    values = _values(df, cols, *by).groupBy(*by, "at").agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg("value", lg_k).alias("sketch"))
    names = F.array(*[F.lit(c) for c in cols])
    return values.select(*by, F.element_at(names, F.col("at") + 1).alias("column"), "rows", "sketch")


def merged(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of coarser groups from finer ones, without the data."""
    return parts.groupBy(*by, "column").agg(F.sum("rows").alias("rows"), F.hll_union_agg("sketch").alias("sketch"))


def estimates(parts: DataFrame) -> DataFrame:
    """The sketches' estimates of the distinct values."""
    return parts.withColumn("distinct", F.hll_sketch_estimate("sketch")).drop("sketch")
