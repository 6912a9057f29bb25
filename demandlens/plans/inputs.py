"""Inputs shared by the registered queries: the normalised mention view and
its SQL twin, so both engines start from the same rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from demandlens.operators.cleaning import ANALYSIS_TEXT_COLS, normalize_columns
from demandlens.plans.registry import sql_norm
from demandlens.sources.tables import mentions, mentions_sql


def analysis_input(spark: SparkSession, sf_dir: str, skill: str = "p_brand",
                   fields: Iterable[str] = ("posted_year",)) -> DataFrame:
    """The analysis table loaded with text normalisation."""
    return normalize_columns(mentions(spark, sf_dir, skill, fields))


def analysis_sql(skill: str = "p_brand", fields: Iterable[str] = ("posted_year",)) -> str:
    fields = list(fields)
    cols = ["job_id", f"{sql_norm('skill')} AS skill"]
    cols += [f"{sql_norm(f)} AS {f}" if f in ANALYSIS_TEXT_COLS else f for f in fields]
    return f"SELECT {', '.join(cols)} FROM ({mentions_sql(skill, fields)}) t"
