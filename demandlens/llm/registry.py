"""Registered queries of the operators: each applies one with production
parameters to its whole table and returns the full result."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, infill, jaccard, licenses, linededup, pii, quality, suffixdedup, tokencount, toxicity, urlrules, whitening

BATCH_BYTES = "8m"
Query = Callable[[SparkSession, str], DataFrame]


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it (for
    sessions not started with it on their PYTHONPATH or among their --py-files),
    and hand them batches of bounded bytes, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rank_file(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[bytes, str]:
    """Content of a public tokenizer's file and its split pattern."""
    import public_tokenizers
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), *rank_file())


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_report(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(_table(spark, sf_dir, "pages"), urlrules.rules_frame(spark))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.report(_table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.report(_table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(_table(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), *rank_file("byte_bpe_50k.json"))


_QUERIES: list[Query] = [op1_toxicity, op2_license_scan, op3_byte_bpe, op4_ngram_jaccard_join, op5_quality_rules, op6_decontamination, op7_line_dedup, op8_pii, op9_url_filters,
                         op10_suffix_array_dedup, op11_fill_in_middle, op12_embedding_whitening, op13_token_counts]


def _prepared(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(importable(spark), sf_dir)
    return run


def queries() -> dict[str, Query]:
    return {f.__name__: _prepared(f) for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_jaccard_join": jaccard.ORACLE_SQL, "op6_decontamination": decontaminate.ORACLE_SQL,
            "op9_url_filters": urlrules.ORACLE_SQL, "op10_suffix_array_dedup": suffixdedup.ORACLE_SQL,
            "op11_fill_in_middle": infill.ORACLE_SQL}
