"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lowest_hash(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """At most ``rows`` rows, those whose hash of ``columns`` is lowest. Rows
    that can hardly be among them are filtered out in the scan, so what reaches
    the final sort is bounded by ``rows``, not by the number of partitions."""
    n, top = max(1, df.count()), 1 << 40
    h = F.pmod(F.xxhash64(*columns), F.lit(top))
    below = min(top, int(top * (2 * rows + 1000) / n))
    return df.withColumn("__h", h).where(F.col("__h") < below).orderBy("__h", *columns).limit(rows).drop("__h")


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int,
                    where: Column | None = None) -> DataFrame:
    """(text, target) of at most ``rows`` labelled documents, those whose
    doc_id hashes lowest. The id list is bounded by ``rows``, so it is
    broadcast; a document labelled more than once takes its highest label."""
    truth = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull())
    if where is not None:
        truth = truth.where(where)
    ids = lowest_hash(truth.groupBy("doc_id").agg(F.max(target).cast("long").alias("target")), rows, "doc_id")
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "target")
