"""Readers and writers (S1-S13): typed CSV input, load-or-empty, writers,
materialised intermediates in the shared checkpoint folder, and the ordered
first-n sample."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from demandlens.session import checkpoint_dir, remove_tables

# The encodings tried for text input, in order.
ENCODINGS = ("utf-8", "latin-1")
SPARK_NAMES = {"latin-1": "ISO-8859-1"}


def read_csv_typed(spark: SparkSession, path: str, schema: StructType | str,
                   encoding: str = ENCODINGS[0]) -> DataFrame:
    """CSV with a header and an explicit schema (ids stay strings;
    no inference pass over the data). The caller picks the encoding."""
    return (spark.read.option("header", True).option("encoding", SPARK_NAMES.get(encoding, encoding))
            .option("mode", "PERMISSIVE").schema(schema).csv(path))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def read_csv_any(spark: SparkSession, path: str, schema: StructType | str, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """The first encoding in which no line of the files holds a broken
    character (U+FFFD, what a decoder puts for one)."""
    for encoding in encodings[:-1]:
        lines = spark.read.option("encoding", SPARK_NAMES.get(encoding, encoding)).option("sep", "\u0001").option("quote", "").csv(path, schema="line string")
        if not lines.filter(F.contains("line", F.lit("\ufffd"))).limit(1).count():
            return read_csv_typed(spark, path, schema, encoding)
    return read_csv_typed(spark, path, schema, encodings[-1])


def load_validation(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "csv") -> DataFrame:
    """The validation table, which must exist."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"no validation table at {path}")
    return read_csv_typed(spark, path, schema) if fmt == "csv" else spark.read.schema(schema).format(fmt).load(path)


def load_or_empty(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet") -> DataFrame:
    """Load a table, or an empty frame with the expected columns when
    the path does not exist."""
    if _exists(spark, path):
        return spark.read.schema(schema).format(fmt).option("header", True).load(path)
    return spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Overwrite a table; Parquet internally, CSV with a header at
    the BI edge."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def bi_text_columns(df: DataFrame, fill: dict[str, str] | None = None) -> DataFrame:
    """Period and numeric columns as text, blanks filled, for CSV export."""
    fill = fill or {"posted_year_label": "Not Specified", "experience_level": "Not Specified"}
    out = df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t not in ("string",)})
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items() if c in out.columns})


def fingerprint(df: DataFrame) -> str:
    """What a plan reads and computes: its input files with their sizes and
    times, and the optimised plan without the numbers of its columns."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    parts = []
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        parts.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().optimizedPlan().toString())
    return hashlib.sha256("\n".join([*parts, plan]).encode()).hexdigest()[:16]


def materialize(df: DataFrame, name: str, reuse: bool = True) -> DataFrame:
    """Write an intermediate once to the shared checkpoint folder and read
    it back (cuts the lineage, so a lost executor never recomputes upstream
    joins); with ``reuse`` an existing copy of the same name, made by the same
    plan from the same files, is read as is."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "tables", f"{name}-{fingerprint(df)}")
    if not (reuse and _exists(spark, os.path.join(path, "_SUCCESS"))):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def first_n(df: DataFrame, n: int, ordinal: str) -> DataFrame:
    """The first n rows in ingest order (a bare limit is not deterministic).
    A sampling operator: the limit is the feature."""
    return df.orderBy(F.col(ordinal)).limit(n)


def validated_load(spark: SparkSession, path: str, schema: StructType | str, required: Sequence[str],
                   min_rows: int, fmt: str = "csv"):
    """Q6: typed load plus the schema (Q4) and minimum-row (Q5) checks.
    Returns (DataFrame, report rows); never raises on a failed check."""
    df = read_csv_typed(spark, path, schema) if fmt == "csv" else spark.read.schema(schema).format(fmt).load(path)
    missing = [c for c in required if c not in df.columns]
    have = df.count()
    report = [("required_columns_missing", float(len(missing)), 0.0, not missing),
              ("row_count_at_least", float(have), float(min_rows), have >= min_rows)]
    return df, report


def validation_report(spark: SparkSession, report: Sequence[tuple]) -> DataFrame:
    """Q6: the rows of ``validated_load``'s report as a table."""
    return spark.createDataFrame(list(report), "check string, observed double, threshold double, passed boolean")


def write_bucketed(df: DataFrame, name: str, key: str | Sequence[str], buckets: int,
                   path: str | None = None) -> DataFrame:
    """Write a table bucketed (and sorted) by ``key`` and return it from the
    catalog. Two tables bucketed on the join key with the same bucket count
    join without a shuffle, so a fact table written once this way (e.g. by
    job id) serves every later per-job join and aggregate shuffle-free.
    ``path`` defaults to the shared checkpoint folder."""
    keys = [key] if isinstance(key, str) else list(key)
    spark = df.sparkSession
    path = path or os.path.join(checkpoint_dir(spark), "bucketed", name)
    (df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
       .option("path", path).saveAsTable(name))
    return spark.table(name)


def materialize_bucketed(df: DataFrame, name: str, key: str | Sequence[str], buckets: int | None = None) -> DataFrame:
    """S10 with co-partitioning: a fact table written once, one file a bucket, and
    found again by its fingerprint, in this session's catalog or, after a restart,
    in the shared folder. Aggregates and joins by ``key`` then need no shuffle.
    ``buckets`` defaults to the session's shuffle partitions."""
    spark = df.sparkSession
    keys = [key] if isinstance(key, str) else list(key)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{fingerprint(df)}_{buckets}"
    path = os.path.join(checkpoint_dir(spark), "bucketed", table)
    if spark.catalog.tableExists(table) and _exists(spark, os.path.join(path, "_SUCCESS")):
        return spark.table(table)
    spark.sql(f"DROP TABLE IF EXISTS `{table}`")
    if _exists(spark, os.path.join(path, "_SUCCESS")):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        by = ", ".join(f"`{k}`" for k in keys)
        spark.sql(f"CREATE TABLE `{table}` ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
        return spark.table(table)
    return write_bucketed(df.repartition(buckets, *keys), table, keys, buckets, path)


def drop_bucketed(spark: SparkSession, df: DataFrame, name: str, buckets: int | None = None) -> None:
    """Remove what ``materialize_bucketed`` wrote for this frame, where it is there."""
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{fingerprint(df)}_{buckets}"
    spark.sql(f"DROP TABLE IF EXISTS `{table}`")
    remove_tables(spark, os.path.join(checkpoint_dir(spark), "bucketed", table))
