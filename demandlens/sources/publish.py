"""Checked outputs (S9, Q12): a table is written beside its place, read again and
checked, and takes the place by a rename only if it is what was meant.

A refused table leaves the one that stood there untouched; readers see the old or
the new one, never a part. Where the file system's rename is no single step (object
stores), readers can meet a moment without a table, but none with half of one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

Check = Callable[[DataFrame], bool]


class PublishRefused(ValueError):
    """The written table failed these checks; what was published before stays."""

    def __init__(self, path: str, failed: list[str]):
        self.failed = failed
        super().__init__(f"{path} not published: {', '.join(failed)}")


@dataclass(frozen=True)
class Published:
    path: str
    rows: int
    checks: tuple[str, ...]


def _fs(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path


def read_published(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    """The table as a reader gets it: CSV with a header, by its schema."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def publish(df: DataFrame, path: str, fmt: str = "parquet", checks: Mapping[str, Check] | None = None, min_rows: int = 1) -> Published:
    """Write, read again, check, rename. Checked are: as many rows read as were
    counted while writing, at least ``min_rows``, the same columns and types, and
    each of ``checks`` on the table as read."""
    spark = df.sparkSession
    fs, at = _fs(spark, path)
    path = path.rstrip("/")
    mark = uuid.uuid4().hex
    staging, old = f"{path}.staging-{mark}", f"{path}.old-{mark}"
    seen = Observation(f"publish:{mark}")
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write
    try:
        (writer.option("header", True).csv if fmt == "csv" else writer.format(fmt).save)(staging)
        back = read_published(spark, staging, df.schema, fmt)
        rows, failed = back.count(), []
        written = _rows(seen, rows)
        stored = spark.read.format(fmt).option("header", True).load(staging) if rows else back
        same = stored.columns == df.columns and (fmt == "csv" or stored.dtypes == df.dtypes)
        tests: dict[str, bool] = {"rows as written": rows == written, f"at least {min_rows} rows": rows >= min_rows, "columns as written": same}
        for name, check in (checks or {}).items():
            tests[name] = bool(check(back))
        failed = [name for name, good in tests.items() if not good]
        if failed:
            raise PublishRefused(path, failed)
        there = fs.exists(at(path))
        if there and not fs.rename(at(path), at(old)):
            raise OSError(f"cannot move {path}")
        if not fs.rename(at(staging), at(path)):
            if there:
                fs.rename(at(old), at(path))
            raise OSError(f"cannot publish {path}")
        if there:
            fs.delete(at(old), True)
        return Published(path, rows, tuple(tests))
    finally:
        fs.delete(at(staging), True)


def _rows(seen: Observation, read: int) -> int:
    """Rows counted while writing; a plan that is known to be empty isn't run."""
    from py4j.protocol import Py4JJavaError
    try:
        return int(seen.get["rows"])
    except Py4JJavaError:
        return 0 if read == 0 else -1
