"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every demandlens job relies on. AQE re-plans joins from runtime
# sizes (a broadcast only happens below the size threshold, otherwise a
# sort-merge join), coalesces small shuffle partitions and splits skewed ones.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

#: Whether a query's shuffle files are removed at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "demandlens") -> SparkSession:
    """Local session for tests and the benchmark (UI off, AQE on).

    On a cluster the session comes from the launcher; only the defaults above
    are applied there (see ``apply_defaults``).
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.driver.memory", os.environ.get("DEMANDLENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL defaults to an existing (e.g. driver-made) session."""
    for key, value in SESSION_DEFAULTS.items():
        try:
            spark.conf.set(key, value)
        except Exception:  # static or locked conf: keep the cluster's value
            pass
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and materialised intermediates.

    The cluster names it in ``spark.checkpoint.dir``; it is read from the
    session and never overridden. Only a session in one local JVM (tests, the
    bench) may go without: it gets a temporary folder. On a cluster each
    executor would see its own disk there, so an unset folder is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    chosen = spark.conf.get("spark.checkpoint.dir", None)
    if not chosen:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is unset: set it to a folder that the driver and all executors share")
        chosen = tempfile.mkdtemp(prefix="demandlens-ckpt-")
    sc.setCheckpointDir(chosen)
    return chosen


_folders: list[str] = []  # of tables_folder() contexts, the innermost last


@contextmanager
def tables_folder(spark: SparkSession) -> Iterator[str]:
    """Tables that ``checkpointed`` writes in this context go to a folder of
    its own, which ``remove_tables`` removes once nothing reads them."""
    _folders.append(os.path.join(checkpoint_dir(spark), "tables", uuid.uuid4().hex))
    try:
        yield _folders[-1]
    finally:
        _folders.pop()


def remove_tables(spark: SparkSession, folder: str) -> None:
    """Remove a folder that ``tables_folder`` gave."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(conf).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise an intermediate in the session's shared checkpoint folder
    and read it back: computed once, lineage cut, so the branches that read it
    never re-run its inputs and a lost executor does not recompute them.

    Written as Parquet rather than with ``DataFrame.checkpoint()``: a reliable
    RDD checkpoint computes its input a second time to write the files.

    The shuffle files go once the table is written: nothing reads them again, and
    otherwise they stay on the executors' disks until the driver's garbage
    collector happens on them.
    """
    spark = df.sparkSession
    folder = _folders[-1] if _folders else os.path.join(checkpoint_dir(spark), "tables")
    path = os.path.join(folder, uuid.uuid4().hex)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.parquet(path)
