import time

from pyspark.sql import functions as F

from demandlens.session import SHUFFLE_CLEANUP, checkpointed


def _shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (found.apply(k) for k in range(found.size())) if f.getName().startswith("shuffle_")}


def test_no_shuffle_files_stay_behind_a_written_table(spark):
    before, kept = _shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP)
    df = spark.range(100_000).groupBy((F.col("id") % 5000).alias("k")).agg(F.count("*").alias("n"))
    out = checkpointed(df)
    for _ in range(50):  # they are removed in the background
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(SHUFFLE_CLEANUP) == kept
    # the same frame again: its shuffles are made anew
    assert checkpointed(df).count() == out.count() == df.count() == 5000
