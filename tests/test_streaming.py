"""Streaming running counts equal the batch annual share over the same files."""

import os
import tempfile

from demandlens.operators import trends
from demandlens.streaming import annual_share_of, read_published, start_running_counts


def test_stream_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="demandlens-stream-")
    src, out = os.path.join(base, "in"), os.path.join(base, "out")
    rows = [(1, "SQL ", 2020), (1, "python", 2020), (2, "sql", 2021), (3, "Python", None), (4, "aws", 2021)]
    schema = "job_id bigint, skill string, posted_year int"
    spark.createDataFrame(rows[:3], schema).write.parquet(os.path.join(src, "part1"))
    q = start_running_counts(spark, os.path.join(src, "*"), out, name=os.path.basename(base))
    q.awaitTermination(120)
    first = {(r.posted_year, r.skill): r.mentions for r in read_published(spark, out).collect()}
    assert first == {(2020, "sql"): 1, (2020, "python"): 1, (2021, "sql"): 1}

    spark.createDataFrame(rows[3:], schema).write.parquet(os.path.join(src, "part2"))
    q = start_running_counts(spark, os.path.join(src, "*"), out, name=os.path.basename(base))  # resumes from its checkpoint
    q.awaitTermination(120)
    streamed = {(r.posted_year, r.skill, r.share) for r in annual_share_of(read_published(spark, out)).collect()}
    batch_in = spark.createDataFrame([(j, s.strip().lower(), y) for j, s, y in rows], schema)
    batch = {(r.posted_year, r.skill, r.share) for r in trends.annual_share(batch_in).collect()}
    assert streamed == batch
