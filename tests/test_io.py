"""Readers and writers."""

import os
import tempfile

import pytest

from demandlens.sources import io


def test_csv_roundtrip_keeps_string_ids(spark):
    base = tempfile.mkdtemp(prefix="demandlens-io-")
    df = spark.createDataFrame([("000123", "SQL"), ("ABC", "Python")], "job_id string, skill string")
    io.write_table(df, os.path.join(base, "t"), fmt="csv")
    back = io.read_csv_typed(spark, os.path.join(base, "t"), "job_id string, skill string")
    assert sorted(r.job_id for r in back.collect()) == ["000123", "ABC"]


def test_load_or_empty(spark):
    missing = io.load_or_empty(spark, "/nonexistent/path/x", "skill string, n long")
    assert missing.count() == 0 and missing.columns == ["skill", "n"]


def test_materialize_reuses(spark):
    name = os.path.basename(tempfile.mkdtemp(prefix="mat-"))
    a = io.materialize(spark.range(5), name)
    again = io.materialize(spark.range(5), name)  # the same plan: reused, not rewritten
    assert again.inputFiles() == a.inputFiles() and again.count() == 5
    assert io.materialize(spark.range(7), name).count() == 7  # another input: made anew


def test_materialize_follows_its_files(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(3).write.parquet(path)
    assert io.materialize(spark.read.parquet(path), "follows").count() == 3
    spark.range(4).write.mode("overwrite").parquet(path)
    assert io.materialize(spark.read.parquet(path), "follows").count() == 4


def test_encoding_falls_back(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("id,name\n1,caf\u00e9\n".encode("latin-1"))
    (tmp_path / "utf.csv").write_bytes("id,name\n1,caf\u00e9\n".encode())
    for name in ("latin", "utf"):
        assert io.read_csv_any(spark, str(tmp_path / f"{name}.csv"), "id long, name string").first().name == "caf\u00e9"
    with pytest.raises(FileNotFoundError):
        io.load_validation(spark, str(tmp_path / "none.csv"), "id long")


def test_first_n_ordered(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "o long, v string")
    assert [r.v for r in io.first_n(df, 2, "o").collect()] == ["a", "b"]


def test_step_log_counts_without_extra_pass(spark):
    from demandlens.operators import quality
    jobs = spark.createDataFrame([("J1", 1, "2021")], "job_id string, ordinal long, posted_year string")
    skills = spark.createDataFrame([("J1", "SQL", "P", "B"), ("J1", "SQL", "P", "B"), ("J2", "R", "P", "B")],
                                   "job_id string, skill string, skill_category string, skill_level string")
    out, log = quality.logged_clean_primary(skills, jobs)
    out.write.format("noop").mode("overwrite").save()
    assert log.rows() == [("skills_in", 3, False), ("cleaned", 2, False)]


def test_column_overlap_and_nonempty(spark):
    from demandlens.operators import quality
    a = spark.createDataFrame([(1, "x")], "job_id long, skill string")
    b = spark.createDataFrame([(1, 2)], "job_id long, year int")
    got = {r["column"]: (r.in_left, r.in_right) for r in quality.column_overlap(a, b).collect()}
    assert got == {"job_id": (True, True), "skill": (True, False), "year": (False, True)}
    assert quality.nonempty(a) and not quality.nonempty(a.filter("job_id < 0"))


def test_validated_load_and_year_from_decimal(spark):
    from pyspark.sql import functions as F
    from demandlens.functions.text import year_from_decimal
    base = tempfile.mkdtemp(prefix="demandlens-val-")
    df = spark.createDataFrame([("J1", "2021.0"), ("J2", "x")], "job_id string, posted_year string")
    io.write_table(df, os.path.join(base, "t"), fmt="csv")
    loaded, report = io.validated_load(spark, os.path.join(base, "t"), "job_id string, posted_year string",
                                       ["job_id", "skill"], min_rows=3)
    assert report == [("required_columns_missing", 1.0, 0.0, False), ("row_count_at_least", 2.0, 3.0, False)]
    years = sorted((r.job_id, r.y) for r in loaded.select("job_id", year_from_decimal("posted_year").alias("y")).collect())
    assert years == [("J1", 2021), ("J2", None)]


def test_onehot_view(spark):
    from demandlens.operators import basket
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "b")], "job_id long, skill string")
    b = basket.baskets(df)
    got = {r.job_id: (r.a, r.b) for r in basket.onehot(b, ["a", "b"]).collect()}
    assert got == {1: (True, True), 2: (False, True)}
    assert {r.item: r.baskets for r in basket.item_presence(b).collect()} == {"a": 1, "b": 2}


def test_array_subset_violations(spark):
    from demandlens.operators import quality
    df = spark.createDataFrame([(["a", "x"], ["a", "b"]), (["b"], ["c"]), (None, ["x"])],
                               "rec array<string>, ok array<string>")
    assert [r.skill for r in quality.array_subset_violations(df, "rec", "ok").collect()] == []
    df2 = spark.createDataFrame([(["a", "z"], ["a"])], "rec array<string>, ok array<string>")
    assert [r.skill for r in quality.array_subset_violations(df2, "rec", "ok").collect()] == ["z"]


def test_bucketed_tables_join_without_shuffle(spark):
    name = os.path.basename(tempfile.mkdtemp(prefix="bkt")).replace("-", "_")
    a = spark.createDataFrame([(i, f"s{i % 3}") for i in range(40)], "job_id long, skill string")
    b = spark.createDataFrame([(i, 2000 + i % 5) for i in range(40)], "job_id long, posted_year int")
    ta = io.write_bucketed(a, f"{name}_a", "job_id", 4)
    tb = io.write_bucketed(b, f"{name}_b", "job_id", 4)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = ta.join(tb, "job_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def test_ordered_crosstab_drops_other_levels(spark):
    from demandlens.operators import crosstab
    df = spark.createDataFrame([(1, "Python", "entry"), (2, "SQL", "senior"), (3, "Python", "senior"),
                                (4, "SQL", "not specified")], "job_id long, skill string, experience_level string")
    out = crosstab.ordered_crosstab(crosstab.experience_crosstab(df, top_n=5)).collect()
    assert {r.experience_level for r in out} == {"entry", "senior"}
    order = {r.skill: r.skill_order for r in out}
    assert order == {"Python": 1, "SQL": 2}
