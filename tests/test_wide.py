"""Wide forms, distinct counts, key sets, names in names, bends, checked outputs."""

import random

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from demandlens.operators import changepoint, containment, cooccur, crosstab, distinct, keyset, quality, wide
from demandlens.sources import io
from demandlens.sources.publish import PublishRefused, publish


# --- wide forms ---------------------------------------------------------------

def test_columns_follow_the_list_not_the_data(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("a", "x", 4), ("b", "gone", 9), ("c", None, 1)], "k string, c string, v long")
    out = wide.wide(df, "k", "c", "v", ["y", "x", "never"], 0)
    assert out.columns == ["k", "y", "x", "never"]
    assert sorted(map(tuple, out.collect())) == [("a", 2, 5, 0), ("b", 0, 3, 0), ("c", 0, 0, 0)]
    assert wide.wide(df, "k", "c", "v", ["x"]).where("k = 'c'").first().x is None
    assert sorted(map(tuple, wide.wide(df, "k", "c", "v", []).collect())) == [("a",), ("b",), ("c",)]
    names = spark.createDataFrame([("b", 2), ("a", 3), ("c", 1), ("a", 3), (None, 9)], "skill string, rank int")
    assert wide.name_list(names) == ["c", "b", "a"] and wide.name_list(names.select("skill")) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        wide.name_list(names, most=2)
    with pytest.raises(ValueError):
        wide.wide(df, "k", "c", "v", [str(k) for k in range(wide.MOST + 1)])


def test_tables_of_the_report(spark):
    rows = [(j, s, y, lev) for j, (skills, y, lev) in enumerate([(["a", "b"], 2020, "EN"), (["a", "b", "c"], 2021, "SE"), (["a"], 2021, "EN")]) for s in skills]
    df = spark.createDataFrame(rows, "job_id long, skill string, posted_year int, experience_level string")
    square = wide.cooccurrence_table(cooccur.cooccurrence_matrix(df), ["a", "b", "c"])
    assert sorted(map(tuple, square.collect())) == [("a", 0, 2, 1), ("b", 2, 0, 1), ("c", 1, 1, 0)]
    shares = {r.skill: (r["2020"], r["2021"], r.change_pp) for r in wide.share_table(df, [2020, 2021]).collect()}
    assert shares["a"] == (0.5, 0.5, 0.0) and shares["c"] == (0.0, 0.25, None)
    levels = wide.level_table(crosstab.experience_crosstab(df), ["c", "a"])
    assert sorted(map(tuple, levels.collect())) == [("Entry-Level", 0, 2), ("Senior", 1, 1)]
    rules = spark.createDataFrame([("a", "b", 1.0), ("a", "b", 2.0), ("b", "a", 3.0)], "antecedents string, consequents string, lift double")
    assert sorted(map(tuple, wide.lift_table(rules, ["a", "b"]).collect()), key=str) == [("a", None, 1.5), ("b", 3.0, None)]


# --- distinct counts -------------------------------------------------------------

def test_distinct_counts_are_exact(spark):
    rows = [(1, "a", 0.0, [1], b"x", 2020), (1, "a", -0.0, [1], b"x", 2020), (2, None, float("nan"), [1, 2], None, 2020),
            (None, "b", float("nan"), None, b"y", 2021), (3, "", 1.5, [], b"x", None)]
    df = spark.createDataFrame(rows, "i long, s string, d double, l array<int>, b binary, y int")
    got = {r["column"]: (r.rows, r.nulls, r["distinct"]) for r in distinct.distinct_counts(df, ["i", "s", "d", "b", "y"]).collect()}
    assert got == {"i": (5, 1, 3), "s": (5, 1, 3), "d": (5, 0, 3), "b": (5, 1, 2), "y": (5, 1, 2)}
    profile = {r["column"]: (r.rows, r.nulls, r["distinct"]) for r in quality.profile(df.select("i", "s", "d", "b", "y")).collect()}
    assert got == profile
    by = {(r.y, r["column"]): r["distinct"] for r in distinct.distinct_counts(df, ["i", "s"], ["y"]).collect()}
    assert by == {(2020, "i"): 2, (2020, "s"): 1, (2021, "i"): 0, (2021, "s"): 1, (None, "i"): 1, (None, "s"): 1}
    assert distinct.distinct_counts(df.limit(0), ["i"]).collect() == []


def test_sketches_merge_within_their_error(spark):
    df = spark.range(60_000).select((F.col("id") % 5).cast("int").alias("y"), (F.col("id") % 40_000).alias("v"), (F.col("id") % 7).alias("w"))
    parts = distinct.sketches(df, ["v", "w"], ["y"])
    whole = {r["column"]: (r.rows, r["distinct"]) for r in distinct.estimates(distinct.merged(parts)).collect()}
    assert whole["v"][0] == 60_000 and abs(whole["v"][1] / 40_000 - 1) < 0.03 and whole["w"] == (60_000, 7)
    years = {(r.y, r["column"]): r["distinct"] for r in distinct.estimates(parts).collect()}
    assert len(years) == 10 and all(abs(years[(y, "v")] / 8_000 - 1) < 0.03 for y in range(5))


# --- key sets ----------------------------------------------------------------------

def test_filter_passes_all_matches_and_few_others(spark):
    big = spark.range(100_000).select((F.col("id") * 3).alias("k"), "id")
    keys = spark.range(2_000).select((F.col("id") * 30).alias("k"))
    seen = Observation("passed")
    passed = keyset.filtered(big, keys, "k").observe(seen, F.count(F.lit(1)).alias("n"))
    out = passed.join(keys, "k", "left_semi")
    assert out.count() == 2_000
    assert 2_000 <= seen.get["n"] <= 2_000 + 0.03 * 98_000
    assert sorted(map(tuple, keyset.semi_join(big, keys, "k").collect())) == sorted(map(tuple, big.join(keys, "k", "left_semi").collect()))


def test_filter_beyond_its_bound_stays_exact(spark):
    big = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", 4)], "k string, v int")
    keys = spark.createDataFrame([("a",), ("a",), (None,), ("zz",)], "k string")
    for bits in (None, 64, 1 << 12):
        assert sorted(r.v for r in keyset.semi_join(big, keys, "k", bits).collect()) == [1, 4]
    assert keyset.semi_join(big, keys.limit(0), "k").collect() == []
    assert keyset.size_of(10 ** 12) == keyset.MOST_BITS and keyset.size_of(0) == 1 << 10


def test_filter_stands_before_the_shuffle(spark, tmp_path):
    path = str(tmp_path / "big")
    spark.range(1000).select(F.col("id").alias("k")).write.parquet(path)
    keys = spark.range(10).select(F.col("id").alias("k"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = keyset.semi_join(spark.read.parquet(path), keys, "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    left = plan[plan.index("SortMergeJoin"):plan.index("FileScan")]
    assert left.index("Exchange") < left.index("getbit")  # printed from the top: the filter is below the exchange


# --- names in names -------------------------------------------------------------------

def test_names_match_as_all_pairs_do(spark):
    rnd = random.Random(3)
    words = ["sql", "my", "mysql", "r", "go", "golang", "Power BI", "power", " bi ", "café", "日本語", "日本", "a b c", "learn", "machine learning", "ing", "arn"]
    left = [*words, *("".join(rnd.choice("ab c") for _ in range(rnd.randrange(0, 9))) for _ in range(120)), None, ""]
    right = [*words[::2], *("".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 6))) for _ in range(120)), None]
    one = lambda names: spark.createDataFrame([(n,) for n in names], "name string")

    def match(a, b):
        return a == b if len(a) < 3 or len(b) < 3 else a == b or a in b or b in a
    clean = lambda names: {n.strip().lower() for n in names if n is not None}
    expected = sorted((a, b) for a in clean(left) for b in clean(right) if match(a, b))
    assert sorted(map(tuple, containment.matches(one(left), one(right)).collect())) == expected
    assert containment.matches(one(left).limit(0), one(right)).collect() == []
    plan = containment.matches(one(left), one(right))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# --- bends -----------------------------------------------------------------------------

def brute(points, penalty=2.0):
    """(bend year or None, slope, value, half width) by least squares with numpy."""
    x0 = points[0][0]
    x, y = np.array([p[0] - x0 for p in points], float), np.array([p[1] for p in points], float)
    n, nx, best = len(x), x[-1] + 1, None
    for t in [0, *range(1, int(np.floor(0.8 * x[-1])) + 1)]:
        cols = [np.ones(n), x] + ([np.maximum(0, x - t)] if t else [])
        a = np.stack(cols, 1)
        if np.linalg.matrix_rank(a) < len(cols):
            continue
        beta, *_ = np.linalg.lstsq(a, y, rcond=None)
        error = float(((y - a @ beta) ** 2).sum())
        if t == 0:
            line, best = error, (t, beta, error, a)
            kept = float("inf")
        elif line > 1e-9 and error * n ** (penalty / n) < line and error < kept - 1e-9:
            best, kept = (t, beta, error, a), error
    t, beta, error, a = best
    at = np.array([1, nx] + ([nx - t] if t else []))
    free = n - (4 if t else 2)
    lever = at @ np.linalg.inv(a.T @ a) @ at
    return x0 + t if t else None, beta[1], float(at @ beta), free, np.sqrt(error / free * (1 + lever)) if free else None


def test_bends_as_least_squares_has_them(spark):
    rnd, series = random.Random(6), {}
    for k in range(40):
        n, t = rnd.randrange(5, 16), rnd.randrange(2, 10)
        series[f"s{k}"] = [(2000 + i, int(1000 + 30 * i + (200 * max(0, i - t) if k % 2 else 0) + rnd.randrange(-15, 15))) for i in range(n)]
    series["short"] = [(2000 + i, 5) for i in range(4)]
    series["flat"] = [(2000 + i, 7) for i in range(8)]
    series["line"] = [(2000 + i, 100 + 3 * i) for i in range(8)]
    rows = [(s, y, v) for s, points in series.items() for y, v in points]
    got = {r.skill: r for r in changepoint.piecewise_forecast(spark.createDataFrame(rows, "skill string, year long, y long").repartition(4)).collect()}
    assert "short" not in got and got["flat"].method == "linear_interval" and got["line"].bends_in is None
    assert got["line"].forecast_value == pytest.approx(124) and got["flat"].forecast_value == pytest.approx(7)
    bends = 0
    for k in range(40):
        r, (bend, slope, value, free, s) = got[f"s{k}"], brute(series[f"s{k}"])
        if r.method == "linear_trend":
            assert r.ci_lower is None and r.bends_in is None
            continue
        assert r.bends_in == bend and r.forecast_value == pytest.approx(max(0, value)) and r.slope == pytest.approx(slope)
        from demandlens.operators.forecast import T90
        assert r.ci_upper == pytest.approx(value + T90[free - 1] * s)
        bends += bend is not None
    assert bends >= 10


# --- checked outputs ------------------------------------------------------------------------

def test_a_refused_table_leaves_the_old_one(spark, tmp_path):
    path = str(tmp_path / "out" / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, s string")
    assert publish(df, path).rows == 2
    with pytest.raises(PublishRefused, match="at least 1 rows"):
        publish(df.where("k > 5"), path)
    with pytest.raises(PublishRefused, match="no nulls"):
        publish(df.withColumn("s", F.lit(None).cast("string")), path, checks={"no nulls": lambda t: not quality.nonempty(t.where("s is null"))})
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|ivision"):
        publish(df.select(F.expr("1 / (k - 1)").alias("k")), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "b")]
    assert publish(df.where("k = 2"), path).rows == 1
    assert spark.read.parquet(path).count() == 1
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")] == ["t"]  # nothing left beside it
    assert publish(df.limit(0), str(tmp_path / "empty"), min_rows=0).rows == 0


def test_published_csv_is_read_by_its_schema(spark, tmp_path):
    df = spark.createDataFrame([(0.1 + 0.2, "a,b", "2024"), (1e-300, None, "x")], "d double, s string, y string")
    done = publish(df, str(tmp_path / "c"), "csv")
    back = io.load_or_empty(spark, done.path, df.schema, "csv")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect())) and back.dtypes == df.dtypes


# --- the bucketed fact ---------------------------------------------------------------------

def test_bucketed_fact_is_reused_without_a_shuffle(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(200).select((F.col("id") % 40).alias("job_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("skill")).write.parquet(path)
    df = spark.read.parquet(path)
    fact = io.materialize_bucketed(df, "fact_test", "job_id", 4)
    assert io.materialize_bucketed(df, "fact_test", "job_id", 4).inputFiles() == fact.inputFiles()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = fact.groupBy("job_id").agg(F.collect_set("skill").alias("s")).join(fact.groupBy("job_id").count(), "job_id")
        plan = sets._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and sets.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    name = [t.name for t in spark.catalog.listTables() if t.name.startswith("fact_test")][0]
    spark.sql(f"DROP TABLE {name}")  # a new session finds the files again
    again = io.materialize_bucketed(df, "fact_test", "job_id", 4)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))
    assert "Exchange" not in again.groupBy("job_id").count()._jdf.queryExecution().executedPlan().toString()
    io.drop_bucketed(spark, df, "fact_test", 4)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("fact_test")]
