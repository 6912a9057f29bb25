"""Chi-square, p-values and keyword flags."""

import math

import pytest
from pyspark.sql import functions as F

from demandlens.functions.stats import chi2_sf
from demandlens.operators import stats


def _cells(spark, table):
    rows = [(str(i), str(j), n) for i, row in enumerate(table) for j, n in enumerate(row)]
    return spark.createDataFrame(rows, "row string, col string, n long")


def test_chi_square_by_hand_values(spark):
    cells = _cells(spark, [[10, 30], [20, 5]])
    yates = stats.chi_square(cells).first()
    pearson = stats.chi_square(cells, yates=False).first()
    assert yates.dof == 1 and pearson.dof == 1
    assert yates.statistic == pytest.approx(16.57848, abs=1e-5)
    assert pearson.statistic == pytest.approx(18.72619, abs=1e-5)
    assert yates.p_value == pytest.approx(math.erfc(math.sqrt(16.578483 / 2)), rel=1e-6)


@pytest.mark.parametrize("x,dof,p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05),
                                     (11.070498, 5, 0.05), (2.705543, 1, 0.10), (0.0, 3, 1.0)])
def test_chi2_survival_function(spark, x, dof, p):
    got = spark.range(1).select(chi2_sf(F.lit(x), F.lit(dof)).alias("p")).first().p
    assert got == pytest.approx(p, abs=1e-6)


def test_small_tails_are_not_lost(spark):
    got = spark.range(1).select(chi2_sf(F.lit(238.4), F.lit(1)).alias("p"), chi2_sf(F.lit(900.0), F.lit(2)).alias("q")).first()
    assert got.p == pytest.approx(math.erfc(math.sqrt(238.4 / 2)), rel=1e-9) and 0 < got.p < 1e-50
    assert got.q == pytest.approx(math.exp(-450), rel=1e-9)


def test_unseen_cells_count_as_zero(spark):
    """The third row never has the third column: its expected count is added."""
    table = [[10, 5, 5], [4, 6, 2], [7, 9, 0]]
    r = stats.chi_square(spark.createDataFrame(
        [(str(i), str(j), n) for i, x in enumerate(table) for j, n in enumerate(x) if n], "row string, col string, n long")).first()
    rows, cols, n = [sum(x) for x in table], [sum(x) for x in zip(*table)], sum(map(sum, table))
    expected = sum((o - rows[i] * cols[j] / n) ** 2 / (rows[i] * cols[j] / n) for i, x in enumerate(table) for j, o in enumerate(x))
    assert r.statistic == pytest.approx(expected, rel=1e-12) and r.dof == 4
    assert r.min_expected == pytest.approx(min(rows) * min(cols) / n)


def test_zero_cell_table_and_missing_column(spark):
    # a flag column that is never true: one column, dof 0, p = 1
    cells = spark.createDataFrame([("a", "false", 5), ("b", "false", 7)], "row string, col string, n long")
    r = stats.chi_square(cells).first()
    assert r.dof == 0 and r.p_value == 1.0


def test_keyword_flag_substring_vs_word(spark):
    df = spark.createDataFrame([("storage",), ("RAG pipelines",), (None,)], "skill string")
    sub = [r.genai_flag for r in stats.flag_keywords(df).collect()]
    word = [r.genai_flag for r in stats.flag_keywords(df, word=True).collect()]
    assert sub == [True, True, False]
    assert word == [False, True, False]


def test_flag_summary_keeps_null_group(spark):
    df = spark.createDataFrame([("x", None, True), ("y", None, False), ("z", "senior", True)],
                               "skill string, job_level string, genai_flag boolean")
    got = {r.job_level: (r.genai_mentions, r.total_skill_rows) for r in stats.flag_summary(df).collect()}
    assert got == {None: (1, 2), "senior": (1, 1)}


def test_two_year_test_z_squared_is_uncorrected_chi2(spark):
    rows = [(2022, "llm")] * 40 + [(2022, "sql")] * 60 + [(2024, "llm")] * 70 + [(2024, "sql")] * 30
    df = spark.createDataFrame(rows, "posted_year int, skill string")
    r = stats.two_year_test(df, 2022, 2024, ["llm"]).first()
    pearson = stats.chi_square(_cells(spark, [[40, 60], [70, 30]]), yates=False).first().statistic
    assert r.z ** 2 == pytest.approx(pearson, rel=1e-5)
    assert r.sample_ok and r.conclusion == stats.REJECT


@pytest.mark.parametrize("x,dof", [(0.5, 4), (9.0, 4), (6539.822364, 4), (40_000.0, 2)])
def test_log_of_the_tail_beyond_a_double(spark, x, dof):
    from demandlens.functions.stats import chi2_log10_sf
    got = spark.range(1).select(chi2_log10_sf(F.lit(x), F.lit(dof)).alias("p")).first().p
    assert got == pytest.approx((math.log(sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))) - x / 2) / math.log(10), rel=1e-10)
