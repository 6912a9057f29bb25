"""Keyword flags, contingency tables and tests.

Tables are built from grouped counts, so the raw rows are scanned once and
the tests run on the counts and their margins; no zero-filled grid is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.functions.stats import chi2_log10_sf, chi2_sf
from demandlens.functions.text import keyword_flag
from demandlens.session import checkpointed

# The generative-AI keyword list and the test thresholds.
GENAI_TERMS = ["llm", "rag", "genai", "prompt engineering"]
ALPHA = 0.05
MIN_GROUP_COUNT = 30
MIN_CELL_COUNT = 5
REJECT = "REJECT H₀"
FAIL_TO_REJECT = "FAIL TO REJECT H₀"


def flag_keywords(df: DataFrame, col: str = "skill", terms: Sequence[str] = GENAI_TERMS,
                  word: bool = False, out: str = "genai_flag") -> DataFrame:
    """Add a boolean keyword flag (substring match unless ``word``)."""
    return df.withColumn(out, keyword_flag(col, terms, word))


def flag_summary(df: DataFrame, group: str = "job_level", flag: str = "genai_flag") -> DataFrame:
    """Per group: flagged rows, rows, flagged share; the null group kept."""
    f = F.col(flag).cast("int")
    return df.groupBy(group).agg(
        F.sum(f).cast("bigint").alias("genai_mentions"),
        F.count(F.lit(1)).alias("total_skill_rows"),
        F.avg(f).alias("genai_share"),
    )


def contingency(df: DataFrame, row: str, col: str, null_row: str = "unknown") -> DataFrame:
    """(row, col, n) counts; a null row value becomes ``null_row``."""
    return (df.groupBy(F.coalesce(F.col(row).cast("string"), F.lit(null_row)).alias("row"),
                       F.col(col).cast("string").alias("col"))
              .agg(F.count(F.lit(1)).alias("n")))


def chi_square(cells: DataFrame, yates: bool = True) -> DataFrame:
    """T4: chi-square test of independence on (row, col, n) cells.

    Expected counts come from the margins. Cells that were never seen are not
    built: an unseen cell adds its expected count e to the statistic, and all
    expected counts sum to the total, so the unseen ones add what the seen ones
    leave. With one degree of freedom the Yates continuity correction is
    applied (the usual default); all four cells of a 2x2 table are the same
    |o - e| away from their expected counts, and the sum of 1 / e follows from
    the margins. Returns one row: statistic, dof, p_value, log10_p, n, n_rows, n_cols,
    min_expected, valid (no zero expected cell), nothing rounded. The cells are
    written once (this runs a job), as they are read several times.
    """
    cells = checkpointed(cells)
    r = cells.groupBy("row").agg(F.sum("n").cast("double").alias("r"))
    c = cells.groupBy("col").agg(F.sum("n").cast("double").alias("c"))
    rows = r.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("r").alias("total"), F.min("r").alias("r_min"),
                 F.sum(1 / F.col("r")).alias("r_inv"))
    cols = c.agg(F.count(F.lit(1)).alias("n_cols"), F.min("c").alias("c_min"), F.sum(1 / F.col("c")).alias("c_inv"))
    total = rows.select("total").scalar()
    e = F.col("r") * F.col("c") / total
    d = F.col("n").cast("double") - e
    seen = (cells.join(r, "row").join(c, "col")
            .agg(F.sum(d * d / e).alias("s"), F.sum(e).alias("e"), F.max(F.abs(d)).alias("d"), F.count(F.lit(1)).alias("k")))
    s = seen.select(
        "s", "e", "d", "k", *[rows.select(x).scalar().alias(x) for x in ("n_rows", "total", "r_min", "r_inv")],
        *[cols.select(x).scalar().alias(x) for x in ("n_cols", "c_min", "c_inv")])
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    unseen = F.when(F.col("k") < F.col("n_rows") * F.col("n_cols"), F.col("total") - F.col("e")).otherwise(F.lit(0.0))
    corrected = F.pow(F.col("d") - F.least(F.lit(0.5), F.col("d")), 2) * F.col("total") * F.col("r_inv") * F.col("c_inv")
    plain = F.col("s") + unseen
    statistic = F.when(dof == 1, corrected).otherwise(plain) if yates else plain
    summary = s.select(statistic.alias("statistic"), dof.cast("bigint").alias("dof"), F.col("total").cast("bigint").alias("n"),
                       "n_rows", "n_cols", (F.col("r_min") * F.col("c_min") / F.col("total")).alias("min_expected"))
    return summary.select("statistic", "dof", chi2_sf(F.col("statistic"), F.col("dof")).alias("p_value"),
                          chi2_log10_sf(F.col("statistic"), F.col("dof")).alias("log10_p"), "n", "n_rows", "n_cols",
                          "min_expected", (F.col("min_expected") > 0).alias("valid"))


def two_year_test(df: DataFrame, year_a: int, year_b: int, group: Sequence[str],
                  skill: str = "skill", year: str = "posted_year", alpha: float = ALPHA) -> DataFrame:
    """Is the share of ``group`` skills different between two years?

    2x2 chi-square with Yates correction, the two-proportion z-test (its
    square is the uncorrected statistic), the sample guard (each year
    >= 30 rows, each cell >= 5) and the verdict at ``alpha``.
    """
    sub = (df.filter(F.col(year).isin(year_a, year_b))
             .select(F.col(year).alias("y"), F.coalesce(F.col(skill).isin(list(group)), F.lit(False)).alias("g")))
    cells = contingency(sub, "y", "g")  # at most 4 rows
    counts = cells.agg(
        F.sum(F.when(F.col("row") == str(year_a), F.col("n")).otherwise(0)).alias("n_a"),
        F.sum(F.when(F.col("row") == str(year_b), F.col("n")).otherwise(0)).alias("n_b"),
        F.sum(F.when((F.col("row") == str(year_a)) & (F.col("col") == "true"), F.col("n")).otherwise(0)).alias("k_a"),
        F.sum(F.when((F.col("row") == str(year_b)) & (F.col("col") == "true"), F.col("n")).otherwise(0)).alias("k_b"),
    )
    # a 2x2 table: the corrected statistic follows from the four counts
    n_a, n_b, k_a, k_b = (F.col(c) for c in ("n_a", "n_b", "k_a", "k_b"))
    n, k = n_a + n_b, k_a + k_b
    d = F.abs(k_a - n_a * k / n)
    chi = F.pow(d - F.least(F.lit(0.5), d), 2) * n * (1 / n_a + 1 / n_b) * (1 / k + 1 / (n - k))
    p1, p2, pooled = k_a / n_a, k_b / n_b, k / n
    z = (p1 - p2) / F.sqrt(pooled * (1 - pooled) * (1 / n_a + 1 / n_b))
    min_cell = F.least(k_a, k_b, n_a - k_a, n_b - k_b)
    out = counts.select("n_a", "n_b", "k_a", "k_b", p1.alias("share_a"), p2.alias("share_b"), chi.alias("chi2"), z.alias("z"),
                        min_cell.alias("min_cell"))
    p_value = chi2_sf(F.col("chi2"), F.lit(1))
    return out.select(
        F.lit(year_a).alias("year_a"), F.lit(year_b).alias("year_b"), "n_a", "n_b", "k_a", "k_b", "share_a", "share_b", "chi2",
        F.lit(1).cast("bigint").alias("dof"), p_value.alias("p_value"), "z",
        chi2_sf(F.col("z") * F.col("z"), F.lit(1)).alias("z_p_value"), "min_cell",
        ((F.col("n_a") >= MIN_GROUP_COUNT) & (F.col("n_b") >= MIN_GROUP_COUNT)
         & (F.col("min_cell") >= MIN_CELL_COUNT)).alias("sample_ok"),
        F.when(p_value < alpha, F.lit(REJECT)).otherwise(F.lit(FAIL_TO_REJECT)).alias("conclusion"),
    )
