"""Profiling and data-quality checks (Q1-Q12, C17).

Checks never raise: each returns rows ``(check, observed, threshold, passed)``
computed in one aggregate pass over the data, so a report over a 100 TB table
is one scan. Schema checks are decided from the DataFrame's schema alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Validation thresholds of the data contracts.
MIN_ROWS = 40_000
MAX_UNPARSED_DATE_SHARE = 0.20
YEAR_RANGE = (2020, 2026)
MAX_UNKNOWN_CATEGORY_SHARE = 0.05
MIN_YEARS = 3


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Q1/Q2: per column: type, rows, nulls, distinct values.

    One aggregate for all columns; ``exact=False`` uses HyperLogLog distinct
    counts (no per-column shuffle of values) for very wide or very large
    tables.
    """
    distinct = F.countDistinct if exact else F.approx_count_distinct
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(df.columns):
        aggs += [F.count(F.col(c)).alias(f"_nn{i}"), distinct(F.col(c)).alias(f"_d{i}")]
    wide = df.agg(*aggs)
    dtypes = dict(df.dtypes)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(dtypes[c]).alias("dtype"),
                     F.col("_rows").alias("rows"), (F.col("_rows") - F.col(f"_nn{i}")).alias("nulls"),
                     F.col(f"_d{i}").cast("bigint").alias("distinct"))
            for i, c in enumerate(df.columns)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def column_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Q3: per column of either table: in_left, in_right, and its nulls there."""
    x = profile(left).select("column", F.col("nulls").alias("left_nulls"))
    y = profile(right).select("column", F.col("nulls").alias("right_nulls"))
    return x.join(y, "column", "full").select(
        "column", F.col("left_nulls").isNotNull().alias("in_left"), F.col("right_nulls").isNotNull().alias("in_right"),
        "left_nulls", "right_nulls")


def value_counts(df: DataFrame, cols: Sequence[str], k: int = 10) -> DataFrame:
    """Q2: per column its k most frequent values (null included) with their
    counts, ties by value; all columns in one pass. The ranking window sees one
    row per distinct value, after the partial aggregate."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    counts = df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_first("value")))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def long_format_report(before: DataFrame, after: DataFrame, list_col: str, skill: str = "skill",
                       derived: Sequence[str] = (), sep: str = ",") -> DataFrame:
    """Q7/Q8: what exploding a list column did: rows before and after (it must
    not shrink what has a list), rows without a single hit, values that still
    hold a separator, and derived columns that are missing."""
    b = before.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col(list_col).isNull() | (F.col(list_col) == ""), 1)).alias("none"))
    a = after.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col(skill).contains(sep), 1)).alias("lists"))
    missing = [c for c in derived if c not in after.columns]
    rows, none = b.select("rows").scalar(), b.select("none").scalar()
    listed = rows - none
    return a.select(F.explode(F.array(
        _row("exploded_rows", F.col("rows"), 0, F.col("rows") >= listed),
        _row("zero_extraction_rows", none, 0, none == 0),
        _row("unsplit_values", F.col("lists"), 0, F.col("lists") == 0),
        _row("derived_columns_missing", F.lit(len(missing)), 0, F.lit(not missing)))).alias("c")).select("c.*")


def _row(name: str, observed: Column, threshold: float, passed: Column) -> Column:
    return F.struct(F.lit(name).alias("check"), observed.cast("double").alias("observed"),
                    F.lit(float(threshold)).alias("threshold"), passed.alias("passed"))


def quality_report(df: DataFrame, required: Sequence[str], min_rows: int = MIN_ROWS,
                   date_col: str | None = "posted_date", year: str = "posted_year",
                   category: str = "skill_category", skill: str = "skill",
                   year_range: tuple[int, int] = YEAR_RANGE) -> DataFrame:
    """Q4/Q5/C17/Q8/Q10: schema, size, date-parse, long-format and coverage checks.

    - required_columns_missing (Q4): number of required columns absent
    - row_count (Q5): rows >= min_rows
    - unparsed_date_share (C17): share of non-null date texts that do not parse, <= 20 %
    - null_skill_rows (Q8): rows without a skill, must be 0
    - year_out_of_range_rows (Q8): numeric years outside the contract range, must be 0
    - unknown_category_share (Q8): null or 'unknown' category, <= 5 %
    - distinct_years (Q10): >= 3 years covered
    """
    missing = [c for c in required if c not in df.columns]
    n = F.count(F.lit(1))
    cat = F.lower(F.col(category))
    agg = [n.alias("rows"),
           F.count(F.when(F.col(skill).isNull(), 1)).alias("null_skill"),
           F.count(F.when(F.col(year).isNotNull() & ~F.col(year).between(*year_range), 1)).alias("out_of_range"),
           F.count(F.when(F.col(category).isNull() | (cat == "unknown"), 1)).alias("unknown_cat"),
           F.countDistinct(F.col(year)).alias("years")]
    if date_col:
        txt = F.col(date_col)
        agg += [F.count(txt).alias("dates"),
                F.count(F.when(txt.isNotNull() & F.try_to_timestamp(txt).isNull(), 1)).alias("bad_dates")]
    a = df.agg(*agg)
    unknown_share = F.col("unknown_cat") / F.col("rows")
    checks = [
        _row("required_columns_missing", F.lit(len(missing)), 0, F.lit(len(missing) == 0)),
        _row("row_count", F.col("rows"), min_rows, F.col("rows") >= min_rows),
        _row("null_skill_rows", F.col("null_skill"), 0, F.col("null_skill") == 0),
        _row("year_out_of_range_rows", F.col("out_of_range"), 0, F.col("out_of_range") == 0),
        _row("unknown_category_share", F.coalesce(unknown_share, F.lit(0.0)), MAX_UNKNOWN_CATEGORY_SHARE,
             F.coalesce(unknown_share, F.lit(0.0)) <= MAX_UNKNOWN_CATEGORY_SHARE),
        _row("distinct_years", F.col("years"), MIN_YEARS, F.col("years") >= MIN_YEARS),
    ]
    if date_col:
        share = F.coalesce(F.col("bad_dates") / F.col("dates"), F.lit(0.0))
        checks.append(_row("unparsed_date_share", share, MAX_UNPARSED_DATE_SHARE, share <= MAX_UNPARSED_DATE_SHARE))
    return a.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def subset_violations(recommended: DataFrame, allowed: DataFrame, key: str = "skill") -> DataFrame:
    """Q11: recommended items that are not in the allowed list (left anti join)."""
    return recommended.join(allowed.select(key), key, "left_anti")


def array_subset_violations(df: DataFrame, recommended: str, allowed: str, key: str = "skill") -> DataFrame:
    """Q11 when both lists sit on the same rows: items of ``recommended`` that
    appear in no row's ``allowed`` list. One pass: tag the elements of both
    arrays, explode once, aggregate per item (no self-join)."""
    tagged = F.concat(F.transform(F.coalesce(F.col(recommended), F.array().cast("array<string>")),
                                  lambda x: F.struct(x.alias("v"), F.lit(True).alias("rec"))),
                      F.transform(F.coalesce(F.col(allowed), F.array().cast("array<string>")),
                                  lambda x: F.struct(x.alias("v"), F.lit(False).alias("rec"))))
    items = df.select(F.explode(tagged).alias("t")).groupBy(F.col("t.v").alias(key)).agg(
        F.max(F.col("t.rec").cast("int")).alias("_rec"), F.min(F.col("t.rec").cast("int")).alias("_only_rec"))
    return items.filter((F.col("_rec") == 1) & (F.col("_only_rec") == 1)).select(key)


def nonempty(df: DataFrame) -> bool:
    """Q12: the table has at least one row (reads at most one row)."""
    return df.limit(1).count() > 0


class StepLog:
    """Row counts at named steps of a plan, gathered with
    ``DataFrame.observe`` while the plan's own action runs (no extra pass).

    ``df = log.step("dedup", df)`` marks a step; after an action on a frame
    built from the marked ones, ``log.rows()`` gives (step, rows, empty).
    """

    def __init__(self, name: str = "steps"):
        self.name = name
        self._obs: list[tuple[str, object]] = []

    def step(self, label: str, df: DataFrame) -> DataFrame:
        from pyspark.sql import Observation
        obs = Observation(f"{self.name}:{label}:{len(self._obs)}")
        self._obs.append((label, obs))
        return df.observe(obs, F.count(F.lit(1)).alias("rows"))

    def rows(self) -> list[tuple[str, int, bool]]:
        out = []
        for label, obs in self._obs:
            n = int(obs.get["rows"])
            out.append((label, n, n == 0))
        return out


def logged_clean_primary(skills: DataFrame, jobs: DataFrame, ordinal: str = "ordinal") -> tuple[DataFrame, StepLog]:
    """C16 with its step log: skill rows in, and cleaned rows out (after key
    repair, de-duplication and the metadata join)."""
    from demandlens.operators import cleaning
    log = StepLog("clean_primary")
    skills = log.step("skills_in", skills)
    out = log.step("cleaned", cleaning.clean_primary(skills, jobs, ordinal))
    return out, log
