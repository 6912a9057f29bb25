"""Frequency, share and summary measures.

Counts are grouped aggregates (partial aggregation map-side, so a hot skill
costs one row per partition, not one row per mention). Totals are scalar
subqueries: Spark runs them as their own small job and inlines the value, so
no join and no single-task window is needed for a global share. Top-N uses
``orderBy(...).limit(n)``, a distributed top-k that merges n rows per task.
Ties are broken by name, ascending, everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.session import checkpointed


def skill_counts(df: DataFrame, skill: str = "skill") -> DataFrame:
    """(skill, mentions) for every non-null skill."""
    return (df.filter(F.col(skill).isNotNull())
              .groupBy(F.col(skill).alias("skill"))
              .agg(F.count(F.lit(1)).alias("mentions")))


def top_skills(df: DataFrame, n: int | None = 20, skill: str = "skill") -> DataFrame:
    """Top-n skills with their share of all mentions, ranked.

    ``n=None`` keeps every skill (the word-weight feed, A25).
    """
    counts = checkpointed(skill_counts(df, skill))  # vocabulary-sized; read by the total and the list
    total = counts.agg(F.sum("mentions")).scalar()
    ranked = counts.orderBy(F.desc("mentions"), F.asc("skill"))
    if n is not None:
        ranked = ranked.limit(n)
    return ranked.select(
        "skill", "mentions",
        (F.col("mentions") * 100.0 / total).alias("share_pct"),
    )


def top_skill_list(df: DataFrame, n: int, skill: str = "skill") -> DataFrame:
    """The top-n skill names alone: a list of at most n rows, safe to broadcast."""
    return (skill_counts(df, skill).orderBy(F.desc("mentions"), F.asc("skill"))
            .limit(n).select("skill"))


def year_skill_counts(df: DataFrame, year: str = "posted_year", skill: str = "skill",
                      weight: str | None = None) -> DataFrame:
    """(posted_year, skill, mentions), null years and skills as groups of their
    own: the one aggregate that top lists, totals and series are read from.
    ``weight`` names a column of row counts where ``df`` is counted already."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.groupBy(F.col(year).alias("posted_year"), F.col(skill).alias("skill")).agg(n.alias("mentions"))


def top_of_counts(counts: DataFrame, n: int, by: str = "mentions") -> DataFrame:
    """The n skills with the most mentions in a table of counts, ties by name."""
    return (counts.filter(F.col("skill").isNotNull()).groupBy("skill").agg(F.sum(by).alias("_n"))
            .orderBy(F.desc("_n"), F.asc("skill")).limit(n).select("skill"))


def category_counts(df: DataFrame, category: str = "skill_category") -> DataFrame:
    """A2: mentions per category; the null category stays a group of its own."""
    return (df.groupBy(F.col(category).alias("skill_category"))
              .agg(F.count(F.lit(1)).alias("mentions")))


def skill_category_top(df: DataFrame, n: int = 20) -> DataFrame:
    """A3: (skill, category) pair counts, top-n."""
    return (df.filter(F.col("skill").isNotNull())
              .groupBy("skill", "skill_category")
              .agg(F.count(F.lit(1)).alias("mentions"))
              .orderBy(F.desc("mentions"), F.asc("skill"), F.asc_nulls_first("skill_category"))
              .limit(n))


def top_skill_series(df: DataFrame, n: int = 5, year: str = "posted_year") -> DataFrame:
    """The top-n skills by total mentions, then their yearly counts."""
    annual = checkpointed(year_skill_counts(df, year))
    top = top_of_counts(annual, n)
    return (annual.filter(F.col("posted_year").isNotNull())
                  .join(F.broadcast(top), "skill", "left_semi"))  # at most n rows


def describe(df: DataFrame, year: str = "posted_year", matched: str | None = "job_id_job") -> DataFrame:
    """A4: one-row summary: rows, distinct jobs / skills / categories, the
    sorted list of numeric years, and rows matched to job metadata."""
    matched_expr = F.count(matched) if matched and matched in df.columns else F.lit(None).cast("bigint")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("job_id").alias("jobs"),
        F.countDistinct("skill").alias("skills"),
        F.countDistinct("skill_category").alias("skill_categories"),
        # distinct years: a handful of values, bounded by the calendar
        F.array_join(F.transform(F.sort_array(F.collect_set(F.col(year))), lambda y: y.cast("string")),
                     ",").alias("years"),
        matched_expr.alias("matched_rows"),
    )


def kpis(df: DataFrame, year: str = "posted_year") -> DataFrame:
    """A5-A10: dashboard KPI row.

    ``avg_distinct_skills_per_job`` (A5) averages distinct skills per job;
    ``avg_rows_per_job`` (A6) is rows / distinct jobs (0 when no job). The top
    skill and category take the most mentions, ties by name (A8).
    """
    # every card from one (job, skill, category, year) aggregate
    cells = checkpointed(df.groupBy("job_id", "skill", "skill_category", F.col(year).alias("year"))
                           .agg(F.count(F.lit(1)).alias("k")))
    per_job = cells.filter(F.col("skill").isNotNull()).groupBy("job_id").agg(F.countDistinct("skill").alias("k"))
    avg_distinct = per_job.agg(F.avg("k")).scalar()

    def leader(name: str) -> DataFrame:
        return (cells.filter(F.col(name).isNotNull()).groupBy(name).agg(F.sum("k").alias("mentions"))
                     .orderBy(F.desc("mentions"), F.asc(name)).limit(1))

    top_skill, top_cat = leader("skill"), leader("skill_category")
    base = cells.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("total_mentions"),
        F.countDistinct("skill").alias("distinct_skills"),
        F.countDistinct("job_id").alias("distinct_jobs"),
        F.min("year").alias("min_year"),
        F.max("year").alias("max_year"),
        F.countDistinct("year").alias("years_covered"),
    )
    return base.select(
        "total_mentions", "distinct_skills", "distinct_jobs", "min_year", "max_year",
        "years_covered",
        F.concat_ws(" - ", F.col("min_year").cast("string"), F.col("max_year").cast("string")).alias("year_span"),
        F.coalesce(F.try_divide(F.col("total_mentions").cast("double"), F.col("distinct_jobs")),
                   F.lit(0.0)).alias("avg_rows_per_job"),
        F.lit(avg_distinct).cast("double").alias("avg_distinct_skills_per_job"),
        F.lit(top_skill.select("skill").scalar()).alias("top_skill"),
        F.lit(top_skill.select("mentions").scalar()).alias("top_skill_mentions"),
        F.lit(top_cat.select("skill_category").scalar()).alias("top_category"),
        F.lit(top_cat.select("mentions").scalar()).alias("top_category_mentions"),
    )
