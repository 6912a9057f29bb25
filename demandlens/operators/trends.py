"""Yearly and monthly trends.

Everything is computed on the aggregated ``(year, skill)`` table, whose size
is years x vocabulary, never on raw mentions twice: one scan, one partial
aggregation, and per-year totals from a window over that small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlens.operators.frequency import year_skill_counts
from demandlens.session import checkpointed

# Trending score weights, recent-year window, and top-n.
TREND_WEIGHT_RECENT = 0.55
TREND_WEIGHT_CHANGE = 0.30
TREND_WEIGHT_OVERALL = 0.15
TREND_RECENT_YEARS = 2
TREND_TOP_N = 20
# The fallback trending list used when the data is empty.
PRIMARY_TREND_SKILLS = [
    "aws", "gcp", "tensorflow", "azure", "scikit-learn", "nlp", "python", "sql",
    "computer vision", "r", "pytorch",
]


def annual_share(df: DataFrame, year: str = "posted_year", skill: str = "skill") -> DataFrame:
    """(posted_year, skill, mentions, year_total, share).

    Rows with a null year are dropped; a null skill stays a group and counts in
    its year's total. The aggregate is written once (this runs a job), so
    whatever is built on it reads years x vocabulary rows, not the input.
    """
    annual = (df.filter(F.col(year).isNotNull())
                .groupBy(F.col(year).alias("posted_year"), F.col(skill).alias("skill"))
                .agg(F.count(F.lit(1)).alias("mentions")))
    return with_year_share(checkpointed(annual))


def with_year_share(annual: DataFrame) -> DataFrame:
    """Add year_total and share to (posted_year, skill, mentions) rows.

    Per-year totals come from the aggregated rows (no second scan of the
    input): one row per year, a calendar-bounded table, broadcast back. A
    window by year would put a whole year's vocabulary into one task.
    """
    totals = annual.groupBy("posted_year").agg(F.sum("mentions").alias("year_total"))
    return (annual.join(F.broadcast(totals), "posted_year")
                  .withColumn("share", F.col("mentions") / F.col("year_total")))


def first_last_change(annual: DataFrame, first_year: int | None = None,
                      last_year: int | None = None, k: int = 5) -> DataFrame:
    """Share change in percentage points from the first to the last year;
    the k most rising and k most declining skills (ties by name).

    Years default to the data's min and max (the reference hard-codes them).
    A skill missing in either year has a null change and ranks last.
    Returns (skill, share_first, share_last, change_pp, direction, rank).
    """
    fy = F.lit(first_year) if first_year is not None else annual.agg(F.min("posted_year")).scalar()
    ly = F.lit(last_year) if last_year is not None else annual.agg(F.max("posted_year")).scalar()
    wide = (annual.filter(F.col("skill").isNotNull())
                  .groupBy("skill")
                  .agg(F.max(F.when(F.col("posted_year") == fy, F.col("share"))).alias("share_first"),
                       F.max(F.when(F.col("posted_year") == ly, F.col("share"))).alias("share_last"))
                  .withColumn("change_pp", (F.col("share_last") - F.col("share_first")) * 100))
    rising = wide.orderBy(F.desc_nulls_last("change_pp"), F.asc("skill")).limit(k)
    declining = wide.orderBy(F.asc_nulls_last("change_pp"), F.asc("skill")).limit(k)
    # the two lists hold k rows each; ranking them is local work
    rw = Window.orderBy(F.desc_nulls_last("change_pp"), F.asc("skill"))
    dw = Window.orderBy(F.asc_nulls_last("change_pp"), F.asc("skill"))
    return (rising.withColumn("direction", F.lit("rising")).withColumn("rank", F.row_number().over(rw))
            .unionByName(declining.withColumn("direction", F.lit("declining"))
                         .withColumn("rank", F.row_number().over(dw))))


def focus_series(annual: DataFrame, changes: DataFrame) -> DataFrame:
    """Yearly series of the rising and declining skills, each skill once."""
    focus = changes.select("skill").distinct()  # at most 2k rows
    return annual.join(F.broadcast(focus), "skill", "left_semi").select(
        "posted_year", "skill", "mentions", "share")


def trend_cards(annual: DataFrame) -> DataFrame:
    """Per skill: points, first/last year, latest share, change since
    the first year in pp, and the peak year (earliest year on a tie)."""
    return (annual.filter(F.col("skill").isNotNull())
                  .groupBy("skill")
                  .agg(F.count(F.lit(1)).alias("n_points"),
                       F.min("posted_year").alias("first_year"),
                       F.max("posted_year").alias("last_year"),
                       F.min_by("share", "posted_year").alias("first_share"),
                       F.max_by("share", "posted_year").alias("latest_share"),
                       F.max_by("posted_year", F.struct(F.col("share"), -F.col("posted_year"))).alias("peak_year"),
                       F.max("share").alias("peak_share"))
                  .withColumn("change_pp", (F.col("latest_share") - F.col("first_share")) * 100))


def trending_score(df: DataFrame, top_n: int = TREND_TOP_N, year: str = "posted_year",
                   weight: str | None = None) -> DataFrame:
    """Trending score = 0.55 * mean share over the data's years within the
    last 3 (a missing skill-year counts 0) + 0.30 * max(last - first share, 0)
    + 0.15 * overall share of mentions. Top-n by score, ties by name.

    Skills are stripped and lower-cased; rows without a numeric year are
    dropped first. When no row has a numeric year the skills are ranked by
    plain frequency instead (score columns null). The zero fill needs no years x skills grid: a mean with
    zeros is the sum over present years divided by the number of recent years.
    """
    rows = df.select(F.lower(F.regexp_replace("skill", r"^\s+|\s+$", "")).alias("skill"),
                     F.col(year).cast("string").try_cast("double").cast("int").alias("posted_year"),
                     *([weight] if weight else []))
    # years x vocabulary, the null year kept for the fallback: the one read of the input
    counts = checkpointed(year_skill_counts(rows, weight=weight))
    annual = with_year_share(counts.filter(F.col("posted_year").isNotNull()))
    # Both scalars come from the aggregated table and merge into one job: the
    # sorted distinct years (a calendar-bounded list) and the rows with a skill.
    years = annual.agg(F.sort_array(F.collect_set("posted_year"))).scalar()
    n_rows_with_skill = annual.agg(F.sum(F.when(F.col("skill").isNotNull(), F.col("mentions")))).scalar()
    scope = (annual.filter(F.col("skill").isNotNull())
                   .withColumn("_years", years)
                   .withColumn("_last", F.array_max("_years"))
                   .withColumn("_first", F.array_min("_years")))
    recent = F.col("posted_year") >= F.col("_last") - TREND_RECENT_YEARS
    per_skill = (scope.groupBy("skill")
                 .agg(F.sum(F.when(recent, F.col("share"))).alias("recent_sum"),
                      F.coalesce(F.max(F.when(F.col("posted_year") == F.col("_last"), F.col("share"))),
                                 F.lit(0.0)).alias("share_last"),
                      F.coalesce(F.max(F.when(F.col("posted_year") == F.col("_first"), F.col("share"))),
                                 F.lit(0.0)).alias("share_first"),
                      F.sum("mentions").alias("mentions"),
                      F.first(F.size(F.filter("_years", lambda y: y >= F.col("_last") - TREND_RECENT_YEARS)))
                       .alias("n_recent")))
    scored = per_skill.select(
        "skill",
        (F.coalesce(F.col("recent_sum"), F.lit(0.0)) / F.col("n_recent")).alias("recent_share"),
        (F.col("share_last") - F.col("share_first")).alias("share_change"),
        (F.col("mentions") / n_rows_with_skill).alias("overall_share"),
    ).withColumn(
        "score",
        F.col("recent_share") * TREND_WEIGHT_RECENT
        + F.greatest(F.col("share_change"), F.lit(0.0)) * TREND_WEIGHT_CHANGE
        + F.col("overall_share") * TREND_WEIGHT_OVERALL,
    )
    top = (scored.orderBy(F.desc("score"), F.asc("skill")).limit(top_n)
                 .withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("skill")))))
    # No numeric year anywhere: rank by plain frequency instead (the scored
    # branch is then empty). The switch is a scalar test, so both branches
    # stay in one lazy plan.
    no_years = F.size(years) == 0
    by_count = (counts.filter(no_years & F.col("skill").isNotNull()).groupBy("skill")
                        .agg(F.sum("mentions").alias("mentions"))
                        .orderBy(F.desc("mentions"), F.asc("skill")).limit(top_n)
                        .select("skill",
                                *[F.lit(None).cast("double").alias(c)
                                  for c in ("recent_share", "share_change", "overall_share", "score")],
                                F.row_number().over(Window.orderBy(F.desc("mentions"), F.asc("skill"))).alias("rank")))
    return top.unionByName(by_count)


def monthly_change(df: DataFrame, date: str = "order_date", k: int = 5) -> DataFrame:
    """Mentions per (yyyy-MM, skill); the count change from the first to the
    last month of the data, for skills present in both; top and bottom k.
    Returns (skill, first_count, last_count, delta, direction, rank)."""
    monthly = checkpointed(  # months x vocabulary, read by the subqueries
        df.filter(F.col(date).isNotNull() & F.col("skill").isNotNull())
          .groupBy(F.date_format(date, "yyyy-MM").alias("month"), "skill")
          .agg(F.count(F.lit(1)).alias("mentions")))
    first_m = monthly.agg(F.min("month")).scalar()
    last_m = monthly.agg(F.max("month")).scalar()
    both = (monthly.filter((F.col("month") == first_m) | (F.col("month") == last_m))
                   .groupBy("skill")
                   .agg(F.max(F.when(F.col("month") == first_m, F.col("mentions"))).alias("first_count"),
                        F.max(F.when(F.col("month") == last_m, F.col("mentions"))).alias("last_count"))
                   .filter(F.col("first_count").isNotNull() & F.col("last_count").isNotNull())
                   .withColumn("delta", F.col("last_count") - F.col("first_count")))
    up = both.orderBy(F.desc("delta"), F.asc("skill")).limit(k)
    down = both.orderBy(F.asc("delta"), F.asc("skill")).limit(k)
    return (up.withColumn("direction", F.lit("rising"))
              .withColumn("rank", F.row_number().over(Window.orderBy(F.desc("delta"), F.asc("skill"))))
            .unionByName(down.withColumn("direction", F.lit("declining"))
                         .withColumn("rank", F.row_number().over(Window.orderBy(F.asc("delta"), F.asc("skill"))))))


def monthly_counts(df: DataFrame, date: str = "order_date") -> DataFrame:
    """A17 series: (month 'yyyy-MM', skill, mentions)."""
    return (df.filter(F.col(date).isNotNull())
              .groupBy(F.date_format(date, "yyyy-MM").alias("month"), "skill")
              .agg(F.count(F.lit(1)).alias("mentions")))
