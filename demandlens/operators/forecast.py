"""Yearly demand forecasts (P1-P8), all skills in one grouped aggregate.

The reference loops over skills in Python and fits one model per skill. Here
each skill's series is reduced to its sufficient statistics (n, Sx, Sy, Sxx,
Sxy, Syy) by one ``groupBy``, and the least-squares line, the next-year value,
the prediction interval and the direction are column expressions over that
one row per skill. The integer sums are exact, so the slope is the exact
least-squares slope regardless of how the rows were partitioned.

The reference's additive-model branch (with an 80 % interval) is re-aimed as
the closed-form OLS prediction interval at 80 %; it is labelled
``linear_interval`` and is not the same model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.operators.frequency import top_of_counts, year_skill_counts
from demandlens.session import checkpointed

# Minimum points, horizon, interval width rule, direction
# thresholds and labels.
MIN_DATAPOINTS_REQUIRED = 5
FORECAST_HORIZON_YEARS = 1
WIDTH_FALLBACK_RATIO = 1.5
DIRECTION_THRESHOLD_PCT = 10
RISING, DECLINING, STABLE = "Rising ^", "Declining v", "Stable ->"

# Student t quantiles t(0.90, df) for df = 1..30 (two-sided 80 %
# interval), and the normal quantile that they tend to.
T90 = [
    3.077684, 1.885618, 1.637744, 1.533206, 1.475884, 1.439756, 1.414924, 1.396815,
    1.383029, 1.372184, 1.363430, 1.356217, 1.350171, 1.345030, 1.340606, 1.336757,
    1.333379, 1.330391, 1.327728, 1.325341, 1.323188, 1.321237, 1.319460, 1.317836,
    1.316345, 1.314972, 1.313703, 1.312527, 1.311434, 1.310415,
]
Z90 = 1.2815515655446004


def yearly_series(df: DataFrame, skills: DataFrame | None = None, year: str = "posted_year",
                  measure: str = "count") -> DataFrame:
    """(skill, year, y) on rows with a numeric year, optionally only for
    the skills in ``skills`` (a bounded list). ``measure='count'`` (default)
    gives mention counts; ``'share'`` the skill's share of the year's mentions
    (the documented alternative)."""
    base = df.filter(F.col(year).isNotNull())
    rows = base.filter(F.col("skill").isNotNull())
    if skills is not None:
        rows = rows.join(skills, "skill", "left_semi")
    counts = (rows.groupBy("skill", F.col(year).cast("bigint").alias("year"))
                  .agg(F.count(F.lit(1)).alias("y")))
    if measure == "count":
        return counts
    if measure != "share":
        raise ValueError(f"unknown measure {measure!r}")
    # year totals over all rows of the year (one row per year, broadcast back)
    totals = base.groupBy(F.col(year).cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("_total"))
    return (counts.join(totals, "year")
                  .select("skill", "year", (F.col("y") / F.col("_total")).alias("y")))


def series_stats(series: DataFrame) -> DataFrame:
    """Sufficient statistics per skill (exact integer sums) and the last point."""
    return series.groupBy("skill").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("year").alias("sx"),
        F.sum("y").alias("sy"),
        F.sum(F.col("year") * F.col("year")).alias("sxx"),
        F.sum(F.col("year") * F.col("y")).alias("sxy"),
        F.sum(F.col("y").cast("double") * F.col("y")).alias("syy"),
        F.max("year").alias("last_year"),
        F.max_by("y", "year").alias("last_y"),
    )


def _slope(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column) -> Column:
    return (n * sxy - sx * sy) / (n * sxx - sx * sx)


def direction(value: Column, last_actual: Column) -> Column:
    """% change from the last actual (divided by max(last, 1))."""
    pct = (value - last_actual) / F.greatest(last_actual, F.lit(1)) * 100
    return (F.when(pct > DIRECTION_THRESHOLD_PCT, F.lit(RISING))
             .when(pct < -DIRECTION_THRESHOLD_PCT, F.lit(DECLINING))
             .otherwise(F.lit(STABLE)))


def linear_forecast(series: DataFrame, min_points: int = MIN_DATAPOINTS_REQUIRED) -> DataFrame:
    """Least-squares line per skill with >= min_points years; the
    next year's value floored at 0, and its direction."""
    st = series_stats(series).filter(F.col("n") >= min_points)
    n, sx, sy, sxx, sxy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy"))
    slope = _slope(n, sx, sy, sxx, sxy)
    out = (st.withColumn("slope", slope)
             .withColumn("intercept", (sy - F.col("slope") * sx) / n)
             .withColumn("forecast_year", (F.col("last_year") + FORECAST_HORIZON_YEARS).cast("int"))
             .withColumn("forecast_value",
                         F.greatest(F.lit(0.0), F.col("slope") * F.col("forecast_year") + F.col("intercept"))))
    return out.withColumn("direction", direction(F.col("forecast_value"), F.col("last_y")))


def t_quantile_90(dof: Column) -> Column:
    """t(0.90, dof) from the fixed table; beyond it the expansion of the
    quantile around the normal one in powers of 1 / dof."""
    table = F.array(*[F.lit(v) for v in T90])
    z = Z90
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    far = F.lit(z)
    for k, c in enumerate(terms, 1):
        far = far + F.lit(c) / F.pow(dof.cast("double"), k)
    return (F.when(dof <= 0, F.lit(None).cast("double"))
             .when(dof <= len(T90), F.element_at(table, dof.cast("int")))
             .otherwise(far))


def interval_forecast(series: DataFrame, min_points: int = MIN_DATAPOINTS_REQUIRED) -> DataFrame:
    """Linear forecast with an 80 % OLS prediction interval.

    yhat and the lower bound are clipped at 0, the upper bound is not. When the
    interval is wider than 1.5 x yhat the plain linear forecast is reported
    (``linear_trend``, no interval); otherwise ``linear_interval``.
    """
    f = linear_forecast(series, min_points)
    n = F.col("n")
    sxx_c = (n * F.col("sxx") - F.col("sx") * F.col("sx")) / n
    sxy_c = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / n
    syy_c = F.col("syy") - F.col("sy").cast("double") * F.col("sy") / n
    sse = F.greatest(F.lit(0.0), syy_c - F.col("slope") * sxy_c)
    s = F.sqrt(sse / (n - 2))
    xbar = F.col("sx") / n
    se = s * F.sqrt(1 + 1 / n + F.pow(F.col("forecast_year") - xbar, 2) / sxx_c)
    half = t_quantile_90(n - 2) * se
    raw = F.col("slope") * F.col("forecast_year") + F.col("intercept")
    f = (f.withColumn("ci_lower", F.greatest(F.lit(0.0), raw - half))
          .withColumn("ci_upper", raw + half))
    f = f.withColumn("_wide", (F.col("ci_upper") - F.col("ci_lower")) > F.col("forecast_value") * WIDTH_FALLBACK_RATIO)
    wide = F.col("_wide")
    return (f.withColumn("method", F.when(wide, F.lit("linear_trend")).otherwise(F.lit("linear_interval")))
             .withColumn("ci_lower", F.when(wide, F.lit(None)).otherwise(F.col("ci_lower")))
             .withColumn("ci_upper", F.when(wide, F.lit(None)).otherwise(F.col("ci_upper")))
             .drop("_wide"))


def top_skill_forecasts(df: DataFrame, k: int = 10, year: str = "posted_year",
                        with_interval: bool = False, top_from_verified: bool = False,
                        measure: str = "count") -> DataFrame:
    """Forecasts for the k most mentioned skills, counted over all rows
    (default) or only over rows with a numeric year (``top_from_verified``)."""
    series = top_skill_series(df, k, year, top_from_verified, measure)
    return interval_forecast(series) if with_interval else linear_forecast(series)


def top_skill_series(df: DataFrame, k: int = 10, year: str = "posted_year", top_from_verified: bool = False,
                     measure: str = "count") -> DataFrame:
    """P7's series: the top list and the counts from one (year, skill) aggregate."""
    counts = checkpointed(year_skill_counts(df, year))
    known = counts.filter(F.col("posted_year").isNotNull())
    top = top_of_counts(known if top_from_verified else counts, k)
    series = (known.join(F.broadcast(top), "skill", "left_semi")  # <= k rows
                   .select("skill", F.col("posted_year").cast("bigint").alias("year"), F.col("mentions").alias("y")))
    if measure == "count":
        return checkpointed(series)  # k skills x years, read by the chart and the forecast
    if measure != "share":
        raise ValueError(f"unknown measure {measure!r}")
    totals = known.groupBy(F.col("posted_year").cast("bigint").alias("year")).agg(F.sum("mentions").alias("_total"))
    return checkpointed(series.join(totals, "year").select("skill", "year", (F.col("y") / F.col("_total")).alias("y")))


def chart_feed(series: DataFrame, forecasts: DataFrame) -> DataFrame:
    """History and forecast rows in one table, tagged by ``kind``."""
    hist = series.join(forecasts.select("skill"), "skill", "left_semi").select(
        "skill", F.lit("history").alias("kind"), F.col("year").cast("int").alias("year"),
        F.col("y").cast("double").alias("value"),
        F.lit(None).cast("double").alias("ci_lower"), F.lit(None).cast("double").alias("ci_upper"),
        F.lit(None).cast("string").alias("method"))
    fc = forecasts.select(
        "skill", F.lit("forecast").alias("kind"), F.col("forecast_year").alias("year"),
        F.col("forecast_value").alias("value"), "ci_lower", "ci_upper", "method")
    return hist.unionByName(fc)
