"""Piecewise-linear yearly forecasts (P4, P5): a trend that may bend once.

For every series and every candidate year t the least-squares fit of
a + b x + d max(0, x - t) has a closed form: the hinge is cleared of the line (its
sums with 1 and x are taken out), and what it then explains is its share of the
line's squared error. So one aggregate by (series, t) gives all fits of all series
at once, and the best one a second by series. A bend is kept only where it pays for
its two parameters: n ln(SSE line / SSE bent) > ``PENALTY`` ln n, the Bayesian
information criterion. The 80 % interval is that of the residuals, with the
degrees of freedom that are left. It is this model, not an additive one; results
are labelled ``piecewise_linear``, ``linear_interval`` or, where the interval is
wider than 1.5 times the forecast, ``linear_trend`` with the plain line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.operators.forecast import (
    FORECAST_HORIZON_YEARS,
    MIN_DATAPOINTS_REQUIRED,
    WIDTH_FALLBACK_RATIO,
    direction,
    t_quantile_90,
)

#: Parameters that a bend costs: how much the slope changes, and when.
PENALTY = 2.0
#: Part of a series' span within which it may bend.
REACH = 0.8
#: Squared errors below this share of the series' variation are rounding.
EXACT = 1e-12


def fits(series: DataFrame, min_points: int = MIN_DATAPOINTS_REQUIRED) -> DataFrame:
    """One row per series (skill, year, y) and candidate year, with the sums that
    the closed form takes. x counts from the first year, so that nothing cancels."""
    span = (series.groupBy("skill").agg(F.count(F.lit(1)).alias("n"), F.min("year").alias("first"), F.max("year").alias("last"), F.max_by("y", "year").alias("last_y"))
            .where(F.col("n") >= min_points))
    end = F.floor(F.lit(REACH) * (F.col("last") - F.col("first"))).cast("bigint")
    # candidate 0 stands for the line: its hinge is the line itself
    candidates = F.explode(F.when(end >= 1, F.sequence(F.lit(0).cast("bigint"), end)).otherwise(F.array(F.lit(0).cast("bigint"))))
    rows = series.join(span, "skill").select("skill", "n", "first", "last", "last_y", (F.col("year") - F.col("first")).cast("double").alias("x"),
                                             F.col("y").cast("double").alias("y"), candidates.alias("t"))
    h = F.greatest(F.lit(0.0), F.col("x") - F.col("t"))
    sums = {"x": F.col("x"), "y": F.col("y"), "h": h, "xx": F.col("x") * F.col("x"), "xy": F.col("x") * F.col("y"), "yy": F.col("y") * F.col("y"),
            "hx": h * F.col("x"), "hh": h * h, "hy": h * F.col("y")}
    total = rows.groupBy("skill", "n", "first", "last", "last_y", "t").agg(*[F.sum(c).alias(f"s{k}") for k, c in sums.items()])
    n = F.col("n")

    def centred(a: str, b: str) -> Column:
        return F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / n

    total = total.withColumns({f"c{a}{b}": centred(a, b) for a, b in ("xx", "xy", "yy", "hx", "hh", "hy")})
    total = total.withColumns({"hh_x": F.col("chh") - F.col("chx") * F.col("chx") / F.col("cxx"), "hy_x": F.col("chy") - F.col("chx") * F.col("cxy") / F.col("cxx"),
                               "line": F.greatest(F.lit(0.0), F.col("cyy") - F.col("cxy") * F.col("cxy") / F.col("cxx"))})
    bend = F.when((F.col("t") > 0) & (F.col("hh_x") > 1e-9), F.col("hy_x") / F.col("hh_x")).otherwise(0.0)
    return total.withColumn("bend", bend).withColumn("error", F.greatest(F.lit(0.0), F.col("line") - F.col("bend") * F.col("hy_x")))


def piecewise_forecast(series: DataFrame, min_points: int = MIN_DATAPOINTS_REQUIRED, penalty: float = PENALTY) -> DataFrame:
    """Per series: where it bends (null: nowhere), the slopes before and after, the
    next year's value (not below 0) with its interval, method and direction."""
    all_fits = fits(series, min_points)
    n = F.col("n")
    pays = ((F.col("t") > 0) & (F.col("line") > EXACT * F.col("cyy"))
            & (F.col("error") * F.pow(n.cast("double"), F.lit(penalty) / n) < F.col("line")))
    # the line, or the bend that leaves least; the earliest of equal ones
    ranked = all_fits.withColumn("rank", F.when(pays, F.col("error")).when(F.col("t") == 0, F.lit(float("inf"))))
    others = [c for c in ranked.columns if c != "skill"]
    best = ranked.where("rank is not null").groupBy("skill").agg(F.min_by(F.struct(*others), F.struct("rank", "t")).alias("f")).select("skill", "f.*")
    x = (F.col("last") - F.col("first") + FORECAST_HORIZON_YEARS).cast("double")
    bent = F.col("t") > 0
    u = x - F.col("sx") / n
    v = F.when(bent, (x - F.col("t")) - F.col("sh") / n - F.col("chx") / F.col("cxx") * u).otherwise(0.0)
    slope = (F.col("cxy") - F.when(bent, F.col("bend") * F.col("chx")).otherwise(0.0)) / F.col("cxx")
    best = best.withColumn("slope", slope)
    mean = F.col("sy") / n + F.col("slope") * u + F.when(bent, F.col("bend") * ((x - F.col("t")) - F.col("sh") / n)).otherwise(0.0)
    plain = F.col("sy") / n + F.col("cxy") / F.col("cxx") * u  # the line's forecast
    free = n - F.when(bent, 4).otherwise(2)
    reach = 1 + 1 / n + u * u / F.col("cxx") + F.when(bent, v * v / F.col("hh_x")).otherwise(0.0)
    half = F.when(free > 0, t_quantile_90(free) * F.sqrt(F.col("error") / free) * F.sqrt(reach))
    out = best.withColumns({"raw": mean, "half": half, "line_value": F.greatest(F.lit(0.0), plain)})
    low, high = F.greatest(F.lit(0.0), F.col("raw") - F.col("half")), F.col("raw") + F.col("half")
    out = out.withColumn("wide", F.col("half").isNull() | ((high - low) > F.greatest(F.lit(0.0), F.col("raw")) * WIDTH_FALLBACK_RATIO))
    wide = F.col("wide")
    value = F.when(wide, F.col("line_value")).otherwise(F.greatest(F.lit(0.0), F.col("raw")))
    kept = bent & ~wide
    return (out.withColumn("forecast_value", value).select(
        "skill", n.cast("int").alias("n_points"), F.when(kept, F.col("first") + F.col("t")).cast("int").alias("bends_in"),
        F.when(wide, F.col("cxy") / F.col("cxx")).otherwise(F.col("slope")).alias("slope"), F.when(kept, F.col("slope") + F.col("bend")).alias("slope_after"),
        (F.col("last") + FORECAST_HORIZON_YEARS).cast("int").alias("forecast_year"), "forecast_value",
        F.when(~wide, low).alias("ci_lower"), F.when(~wide, high).alias("ci_upper"),
        F.when(wide, "linear_trend").when(bent, "piecewise_linear").otherwise("linear_interval").alias("method"),
        direction(F.col("forecast_value"), F.col("last_y")).alias("direction")))
