"""Forecast cases: direction thresholds, minimum points, floor, least squares, t table."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlens.operators import forecast


def _series(spark, points):
    return spark.createDataFrame([(s, y, v) for s, pts in points.items() for y, v in pts],
                                 "skill string, year long, y long")


@pytest.mark.parametrize("value,label", [(111, "Rising ^"), (110, "Stable ->"), (90, "Stable ->"),
                                         (89, "Declining v")])
def test_direction_thresholds(spark, value, label):
    r = spark.range(1).select(forecast.direction(F.lit(float(value)), F.lit(100)).alias("d")).first()
    assert r.d == label


def test_minimum_points_and_polyfit(spark):
    pts = {"five": [(2020 + i, v) for i, v in enumerate([10, 12, 15, 15, 19])],
           "four": [(2020 + i, v) for i, v in enumerate([1, 2, 3, 4])]}
    got = {r.skill: r for r in forecast.linear_forecast(_series(spark, pts)).collect()}
    assert set(got) == {"five"}
    x = np.array([2020, 2021, 2022, 2023, 2024], dtype=float)
    slope, intercept = np.polyfit(x, np.array([10, 12, 15, 15, 19], dtype=float), 1)
    assert got["five"].slope == pytest.approx(slope, rel=1e-9)
    assert got["five"].forecast_year == 2025
    assert got["five"].forecast_value == pytest.approx(slope * 2025 + intercept, rel=1e-9)


def test_linear_floor_at_zero(spark):
    pts = {"down": [(2020 + i, v) for i, v in enumerate([50, 40, 30, 20, 5])]}
    r = forecast.linear_forecast(_series(spark, pts)).first()
    assert r.forecast_value == 0.0 and r.direction == "Declining v"


def _t_cdf(t, df, n=200000):
    # numeric integral of the Student t density from 0 to t, plus one half
    xs = np.linspace(0.0, t, n + 1)
    c = math.gamma((df + 1) / 2) / (math.sqrt(df * math.pi) * math.gamma(df / 2))
    ys = c * (1 + xs * xs / df) ** (-(df + 1) / 2)
    return 0.5 + float(np.trapezoid(ys, xs))


@pytest.mark.parametrize("df", [1, 2, 3, 5, 8, 13, 21, 30])
def test_t_table(df):
    assert _t_cdf(forecast.T90[df - 1], df) == pytest.approx(0.90, abs=2e-6)


def test_interval_contains_forecast_and_tier(spark):
    pts = {"steady": [(2020 + i, v) for i, v in enumerate([100, 104, 107, 111, 116, 118, 123])],
           "noisy": [(2020 + i, v) for i, v in enumerate([5, 40, 2, 35, 1, 30, 3])]}
    got = {r.skill: r for r in forecast.interval_forecast(_series(spark, pts)).collect()}
    s = got["steady"]
    assert s.method == "linear_interval" and s.ci_lower <= s.forecast_value <= s.ci_upper
    assert got["noisy"].method == "linear_trend" and got["noisy"].ci_lower is None


def test_share_measure_and_verified_top(spark):
    rows = [(2020 + i % 5, "a") for i in range(10)] + [(2020 + i % 5, "b") for i in range(5)] + [(None, "c")] * 20
    df = spark.createDataFrame(rows, "posted_year int, skill string")
    got = {r.skill: r for r in forecast.top_skill_forecasts(df, k=2, measure="share").collect()}
    assert set(got) == {"a"}  # "c" is in the top 2 over all rows but has no numeric year
    assert got["a"].forecast_value == pytest.approx(2 / 3)
    verified = {r.skill for r in forecast.top_skill_forecasts(df, k=2, top_from_verified=True).collect()}
    assert verified == {"a", "b"}
