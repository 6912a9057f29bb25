"""Registered queries: yearly forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlens.operators import changepoint, forecast
from demandlens.plans.inputs import analysis_input, analysis_sql
from demandlens.plans.registry import query, rounded

T90_SQL = """[3.077684, 1.885618, 1.637744, 1.533206, 1.475884, 1.439756, 1.414924, 1.396815, 1.383029, 1.372184,
  1.363430, 1.356217, 1.350171, 1.345030, 1.340606, 1.336757, 1.333379, 1.330391, 1.327728, 1.325341,
  1.323188, 1.321237, 1.319460, 1.317836, 1.316345, 1.314972, 1.313703, 1.312527, 1.311434, 1.310415]"""

STATS_SQL = f"""
m AS ({analysis_sql("p_brand", ["posted_year"])}),
t AS (SELECT skill FROM m WHERE skill IS NOT NULL GROUP BY skill ORDER BY count(*) DESC, skill LIMIT 10),
s AS (SELECT skill, CAST(posted_year AS BIGINT) AS year, count(*) AS y FROM m
      WHERE posted_year IS NOT NULL AND skill IS NOT NULL AND skill IN (SELECT skill FROM t) GROUP BY ALL),
st AS (SELECT skill, count(*) AS n, sum(year) AS sx, sum(y) AS sy, sum(year * year) AS sxx, sum(year * y) AS sxy,
              sum(CAST(y AS DOUBLE) * y) AS syy, max(year) AS last_year, arg_max(y, year) AS last_y
       FROM s GROUP BY skill HAVING count(*) >= 5),
f0 AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope FROM st),
f1 AS (SELECT *, (sy - slope * sx) / n AS intercept, CAST(last_year + 1 AS INTEGER) AS forecast_year FROM f0),
f AS (SELECT *, greatest(0.0, slope * forecast_year + intercept) AS forecast_value FROM f1),
fd AS (SELECT *, CASE WHEN (forecast_value - last_y) / greatest(last_y, 1) * 100 > 10 THEN 'Rising ^'
                      WHEN (forecast_value - last_y) / greatest(last_y, 1) * 100 < -10 THEN 'Declining v'
                      ELSE 'Stable ->' END AS direction FROM f)"""


@query("yearly_forecast", "P1 P2 P3 P6 P7 C13", f"""
WITH {STATS_SQL}
SELECT skill, 'linear_trend' AS method, forecast_year, forecast_value, slope, intercept,
       n AS n_points, last_y AS last_actual, direction FROM fd""")
def q_yearly_forecast(spark, sf_dir):
    f = forecast.top_skill_forecasts(analysis_input(spark, sf_dir, "p_brand", ["posted_year"]), k=10)
    return f.select("skill", F.lit("linear_trend").alias("method"), "forecast_year", "forecast_value",
                    "slope", "intercept", F.col("n").alias("n_points"), F.col("last_y").alias("last_actual"),
                    "direction")


INTERVAL_SQL = f"""
WITH {STATS_SQL},
iv AS (SELECT *, slope * forecast_year + intercept AS raw,
              CASE WHEN n - 2 <= 0 THEN NULL WHEN n - 2 <= 30 THEN list_extract({T90_SQL}, CAST(n - 2 AS INTEGER))
                   END
              * sqrt(greatest(0.0, (syy - CAST(sy AS DOUBLE) * sy / n) - slope * ((n * sxy - sx * sy) / n)) / (n - 2))
              * sqrt(1 + 1 / n + power(forecast_year - sx / n, 2) / ((n * sxx - sx * sx) / n)) AS half FROM fd),
b AS (SELECT *, greatest(0.0, raw - half) AS lo, raw + half AS hi FROM iv),
w AS (SELECT *, (hi - lo) > forecast_value * 1.5 AS wide FROM b),
fc AS (SELECT skill, 'forecast' AS kind, forecast_year AS year, forecast_value AS value,
              CASE WHEN wide THEN NULL ELSE lo END AS ci_lower, CASE WHEN wide THEN NULL ELSE hi END AS ci_upper,
              CASE WHEN wide THEN 'linear_trend' ELSE 'linear_interval' END AS method FROM w)"""


@query("forecast_interval", "P4 P5 P8", f"""
{INTERVAL_SQL}
SELECT skill, kind, year, round(value, 6) AS value, round(ci_lower, 6) AS ci_lower, round(ci_upper, 6) AS ci_upper,
       method FROM fc
UNION ALL
SELECT skill, 'history' AS kind, CAST(year AS INTEGER) AS year, round(CAST(y AS DOUBLE), 6) AS value,
       NULL::DOUBLE AS ci_lower, NULL::DOUBLE AS ci_upper, NULL::VARCHAR AS method
FROM s WHERE skill IN (SELECT skill FROM fc)""")
def q_forecast_interval(spark, sf_dir):
    df = analysis_input(spark, sf_dir, "p_brand", ["posted_year"])
    series = forecast.top_skill_series(df, 10)
    feed = forecast.chart_feed(series, forecast.interval_forecast(series))
    return feed.withColumns({c: F.round(c, 6) for c in ("value", "ci_lower", "ci_upper")})


PIECEWISE_SQL = f"""
WITH m AS ({analysis_sql("p_name", ["posted_year"])}),
s AS (SELECT skill, CAST(posted_year AS BIGINT) AS year, CAST(count(*) AS DOUBLE) AS y FROM m
      WHERE posted_year IS NOT NULL AND skill IS NOT NULL GROUP BY ALL),
sp AS (SELECT skill, count(*) AS n, min(year) AS first, max(year) AS last, arg_max(y, year) AS last_y FROM s GROUP BY skill HAVING count(*) >= 5),
k AS (SELECT sp.*, CAST(s.year - first AS DOUBLE) AS x, s.y, unnest(range(0, greatest(0, CAST(floor(0.8 * (last - first)) AS BIGINT)) + 1)) AS t
      FROM s JOIN sp USING (skill)),
h AS (SELECT *, greatest(0.0, x - t) AS h FROM k),
a AS (SELECT skill, n, first, last, last_y, t, avg(x) AS mx, avg(y) AS my, avg(h) AS mh,
             sum(x * x) - sum(x) * sum(x) / n AS xx, sum(x * y) - sum(x) * sum(y) / n AS xy, sum(y * y) - sum(y) * sum(y) / n AS yy,
             sum(h * x) - sum(h) * sum(x) / n AS hx, sum(h * h) - sum(h) * sum(h) / n AS hh, sum(h * y) - sum(h) * sum(y) / n AS hy
      FROM h GROUP BY skill, n, first, last, last_y, t),
b AS (SELECT *, hh - hx * hx / xx AS hh_x, hy - hx * xy / xx AS hy_x, greatest(0.0, yy - xy * xy / xx) AS line FROM a),
c AS (SELECT *, CASE WHEN t > 0 AND hh_x > 1e-9 THEN hy_x / hh_x ELSE 0.0 END AS bend FROM b),
d AS (SELECT *, greatest(0.0, line - bend * hy_x) AS error FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY CASE WHEN t = 0 THEN 'inf'::DOUBLE ELSE error END, t) AS r FROM d
      WHERE t = 0 OR (line > 1e-12 * yy AND error * power(n, 2.0 / n) < line)),
f AS (SELECT *, CAST(last - first + 1 AS DOUBLE) AS nx, (xy - CASE WHEN t > 0 THEN bend * hx ELSE 0 END) / xx AS slope,
             n - CASE WHEN t > 0 THEN 4 ELSE 2 END AS free FROM e WHERE r = 1),
g AS (SELECT *, my + slope * (nx - mx) + CASE WHEN t > 0 THEN bend * (nx - t - mh) ELSE 0 END AS raw,
             greatest(0.0, my + xy / xx * (nx - mx)) AS line_value,
             CASE WHEN free > 0 THEN list_extract({T90_SQL}, CAST(free AS INTEGER)) * sqrt(error / free) * sqrt(1 + 1 / n + (nx - mx) * (nx - mx) / xx
               + CASE WHEN t > 0 THEN power(nx - t - mh - hx / xx * (nx - mx), 2) / hh_x ELSE 0 END) END AS half FROM f),
w AS (SELECT *, greatest(0.0, raw - half) AS lo, raw + half AS hi FROM g),
z AS (SELECT *, half IS NULL OR (hi - lo) > greatest(0.0, raw) * 1.5 AS wide FROM w),
v AS (SELECT *, CASE WHEN wide THEN line_value ELSE greatest(0.0, raw) END AS forecast_value FROM z)"""


@query("forecast_piecewise", "P4 P5 P6", f"""
{PIECEWISE_SQL}
SELECT skill, CAST(n AS INTEGER) AS n_points, CAST(CASE WHEN t > 0 AND NOT wide THEN first + t END AS INTEGER) AS bends_in,
       round(CASE WHEN wide THEN xy / xx ELSE slope END, 6) AS slope, round(CASE WHEN t > 0 AND NOT wide THEN slope + bend END, 6) AS slope_after,
       CAST(last + 1 AS INTEGER) AS forecast_year, round(forecast_value, 6) AS forecast_value,
       round(CASE WHEN NOT wide THEN lo END, 6) AS ci_lower, round(CASE WHEN NOT wide THEN hi END, 6) AS ci_upper,
       CASE WHEN wide THEN 'linear_trend' WHEN t > 0 THEN 'piecewise_linear' ELSE 'linear_interval' END AS method,
       CASE WHEN (forecast_value - last_y) / greatest(last_y, 1) * 100 > 10 THEN 'Rising ^'
            WHEN (forecast_value - last_y) / greatest(last_y, 1) * 100 < -10 THEN 'Declining v' ELSE 'Stable ->' END AS direction FROM v""")
def q_forecast_piecewise(spark, sf_dir):
    """Every part name's series, with a bend where one pays."""
    counts = forecast.yearly_series(analysis_input(spark, sf_dir, "p_name", ["posted_year"]))
    return rounded(changepoint.piecewise_forecast(counts), ["slope", "slope_after", "forecast_value", "ci_lower", "ci_upper"], 6)
