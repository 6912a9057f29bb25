"""Registered queries: frequency, trends and cross-tabs."""

from __future__ import annotations

from demandlens.operators import crosstab, frequency, trends
from demandlens.plans.inputs import analysis_input, analysis_sql
from demandlens.plans.registry import query, rounded

M_YEAR = analysis_sql("p_brand", ["posted_year"])
M_CAT = analysis_sql("p_brand", ["skill_category"])
M_DATE = analysis_sql("p_brand", ["order_date"])
M_EXP = analysis_sql("p_brand", ["experience_level"])
M_ALL = analysis_sql("p_brand", ["skill_category", "posted_year"])

ANNUAL_SQL = f"""
WITH m AS ({M_YEAR}),
a AS (SELECT posted_year, skill, count(*) AS mentions FROM m
      WHERE posted_year IS NOT NULL GROUP BY posted_year, skill)
SELECT posted_year, skill, mentions,
       CAST(sum(mentions) OVER (PARTITION BY posted_year) AS BIGINT) AS year_total,
       mentions / sum(mentions) OVER (PARTITION BY posted_year) AS share
FROM a"""


@query("annual_share", "A12 J6 S4 C2", ANNUAL_SQL)
def q_annual_share(spark, sf_dir):
    return trends.annual_share(analysis_input(spark, sf_dir, "p_brand", ["posted_year"]))


@query("first_last_change", "A13", f"""
WITH a AS ({ANNUAL_SQL}),
b AS (SELECT min(posted_year) AS fy, max(posted_year) AS ly FROM a),
w AS (SELECT skill,
             max(CASE WHEN posted_year = (SELECT fy FROM b) THEN share END) AS share_first,
             max(CASE WHEN posted_year = (SELECT ly FROM b) THEN share END) AS share_last
      FROM a WHERE skill IS NOT NULL GROUP BY skill),
c AS (SELECT *, (share_last - share_first) * 100 AS change_pp FROM w),
r AS (SELECT *, 'rising' AS direction,
             CAST(row_number() OVER (ORDER BY change_pp DESC NULLS LAST, skill) AS INTEGER) AS rank FROM c),
d AS (SELECT *, 'declining' AS direction,
             CAST(row_number() OVER (ORDER BY change_pp ASC NULLS LAST, skill) AS INTEGER) AS rank FROM c)
SELECT * FROM r WHERE rank <= 5 UNION ALL SELECT * FROM d WHERE rank <= 5""")
def q_first_last_change(spark, sf_dir):
    annual = trends.annual_share(analysis_input(spark, sf_dir, "p_brand", ["posted_year"]))
    return trends.first_last_change(annual)


@query("focus_series", "A24", f"""
WITH a AS ({ANNUAL_SQL}),
b AS (SELECT min(posted_year) AS fy, max(posted_year) AS ly FROM a),
w AS (SELECT skill,
             max(CASE WHEN posted_year = (SELECT fy FROM b) THEN share END) AS share_first,
             max(CASE WHEN posted_year = (SELECT ly FROM b) THEN share END) AS share_last
      FROM a WHERE skill IS NOT NULL GROUP BY skill),
c AS (SELECT *, (share_last - share_first) * 100 AS change_pp FROM w),
f AS (SELECT skill FROM (SELECT skill, row_number() OVER (ORDER BY change_pp DESC NULLS LAST, skill) AS r FROM c) WHERE r <= 5
      UNION
      SELECT skill FROM (SELECT skill, row_number() OVER (ORDER BY change_pp ASC NULLS LAST, skill) AS r FROM c) WHERE r <= 5)
SELECT posted_year, skill, mentions, share FROM a WHERE skill IN (SELECT skill FROM f)""")
def q_focus_series(spark, sf_dir):
    annual = trends.annual_share(analysis_input(spark, sf_dir, "p_brand", ["posted_year"]))
    return trends.focus_series(annual, trends.first_last_change(annual))


@query("trend_cards", "A14 A15", f"""
WITH a AS ({ANNUAL_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY share DESC, posted_year ASC) AS pk FROM a WHERE skill IS NOT NULL)
SELECT skill, CAST(count(*) AS BIGINT) AS n_points, min(posted_year) AS first_year, max(posted_year) AS last_year,
       arg_min(share, posted_year) AS first_share, arg_max(share, posted_year) AS latest_share,
       max(CASE WHEN pk = 1 THEN posted_year END) AS peak_year, max(share) AS peak_share,
       (arg_max(share, posted_year) - arg_min(share, posted_year)) * 100 AS change_pp
FROM r GROUP BY skill""")
def q_trend_cards(spark, sf_dir):
    annual = trends.annual_share(analysis_input(spark, sf_dir, "p_brand", ["posted_year"]))
    return trends.trend_cards(annual)


@query("trending_score", "A16", f"""
WITH m AS ({M_YEAR}),
r AS (SELECT skill, CAST(posted_year AS INTEGER) AS posted_year FROM m WHERE posted_year IS NOT NULL),
a0 AS (SELECT posted_year, skill, count(*) AS mentions FROM r GROUP BY posted_year, skill),
a AS (SELECT *, mentions / sum(mentions) OVER (PARTITION BY posted_year) AS share FROM a0),
yb AS (SELECT min(posted_year) AS fy, max(posted_year) AS ly FROM a),
nr AS (SELECT count(DISTINCT posted_year) AS n FROM a WHERE posted_year >= (SELECT ly FROM yb) - 2),
tot AS (SELECT count(*) AS n FROM r WHERE skill IS NOT NULL),
s AS (SELECT skill,
             sum(CASE WHEN posted_year >= (SELECT ly FROM yb) - 2 THEN share END) AS recent_sum,
             coalesce(max(CASE WHEN posted_year = (SELECT ly FROM yb) THEN share END), 0.0) AS share_last,
             coalesce(max(CASE WHEN posted_year = (SELECT fy FROM yb) THEN share END), 0.0) AS share_first,
             sum(mentions) AS mentions
      FROM a WHERE skill IS NOT NULL GROUP BY skill),
sc AS (SELECT skill, coalesce(recent_sum, 0.0) / (SELECT n FROM nr) AS recent_share,
              share_last - share_first AS share_change,
              mentions / (SELECT n FROM tot) AS overall_share FROM s),
sc2 AS (SELECT *, recent_share * 0.55 + greatest(share_change, 0.0) * 0.30 + overall_share * 0.15 AS score FROM sc),
rk AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, skill) AS INTEGER) AS rank FROM sc2)
SELECT skill, round(recent_share, 9) AS recent_share, share_change, overall_share,
       round(score, 9) AS score, rank FROM rk WHERE rank <= 20""")
def q_trending_score(spark, sf_dir):
    out = trends.trending_score(analysis_input(spark, sf_dir, "p_brand", ["posted_year"]), top_n=20)
    return rounded(out, ["recent_share", "score"])


@query("monthly_change", "A17", f"""
WITH m AS ({M_DATE}),
mo AS (SELECT strftime(order_date, '%Y-%m') AS month, skill, count(*) AS mentions FROM m
       WHERE order_date IS NOT NULL AND skill IS NOT NULL GROUP BY ALL),
b AS (SELECT min(month) AS fm, max(month) AS lm FROM mo),
c AS (SELECT skill, max(CASE WHEN month = (SELECT fm FROM b) THEN mentions END) AS first_count,
             max(CASE WHEN month = (SELECT lm FROM b) THEN mentions END) AS last_count
      FROM mo WHERE month = (SELECT fm FROM b) OR month = (SELECT lm FROM b) GROUP BY skill),
d AS (SELECT *, last_count - first_count AS delta FROM c WHERE first_count IS NOT NULL AND last_count IS NOT NULL),
u AS (SELECT *, 'rising' AS direction, CAST(row_number() OVER (ORDER BY delta DESC, skill) AS INTEGER) AS rank FROM d),
v AS (SELECT *, 'declining' AS direction, CAST(row_number() OVER (ORDER BY delta ASC, skill) AS INTEGER) AS rank FROM d)
SELECT * FROM u WHERE rank <= 5 UNION ALL SELECT * FROM v WHERE rank <= 5""")
def q_monthly_change(spark, sf_dir):
    return trends.monthly_change(analysis_input(spark, sf_dir, "p_brand", ["order_date"]))


@query("top_skills", "A1 A11 A25 J9", f"""
WITH m AS ({M_YEAR}),
c AS (SELECT skill, count(*) AS mentions FROM m WHERE skill IS NOT NULL GROUP BY skill)
SELECT skill, mentions, mentions * 100.0 / (SELECT sum(mentions) FROM c) AS share_pct
FROM c ORDER BY mentions DESC, skill LIMIT 20""")
def q_top_skills(spark, sf_dir):
    return frequency.top_skills(analysis_input(spark, sf_dir, "p_brand", ["posted_year"]), n=20)


@query("category_mix", "A2", f"""
WITH m AS ({M_CAT})
SELECT skill_category, count(*) AS mentions FROM m GROUP BY skill_category""")
def q_category_mix(spark, sf_dir):
    return frequency.category_counts(analysis_input(spark, sf_dir, "p_brand", ["skill_category"]))


@query("skill_category_top", "A3", f"""
WITH m AS ({analysis_sql("p_name", ["skill_category"])})
SELECT skill, skill_category, count(*) AS mentions FROM m WHERE skill IS NOT NULL
GROUP BY skill, skill_category ORDER BY mentions DESC, skill, skill_category NULLS FIRST LIMIT 20""")
def q_skill_category_top(spark, sf_dir):
    return frequency.skill_category_top(analysis_input(spark, sf_dir, "p_name", ["skill_category"]), n=20)


@query("top_skill_series", "A18", f"""
WITH m AS ({M_YEAR}),
t AS (SELECT skill FROM m WHERE skill IS NOT NULL GROUP BY skill ORDER BY count(*) DESC, skill LIMIT 5)
SELECT posted_year, skill, count(*) AS mentions FROM m
WHERE posted_year IS NOT NULL AND skill IN (SELECT skill FROM t) GROUP BY posted_year, skill""")
def q_top_skill_series(spark, sf_dir):
    return frequency.top_skill_series(analysis_input(spark, sf_dir, "p_brand", ["posted_year"]), n=5)


@query("kpis", "A5 A6 A7 A8 A9 A10", f"""
WITH m AS ({M_ALL}),
pj AS (SELECT job_id, count(DISTINCT skill) AS k FROM m WHERE skill IS NOT NULL GROUP BY job_id),
ts AS (SELECT skill, count(*) AS n FROM m WHERE skill IS NOT NULL GROUP BY skill ORDER BY n DESC, skill LIMIT 1),
tc AS (SELECT skill_category, count(*) AS n FROM m WHERE skill_category IS NOT NULL GROUP BY skill_category
       ORDER BY n DESC, skill_category LIMIT 1),
b AS (SELECT count(*) AS total_mentions, count(DISTINCT skill) AS distinct_skills,
             count(DISTINCT job_id) AS distinct_jobs, min(posted_year) AS min_year, max(posted_year) AS max_year,
             count(DISTINCT posted_year) AS years_covered FROM m)
SELECT total_mentions, distinct_skills, distinct_jobs, min_year, max_year, years_covered,
       concat_ws(' - ', CAST(min_year AS VARCHAR), CAST(max_year AS VARCHAR)) AS year_span,
       coalesce(CAST(total_mentions AS DOUBLE) / nullif(distinct_jobs, 0), 0.0) AS avg_rows_per_job,
       (SELECT avg(k) FROM pj) AS avg_distinct_skills_per_job,
       (SELECT skill FROM ts) AS top_skill, (SELECT n FROM ts) AS top_skill_mentions,
       (SELECT skill_category FROM tc) AS top_category, (SELECT n FROM tc) AS top_category_mentions
FROM b""")
def q_kpis(spark, sf_dir):
    return frequency.kpis(analysis_input(spark, sf_dir, "p_brand", ["skill_category", "posted_year"]))


EXP_SQL = f"""
WITH m AS ({M_EXP}),
t AS (SELECT skill FROM m WHERE skill IS NOT NULL GROUP BY skill ORDER BY count(*) DESC, skill LIMIT 11),
c AS (SELECT coalesce(CASE experience_level WHEN 'EN' THEN 'Entry-Level' WHEN 'MI' THEN 'Mid-Level'
                      WHEN 'SE' THEN 'Senior' WHEN 'EX' THEN 'Executive' END, experience_level) AS experience_level,
             skill, count(*) AS n
      FROM m WHERE experience_level IS NOT NULL AND skill IN (SELECT skill FROM t) GROUP BY ALL),
g AS (SELECT l.experience_level, t.skill FROM (SELECT DISTINCT experience_level FROM c) l, t),
z AS (SELECT g.experience_level, g.skill, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM g
      LEFT JOIN c ON g.experience_level = c.experience_level AND g.skill = c.skill)
SELECT experience_level, skill, n, n / sum(n) OVER (PARTITION BY experience_level) AS share,
       n / sum(n) OVER (PARTITION BY experience_level) * 100 AS pct,
       CASE lower(experience_level) WHEN 'entry' THEN 1 WHEN 'entry-level' THEN 1 WHEN 'mid' THEN 2
            WHEN 'mid-level' THEN 2 WHEN 'senior' THEN 3 ELSE 99 END AS level_order
FROM z"""


@query("experience_share", "A19 A20 A23 C18 C19", EXP_SQL)
def q_experience_share(spark, sf_dir):
    return crosstab.experience_crosstab(analysis_input(spark, sf_dir, "p_brand", ["experience_level"]), top_n=11)


@query("level_champion", "A21", f"""
WITH x AS ({EXP_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY experience_level ORDER BY share DESC, skill) AS k FROM x)
SELECT experience_level, max(CASE WHEN k = 1 THEN skill END) AS skill, max(share) AS share, max(pct) AS pct
FROM r GROUP BY experience_level""")
def q_level_champion(spark, sf_dir):
    ct = crosstab.experience_crosstab(analysis_input(spark, sf_dir, "p_brand", ["experience_level"]), top_n=11)
    return crosstab.level_champions(ct)


@query("crosstab_check", "A20", f"""
WITH x AS ({EXP_SQL})
SELECT experience_level, round(sum(pct), 9) AS pct_total, abs(sum(pct) - 100) <= 0.1 AS ok
FROM x GROUP BY experience_level""")
def q_crosstab_check(spark, sf_dir):
    ct = crosstab.experience_crosstab(analysis_input(spark, sf_dir, "p_brand", ["experience_level"]), top_n=11)
    return rounded(crosstab.crosstab_row_check(ct), ["pct_total"])


@query("skill_weights", "A25", f"""
WITH m AS ({analysis_sql("p_name", [])}),
c AS (SELECT skill, count(*) AS mentions FROM m WHERE skill IS NOT NULL GROUP BY skill)
SELECT skill, mentions, mentions * 100.0 / (SELECT sum(mentions) FROM c) AS share_pct FROM c""")
def q_skill_weights(spark, sf_dir):
    return frequency.top_skills(analysis_input(spark, sf_dir, "p_name", []), n=None)


@query("monthly_series", "A17", f"""
WITH m AS ({M_DATE})
SELECT strftime(order_date, '%Y-%m') AS month, skill, count(*) AS mentions FROM m
WHERE order_date IS NOT NULL GROUP BY ALL""")
def q_monthly_series(spark, sf_dir):
    return trends.monthly_counts(analysis_input(spark, sf_dir, "p_brand", ["order_date"]))
