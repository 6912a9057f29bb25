"""Registered queries: the primary cleaning path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.operators import cleaning, frequency
from demandlens.plans.inputs import analysis_input, analysis_sql
from demandlens.plans.registry import query, sql_norm, sql_strip
from demandlens.sources import io
from demandlens.sources.tables import (
    PRIMARY_JOBS_SQL,
    PRIMARY_SKILLS_SQL,
    TICKET_POSTINGS_SQL,
    primary_sources,
    table,
    ticket_postings,
)
from demandlens.session import checkpointed


def _coerce_sql(x: str) -> str:
    d = f"TRY_CAST({x} AS DOUBLE)"
    return f"CASE WHEN {d} = floor({d}) THEN CAST({d} AS BIGINT) END"


REPAIR_CTE = f"""
j0 AS ({PRIMARY_JOBS_SQL}),
s0 AS ({PRIMARY_SKILLS_SQL}),
js AS (SELECT {sql_strip('job_id')} AS job_id, ordinal FROM j0 WHERE job_id IS NOT NULL),
ex AS (SELECT DISTINCT job_id AS exact_id FROM js),
pm AS (SELECT substr(job_id, 1, 11) AS prefix, arg_max(job_id, ordinal) AS prefix_job FROM js GROUP BY 1),
ss AS (SELECT {sql_strip('job_id')} AS job_id, skill, skill_category, skill_level FROM s0),
r AS (SELECT ss.*, coalesce(pm.prefix_job, ss.job_id) AS job_id_normalized,
             CASE WHEN pm.prefix_job IS NOT NULL THEN 'prefix11' WHEN ex.exact_id IS NOT NULL THEN 'exact'
                  ELSE 'unmatched' END AS job_match_method
      FROM ss LEFT JOIN ex ON ss.job_id = ex.exact_id
              LEFT JOIN pm ON pm.prefix = CASE WHEN starts_with(ss.job_id, 'E') THEN substr(ss.job_id, 2) END)"""


@query("key_repair", "J1 B1 B2", f"""
WITH {REPAIR_CTE}
SELECT DISTINCT job_id, job_id_normalized, job_match_method FROM r""")
def q_key_repair(spark, sf_dir):
    jobs, skills = primary_sources(spark, sf_dir)
    return cleaning.repair_job_ids(skills, jobs).select("job_id", "job_id_normalized", "job_match_method").distinct()


@query("first_wins_dedup", "C6", """
SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority FROM (
  SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1""")
def q_first_wins_dedup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    return cleaning.first_by_key(orders, "o_custkey", "o_orderkey")


CLEAN_CTE = f"""{REPAIR_CTE},
jf AS (SELECT * EXCLUDE (rn) FROM (
         SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ordinal) AS rn
         FROM (SELECT {sql_strip('job_id')} AS job_id, * EXCLUDE (job_id) FROM j0)) WHERE rn = 1),
jn AS (SELECT job_id AS job_id_job, {sql_norm('job_title')} AS job_title,
              {sql_norm('experience_level')} AS experience_level, {sql_norm('country')} AS country,
              {_coerce_sql('min_experience_years')} AS min_experience_years,
              {_coerce_sql('salary_min_usd')} AS salary_min_usd, {_coerce_sql('salary_max_usd')} AS salary_max_usd,
              {_coerce_sql('posted_year')} AS posted_year, posted_date FROM jf),
sd AS (SELECT DISTINCT job_id, skill, skill_category, skill_level, job_id_normalized, job_match_method FROM r),
sn AS (SELECT job_id_normalized, job_match_method, {sql_norm('skill')} AS skill,
              {sql_norm('skill_category')} AS skill_category, {sql_norm('skill_level')} AS skill_level FROM sd),
cl AS (SELECT sn.job_id_normalized AS job_id, sn.skill, sn.skill_category, sn.skill_level, sn.job_match_method,
              jn.job_id_job, jn.job_title, coalesce(jn.experience_level, 'Not Specified') AS experience_level,
              coalesce(jn.country, 'Not Specified') AS country, jn.min_experience_years, jn.salary_min_usd,
              jn.salary_max_usd, CAST(jn.posted_year AS INTEGER) AS posted_year, jn.posted_date,
              'primary' AS source,
              coalesce(CAST(CAST(jn.posted_year AS INTEGER) AS VARCHAR), 'Not Specified') AS posted_year_label
       FROM sn LEFT JOIN jn ON sn.job_id_normalized = jn.job_id_job)"""


def clean_long(spark, sf_dir):
    jobs, skills = primary_sources(spark, sf_dir)
    return cleaning.clean_primary(skills, jobs)


def stored_clean_long(spark, sf_dir):
    """The cleaned table as the later stages read it: written once, found again
    while its inputs stay the same."""
    return io.materialize(clean_long(spark, sf_dir), "primary_skills_long")


@query("clean_long", "C1 C2 C3 C5 C7 C8 C9 C11 C16 J2", f"WITH {CLEAN_CTE} SELECT * FROM cl")
def q_clean_long(spark, sf_dir):
    return clean_long(spark, sf_dir)


@query("dataset_summary", "A4", f"""
WITH {CLEAN_CTE}
SELECT count(*) AS rows, count(DISTINCT job_id) AS jobs, count(DISTINCT skill) AS skills,
       count(DISTINCT skill_category) AS skill_categories,
       array_to_string(list_sort(list(DISTINCT CAST(posted_year AS VARCHAR)) FILTER (WHERE posted_year IS NOT NULL)), ',')
         AS years,
       count(job_id_job) AS matched_rows FROM cl""")
def q_dataset_summary(spark, sf_dir):
    return frequency.describe(stored_clean_long(spark, sf_dir))


@query("filter_values", "C15", f"""
WITH {CLEAN_CTE}
SELECT 'year' AS kind, value, CASE WHEN regexp_matches(value, '^[0-9]+$') THEN 0 ELSE 1 END AS sort_group
FROM (SELECT DISTINCT CAST(posted_year_label AS VARCHAR) AS value FROM cl)
UNION ALL
SELECT 'category' AS kind, value, 0 AS sort_group
FROM (SELECT DISTINCT CAST(skill_category AS VARCHAR) AS value FROM cl WHERE skill_category IS NOT NULL)""")
def q_filter_values(spark, sf_dir):
    return cleaning.filter_values(stored_clean_long(spark, sf_dir))


@query("bi_export", "S11 C5 C9", f"""
WITH {CLEAN_CTE}
SELECT job_id, skill, skill_category, posted_year_label, experience_level,
       strftime(TRY_CAST(posted_date AS TIMESTAMP), '%Y-%m') AS posted_month,
       CAST(year(TRY_CAST(posted_date AS TIMESTAMP)) AS VARCHAR) || 'Q'
         || CAST(quarter(TRY_CAST(posted_date AS TIMESTAMP)) AS VARCHAR) AS posted_quarter
FROM cl""")
def q_bi_export(spark, sf_dir):
    cl = stored_clean_long(spark, sf_dir)
    ts = cleaning.parse_timestamp("posted_date")
    return cl.select("job_id", "skill", "skill_category", "posted_year_label", "experience_level",
                     F.date_format(ts, "yyyy-MM").alias("posted_month"),
                     F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string")).alias("posted_quarter"))


@query("filtered_view", "C13 C14", f"""
WITH {CLEAN_CTE},
c AS (SELECT posted_year, skill_category, count(*) AS mentions FROM cl GROUP BY ALL)
SELECT 'nothing selected' AS view, * FROM c
UNION ALL SELECT 'selection', * FROM c WHERE (posted_year IN (1996, 1997) OR posted_year IS NULL) AND skill_category IN ('economy', 'small')
UNION ALL SELECT 'years only', * FROM c WHERE posted_year IN (1996, 1997)
UNION ALL SELECT 'verified years', * FROM c WHERE posted_year IS NOT NULL""")
def q_filtered_view(spark, sf_dir):
    counts = checkpointed(stored_clean_long(spark, sf_dir).groupBy("posted_year", "skill_category").agg(F.count(F.lit(1)).alias("mentions")))
    views = {
        "nothing selected": cleaning.year_filter(counts),
        "selection": cleaning.year_filter(counts, years=["1996", 1997, "Not Specified"], categories=["economy", "small"]),
        "years only": cleaning.year_filter(counts, years=[1996, 1997]),
        "verified years": cleaning.verified_years(counts),
    }
    return reduce(DataFrame.unionByName, [v.select(F.lit(k).alias("view"), "*") for k, v in views.items()])


@query("slicer_panel", "C21", f"""
WITH m AS ({analysis_sql("p_brand", ["posted_year"])})
SELECT posted_year, skill, count(*) AS mentions, (SELECT count(*) FROM m) AS card_mentions,
       (SELECT count(DISTINCT posted_year) FROM m) AS card_years
FROM m WHERE posted_year BETWEEN 1997 AND 2000 AND skill IN ('brand#1', 'brand#2', 'brand#3') GROUP BY posted_year, skill""")
def q_slicer_panel(spark, sf_dir):
    return cleaning.slicer_panel(analysis_input(spark, sf_dir, "p_brand", ["posted_year"]), (1997, 2000),
                                 ["brand#1", "brand#2", "brand#3"])


_S = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


@query("clean_postings", "C16", f"""
WITH p AS ({TICKET_POSTINGS_SQL}),
s AS (SELECT {_S.format(x='job_title')} AS job_title, lower({_S.format(x='skills_required')}) AS skills_required,
             lower({_S.format(x='date_posted')}) AS date_posted, lower({_S.format(x='experience_level')}) AS experience_level,
             lower({_S.format(x='company_location')}) AS company_location
      FROM p WHERE skills_required IS NOT NULL AND {_S.format(x='skills_required')} <> ''),
d AS (SELECT *, CAST(TRY_CAST(date_posted AS TIMESTAMP) AS DATE) AS posted_date FROM s)
SELECT DISTINCT job_title, skills_required, date_posted, coalesce(experience_level, 'Not Specified') AS experience_level,
       company_location, posted_date, CAST(year(posted_date) AS INTEGER) AS year, strftime(posted_date, '%Y-%m') AS month,
       CAST(year(posted_date) AS VARCHAR) || 'Q' || CAST(quarter(posted_date) AS VARCHAR) AS quarter
FROM d WHERE posted_date IS NOT NULL""")
def q_clean_postings(spark, sf_dir):
    return cleaning.clean_postings(ticket_postings(spark, sf_dir))


POSTING_LEVEL_SQL = f"""
WITH p AS ({TICKET_POSTINGS_SQL}),
s AS (SELECT lower({_S.format(x='skills_required')}) AS skills_required,
             lower({_S.format(x='experience_level')}) AS experience_level,
             CAST(TRY_CAST(lower({_S.format(x='date_posted')}) AS TIMESTAMP) AS DATE) AS posted_date,
             {_S.format(x='job_title')} AS job_title, lower({_S.format(x='company_location')}) AS company_location
      FROM p WHERE skills_required IS NOT NULL AND {_S.format(x='skills_required')} <> ''),
c AS (SELECT DISTINCT job_title, skills_required, coalesce(experience_level, 'Not Specified') AS experience_level,
             company_location, posted_date FROM s WHERE posted_date IS NOT NULL),
e AS (SELECT CASE WHEN length(experience_level) = 2 THEN coalesce(
                 CASE upper(experience_level) WHEN 'EN' THEN 'Entry-Level' WHEN 'MI' THEN 'Mid-Level'
                      WHEN 'SE' THEN 'Senior' WHEN 'EX' THEN 'Executive' END, experience_level)
             ELSE experience_level END AS experience_level,
             {_S.format(x="unnest(string_split(skills_required, ','))")} AS skill FROM c),
m AS (SELECT * FROM e WHERE skill <> ''),
t AS (SELECT skill FROM m GROUP BY skill ORDER BY count(*) DESC, skill LIMIT 11),
cc AS (SELECT experience_level, skill, count(*) AS n FROM m
       WHERE experience_level IS NOT NULL AND skill IN (SELECT skill FROM t) GROUP BY ALL),
g AS (SELECT l.experience_level, t.skill FROM (SELECT DISTINCT experience_level FROM cc) l, t),
z AS (SELECT g.experience_level, g.skill, CAST(coalesce(cc.n, 0) AS BIGINT) AS n FROM g
      LEFT JOIN cc ON g.experience_level = cc.experience_level AND g.skill = cc.skill)
SELECT experience_level, skill, n, n / sum(n) OVER (PARTITION BY experience_level) AS share,
       n / sum(n) OVER (PARTITION BY experience_level) * 100 AS pct,
       CASE lower(experience_level) WHEN 'entry' THEN 1 WHEN 'entry-level' THEN 1 WHEN 'mid' THEN 2
            WHEN 'mid-level' THEN 2 WHEN 'senior' THEN 3 ELSE 99 END AS level_order
FROM z"""


def posting_levels(spark, sf_dir):
    """The cross-tab of the cleaned postings' levels and skills."""
    from demandlens.functions.text import level_label, normalize_text
    from demandlens.operators import crosstab
    cleaned = cleaning.clean_postings(ticket_postings(spark, sf_dir))
    lvl = F.col("experience_level")
    # codes were lower-cased by the cleaning; the code map is applied to 2-letter codes
    coded = F.when(F.length(lvl) == 2, level_label(F.upper(lvl))).otherwise(lvl)
    exploded = (cleaned.select(coded.alias("experience_level"),
                               F.explode(F.split("skills_required", ",")).alias("_s"))
                       .select("experience_level", normalize_text("_s").alias("skill"))
                       .filter(F.col("skill") != ""))
    return crosstab.experience_crosstab(exploded, top_n=11, map_codes=False)


@query("posting_level_crosstab", "X4 C18 C19 A19 A20", POSTING_LEVEL_SQL)
def q_posting_level_crosstab(spark, sf_dir):
    return posting_levels(spark, sf_dir)


@query("ordered_crosstab", "A22", f"""
WITH x AS ({POSTING_LEVEL_SQL}),
o AS (SELECT skill, CAST(row_number() OVER (ORDER BY sum(share) DESC, skill) AS INTEGER) AS skill_order FROM x GROUP BY skill)
SELECT x.*, o.skill_order FROM x JOIN o USING (skill) WHERE level_order < 99""")
def q_ordered_crosstab(spark, sf_dir):
    from demandlens.operators import crosstab
    return crosstab.ordered_crosstab(posting_levels(spark, sf_dir))
