"""Registered queries: the validation path and the statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlens.operators import cleaning, stats
from demandlens.plans.inputs import analysis_input, analysis_sql
from demandlens.plans.registry import query, sql_norm
from demandlens.sources.tables import VALIDATION_POSTINGS_SQL, validation_sources



def _tail(stat: str, dof: str) -> str:
    """DuckDB: one minus the series of the lower chi-square tail."""
    a, x = f"(({dof}) / 2.0)", f"(({stat}) / 2.0)"
    terms = f"CAST(greatest(60, {x} + sqrt({x}) * 12 + 60) AS BIGINT)"
    return (f"CASE WHEN ({dof}) <= 0 OR ({stat}) <= 0 THEN 1.0 ELSE greatest(0.0, 1 - (SELECT sum(exp({a} * ln({x}) - {x} "
            f"+ k * ln({x}) - lgamma({a} + k + 1))) FROM range(0, {terms} + 1) t(k))) END")


VALIDATION_SQL = f"""
WITH p AS (SELECT job_link, {sql_norm('job_title')} AS job_title, {sql_norm('job_level')} AS job_level
           FROM ({VALIDATION_POSTINGS_SQL}) q),
s AS (SELECT doc_id AS job_link, text AS job_skills FROM documents WHERE doc_id IN (SELECT job_link FROM p)),
e AS (SELECT DISTINCT job_link, skill FROM (
        SELECT job_link, {sql_norm("unnest(string_split(coalesce(job_skills, ''), ','))")} AS skill FROM s)
      WHERE skill <> '')
SELECT e.job_link, e.skill, p.job_title, p.job_level, 'linkedin' AS source FROM e LEFT JOIN p USING (job_link)"""


def validation_table(spark, sf_dir, sample: bool = True):
    """C12 + J5 + J3: explode the comma lists of the sampled postings (or of
    all), then attach the posting metadata (left join, null where a list has no
    posting), normalised and tagged."""
    job_skills, postings = validation_sources(spark, sf_dir)
    postings = cleaning.normalize_columns(postings, ["job_title", "job_level"])
    lists = cleaning.semi_join_keys(job_skills, postings, "job_link") if sample else job_skills
    exploded = cleaning.explode_skill_list(lists, "job_link", "job_skills")
    return (exploded.join(postings, "job_link", "left")
                    .select("job_link", "skill", "job_title", "job_level")
                    .withColumn("source", F.lit("linkedin")))


@query("exploded_items", "C12 J3 J5 S3 C1 C8", VALIDATION_SQL)
def q_exploded_items(spark, sf_dir):
    return validation_table(spark, sf_dir)


FLAG_SQL = f"""v AS ({VALIDATION_SQL.replace(" WHERE doc_id IN (SELECT job_link FROM p)", "")}),
fl AS (SELECT *, coalesce(regexp_matches(skill, '(?i)(llm|rag|genai|prompt engineering)'), false) AS genai_flag FROM v)"""


@query("keyword_flag", "T1 T2", f"""
WITH {FLAG_SQL}
SELECT job_level, CAST(sum(CAST(genai_flag AS INTEGER)) AS BIGINT) AS genai_mentions,
       count(*) AS total_skill_rows, avg(CAST(genai_flag AS INTEGER)) AS genai_share
FROM fl GROUP BY job_level""")
def q_keyword_flag(spark, sf_dir):
    return stats.flag_summary(stats.flag_keywords(validation_table(spark, sf_dir, sample=False)))


@query("chi_square", "T3 T4", f"""
WITH {FLAG_SQL},
cells AS (SELECT coalesce(CAST(job_level AS VARCHAR), 'unknown') AS row, CAST(genai_flag AS VARCHAR) AS col, count(*) AS n
          FROM fl GROUP BY ALL),
rs AS (SELECT DISTINCT row FROM cells), cs AS (SELECT DISTINCT col FROM cells),
g AS (SELECT rs.row, cs.col, CAST(coalesce(cells.n, 0) AS DOUBLE) AS o FROM rs CROSS JOIN cs
      LEFT JOIN cells ON cells.row = rs.row AND cells.col = cs.col),
tot AS (SELECT sum(n) AS n, count(DISTINCT row) AS nr, count(DISTINCT col) AS nc FROM cells),
m AS (SELECT *, sum(o) OVER (PARTITION BY row) * sum(o) OVER (PARTITION BY col) / (SELECT n FROM tot) AS e FROM g),
dd AS (SELECT ((SELECT nr FROM tot) - 1) * ((SELECT nc FROM tot) - 1) AS dof),
st AS (SELECT sum(power(abs(o - e) - CASE WHEN (SELECT dof FROM dd) = 1 THEN least(0.5, abs(o - e)) ELSE 0.0 END, 2) / e)
              AS statistic, min(e) AS min_expected FROM m)
SELECT round(statistic, 6) AS statistic, CAST((SELECT dof FROM dd) AS BIGINT) AS dof,
       round({_tail('statistic', '(SELECT dof FROM dd)')}, 6) AS p_value,
       round(CASE WHEN (SELECT dof FROM dd) % 2 = 0  -- an even number has a finite sum
                  THEN (ln((SELECT sum(power(statistic / 2, k) / gamma(k + 1)) FROM range(0, CAST((SELECT dof FROM dd) / 2 AS BIGINT)) t(k))) - statistic / 2) / ln(10)
                  ELSE log10({_tail('statistic', '(SELECT dof FROM dd)')}) END, 6) AS log10_p,
       CAST((SELECT n FROM tot) AS BIGINT) AS n, CAST((SELECT nr FROM tot) AS BIGINT) AS n_rows,
       CAST((SELECT nc FROM tot) AS BIGINT) AS n_cols, round(min_expected, 6) AS min_expected,
       min_expected > 0 AS valid
FROM st""")
def q_chi_square(spark, sf_dir):
    flagged = stats.flag_keywords(validation_table(spark, sf_dir, sample=False))
    out = stats.chi_square(stats.contingency(flagged, "job_level", "genai_flag"))
    return out.withColumns({c: F.round(c, d) for c, d in (("statistic", 6), ("p_value", 6), ("log10_p", 6), ("min_expected", 6))})


TWO_YEAR_GROUP = ["brand#1", "brand#2", "brand#3"]


@query("two_year_test", "T5 T6 T7", f"""
WITH m AS ({analysis_sql("p_brand", ["posted_year"])}),
s AS (SELECT posted_year AS y, coalesce(skill IN ('brand#1', 'brand#2', 'brand#3'), false) AS g
      FROM m WHERE posted_year IN (1996, 2000)),
c AS (SELECT count(CASE WHEN y = 1996 THEN 1 END) AS n_a, count(CASE WHEN y = 2000 THEN 1 END) AS n_b,
             count(CASE WHEN y = 1996 AND g THEN 1 END) AS k_a, count(CASE WHEN y = 2000 AND g THEN 1 END) AS k_b FROM s),
x AS (SELECT *, k_a / n_a AS share_a, k_b / n_b AS share_b, (k_a + k_b) / (n_a + n_b) AS pooled FROM c),
z AS (SELECT *, (share_a - share_b) / sqrt(pooled * (1 - pooled) * (1 / n_a + 1 / n_b)) AS zz,
             n_a * (k_a + k_b) / (n_a + n_b) AS e11 FROM x),
st AS (SELECT *, power(abs(k_a - e11) - least(0.5, abs(k_a - e11)), 2)
             * (n_a + n_b) * (1 / n_a + 1 / n_b) * (1 / (k_a + k_b) + 1 / (n_a + n_b - k_a - k_b)) AS chi FROM z)
SELECT 1996 AS year_a, 2000 AS year_b, n_a, n_b, k_a, k_b, share_a, share_b,
       round(chi, 6) AS chi2, CAST(1 AS BIGINT) AS dof,
       round({_tail('chi', '1')}, 6) AS p_value,
       round(zz, 6) AS z, round({_tail('zz * zz', '1')}, 6) AS z_p_value,
       least(k_a, k_b, n_a - k_a, n_b - k_b) AS min_cell,
       n_a >= 30 AND n_b >= 30 AND least(k_a, k_b, n_a - k_a, n_b - k_b) >= 5 AS sample_ok,
       CASE WHEN {_tail('chi', '1')} < 0.05 THEN 'REJECT H₀' ELSE 'FAIL TO REJECT H₀' END AS conclusion
FROM st""")
def q_two_year_test(spark, sf_dir):
    df = analysis_input(spark, sf_dir, "p_brand", ["posted_year"])
    out = stats.two_year_test(df, 1996, 2000, TWO_YEAR_GROUP)
    return out.withColumns({c: F.round(c, 6) for c in ("chi2", "p_value", "z", "z_p_value")})
