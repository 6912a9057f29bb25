"""Registered queries: checked outputs that are read again, and what is shared
between queries: the bucketed fact (S7, S8, S9, S10, S11, Q12)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.operators import basket, cooccur, forecast, frequency, quality
from demandlens.plans.baskets import M_TYPE_RAW, RULES_SQL, _rules
from demandlens.plans.cleaning import CLEAN_CTE, stored_clean_long
from demandlens.plans.forecasts import STATS_SQL
from demandlens.plans.inputs import analysis_input, analysis_sql
from demandlens.plans.registry import query
from demandlens.session import tables_folder
from demandlens.sources import io
from demandlens.sources.publish import PublishRefused, publish
from demandlens.sources.tables import mentions, mentions_sql


def _place(spark: SparkSession, name: str) -> str:
    with tables_folder(spark) as folder:
        return os.path.join(folder, name)


@query("published_counts", "S9 Q12", f"""
WITH m AS ({analysis_sql("p_brand", ["posted_year"])})
SELECT posted_year, skill, count(*) AS mentions, 'rows as written, at least 1 rows, columns as written, has years' AS checks FROM m GROUP BY posted_year, skill""")
def q_published_counts(spark, sf_dir):
    """The yearly counts as readers find them: published, and still there after a
    table that fails its checks was refused."""
    counts = frequency.year_skill_counts(analysis_input(spark, sf_dir, "p_brand", ["posted_year"]))
    path = _place(spark, "year_skill_counts")
    years = {"has years": lambda t: quality.nonempty(t.where("posted_year is not null"))}
    done = publish(counts, path, checks=years)
    try:
        publish(counts.where("posted_year is null"), path, checks=years)
        raise RuntimeError("a table without years was published")
    except PublishRefused:
        pass
    return spark.read.parquet(done.path).withColumn("checks", F.lit(", ".join(done.checks)))


@query("stored_rules", "S7 S9 Q12", RULES_SQL + " SELECT * FROM sel")
def q_stored_rules(spark, sf_dir):
    """The rules as the dashboard loads them: from the CSV that the mining published."""
    rules = _rules(spark, sf_dir).drop("antecedent_items", "consequent_items")
    path = _place(spark, "mba_rules")
    publish(rules, path, "csv", min_rows=0)
    return io.load_or_empty(spark, path, rules.schema, "csv")


@query("stored_forecasts", "S8 S9", f"""
WITH {STATS_SQL} SELECT skill, forecast_year, forecast_value, direction FROM fd""")
def q_stored_forecasts(spark, sf_dir):
    """The forecasts as the dashboard loads them."""
    found = forecast.top_skill_forecasts(analysis_input(spark, sf_dir, "p_brand", ["posted_year"]), k=10)
    found = found.select("skill", "forecast_year", "forecast_value", "direction")
    path = _place(spark, "forecast_results")
    publish(found, path, "csv", {"a direction each": lambda t: not quality.nonempty(t.where("direction is null"))}, min_rows=0)
    return io.load_or_empty(spark, path, found.schema, "csv")


@query("bi_text_export", "S11 C9", f"""
WITH {CLEAN_CTE}
SELECT job_id, skill, skill_category, coalesce(posted_year_label, 'Not Specified') AS posted_year_label,
       coalesce(experience_level, 'Not Specified') AS experience_level, CAST(min_experience_years AS VARCHAR) AS min_experience_years,
       CAST(salary_min_usd AS VARCHAR) AS salary_min_usd FROM cl""")
def q_bi_text_export(spark, sf_dir):
    """The CSV for the BI tool: every column as text, blanks filled, read again as text."""
    columns = ["job_id", "skill", "skill_category", "posted_year_label", "experience_level", "min_experience_years", "salary_min_usd"]
    text = io.bi_text_columns(stored_clean_long(spark, sf_dir).select(*columns))
    path = _place(spark, "bi_export")
    publish(text, path, "csv")
    return io.load_or_empty(spark, path, text.schema, "csv")


# --- one fact for several artefacts ------------------------------------------

FACT_FIELDS = ["skill_category", "posted_year"]


def job_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, skill, skill_category, posted_year, k), bucketed by job: written
    by the first query that reads it, found again by the others."""
    rows = mentions(spark, sf_dir, "p_type", FACT_FIELDS)
    fact = rows.groupBy("job_id", "skill", "skill_category", "posted_year").agg(F.count(F.lit(1)).alias("k"))
    return io.materialize_bucketed(fact, "job_fact", "job_id")


@query("fact_baskets", "A26 S10", f"""
WITH m AS ({M_TYPE_RAW})
SELECT job_id, CAST(count(*) AS BIGINT) AS n_items, array_to_string(list_sort(list(DISTINCT skill)), ', ') AS items
FROM m WHERE skill IS NOT NULL GROUP BY job_id HAVING count(*) >= 2""")
def q_fact_baskets(spark, sf_dir):
    """Baskets from the bucketed fact: no shuffle at all."""
    per_item = basket.item_counts(job_fact(spark, sf_dir), weight="k")
    return basket.baskets_from_counts(per_item).select("job_id", "n_items", F.array_join("items", ", ").alias("items"))


@query("fact_cooccurrence", "K1 S10", f"""
WITH js AS (SELECT DISTINCT job_id, skill FROM ({M_TYPE_RAW}) m WHERE skill IS NOT NULL)
SELECT a.skill AS skill_a, b.skill AS skill_b, count(*) AS co_occurrence FROM js a JOIN js b ON a.job_id = b.job_id AND a.skill < b.skill GROUP BY ALL""")
def q_fact_cooccurrence(spark, sf_dir):
    """Pairs within jobs from the same fact: only the counted pairs are shuffled."""
    sets = job_fact(spark, sf_dir).where("skill is not null").groupBy("job_id").agg(F.sort_array(F.collect_set("skill")).alias("s"))
    return cooccur.pair_counts(sets.where(F.size("s") >= 2))


@query("fact_kpis", "A5 A6 A7 S10", f"""
WITH m AS ({mentions_sql("p_type", FACT_FIELDS)}),
j AS (SELECT job_id, count(*) AS k, count(DISTINCT skill) AS d FROM m GROUP BY job_id)
SELECT count(*) AS jobs, CAST(sum(k) AS BIGINT) AS mentions, avg(d) FILTER (WHERE d > 0) AS avg_distinct_skills_per_job, sum(k) / count(*) AS avg_rows_per_job FROM j""")
def q_fact_kpis(spark, sf_dir):
    """Per-job cards from the same fact: partial aggregates of whole jobs."""
    jobs = job_fact(spark, sf_dir).groupBy("job_id").agg(F.sum("k").alias("k"), F.count_distinct("skill").alias("d"))
    return jobs.agg(F.count(F.lit(1)).alias("jobs"), F.sum("k").alias("mentions"), F.avg(F.when(F.col("d") > 0, F.col("d"))).alias("avg_distinct_skills_per_job"),
                    (F.sum("k") / F.count(F.lit(1))).alias("avg_rows_per_job"))
