"""Registered queries: extraction, profiling and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlens.functions.text import fold, year_from_decimal
from demandlens.operators import cleaning, extract, frequency, quality, trends
from demandlens.plans.cleaning import CLEAN_CTE, stored_clean_long
from demandlens.plans.gap import TREND_CTE
from demandlens.plans.inputs import analysis_input, analysis_sql
from demandlens.plans.registry import query
from demandlens.session import checkpointed
from demandlens.sources import io
from demandlens.sources.tables import (
    TICKET_POSTINGS_SQL,
    mentions,
    mentions_sql,
    primary_sources,
    table,
    ticket_postings,
)

# Phrases that occur in the documents, by category; "with" stands in no
# category, as an extracted skill may.
PROSE = {
    "licence": ["MIT License", "Apache License", "All rights reserved.", "CC BY-NC 4.0"],
    "insult": ["idiot", "moron", "trash", "stupid"],
    "function word": ["the", "des", "und", "que", "la", "R"],
    "never": ["no such phrase"],
}
PROSE_LOOSE = ["with"]

_CATEGORY = """tax(category, skill) AS (VALUES ('licence', 'MIT License'), ('licence', 'Apache License'),
  ('licence', 'All rights reserved.'), ('licence', 'CC BY-NC 4.0'), ('insult', 'idiot'), ('insult', 'moron'), ('insult', 'trash'),
  ('insult', 'stupid'), ('function word', 'the'), ('function word', 'des'), ('function word', 'und'), ('function word', 'que'),
  ('function word', 'la'), ('function word', 'R'), ('never', 'no such phrase'))"""
_SKILLS = f"""{_CATEGORY},
sk AS (SELECT skill, replace(skill, '.', '\\.') AS pattern FROM (SELECT skill FROM tax UNION ALL SELECT 'with')),
hit AS (SELECT doc_id, skill, regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || pattern || '([^\\p{{L}}\\p{{N}}_]|$)') AS word,
               regexp_matches(text, '(?i)' || pattern) AS sub FROM documents, sk)"""


@query("taxonomy_extract", "X1 X2 X3 X4 X6", f"""
WITH {_SKILLS}
SELECT hit.doc_id, hit.skill, coalesce(tax.category, 'Unknown') AS category FROM hit LEFT JOIN tax USING (skill) WHERE word""")
def q_taxonomy_extract(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    listed = [s for _, s in extract.flatten_taxonomy(PROSE)]
    docs = docs.select("doc_id", fold(F.col("text")).alias("_folded"))
    both = [extract.extract_skills(F.col("_folded"), skills, folded_text=F.col("_folded")) for skills in (listed, PROSE_LOOSE)]
    docs = docs.select("doc_id", extract.flatten_nested(F.array(*both)).alias("skills_found"))
    return extract.attach_category(extract.explode_skills(docs), extract.taxonomy_frame(spark, PROSE))


@query("extraction_counts", "X2 X5", f"""
WITH {_SKILLS}
SELECT skill, count(CASE WHEN sub THEN 1 END) AS docs_substring, count(CASE WHEN word THEN 1 END) AS docs_word
FROM hit GROUP BY skill""")
def q_extraction_counts(spark, sf_dir):
    """Per skill, documents matching it as a plain substring (X5) and as a
    whole phrase (X2); skills without a hit count 0."""
    skills = [s for _, s in extract.flatten_taxonomy(PROSE)] + PROSE_LOOSE
    docs = table(spark, sf_dir, "documents").select("text").select(fold(F.col("text")).alias("_folded"))
    hits = docs.select(extract.extract_forms(skills, F.col("_folded")).alias("hits"))
    found = extract.explode_skills(hits, "hits", "hit").groupBy("hit.skill").agg(
        F.count(F.lit(1)).alias("docs_substring"), F.count(F.when(F.col("hit.word"), 1)).alias("docs_word"))
    listed = spark.createDataFrame([(s,) for s in skills], "skill string")
    return listed.join(found, "skill", "left").select(
        "skill", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("docs_substring", "docs_word")])


@query("table_profile", "Q1", """
SELECT * FROM (VALUES
  ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'), ('o_orderstatus', 'string'),
  ('o_totalprice', 'double'), ('o_orderdate', 'timestamp_ntz'), ('o_orderpriority', 'string')) t("column", dtype)
JOIN (
  SELECT 'o_orderkey' AS "column", count(*) AS rows, count(*) - count(o_orderkey) AS nulls,
         count(DISTINCT o_orderkey) AS distinct FROM orders
  UNION ALL SELECT 'o_custkey', count(*), count(*) - count(o_custkey), count(DISTINCT o_custkey) FROM orders
  UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus) FROM orders
  UNION ALL SELECT 'o_totalprice', count(*), count(*) - count(o_totalprice), count(DISTINCT o_totalprice) FROM orders
  UNION ALL SELECT 'o_orderdate', count(*), count(*) - count(o_orderdate), count(DISTINCT o_orderdate) FROM orders
  UNION ALL SELECT 'o_orderpriority', count(*), count(*) - count(o_orderpriority), count(DISTINCT o_orderpriority)
            FROM orders) s USING ("column")""")
def q_table_profile(spark, sf_dir):
    return quality.profile(table(spark, sf_dir, "orders"))


REQUIRED = ["job_id", "skill", "skill_category", "posted_year", "experience_level", "source"]


@query("quality_report", "Q4 Q5 Q8 Q10 C17", f"""
WITH {CLEAN_CTE},
a AS (SELECT count(*) AS rows, count(CASE WHEN skill IS NULL THEN 1 END) AS null_skill,
             count(CASE WHEN posted_year IS NOT NULL AND NOT posted_year BETWEEN 2020 AND 2026 THEN 1 END) AS out_of_range,
             count(CASE WHEN skill_category IS NULL OR lower(skill_category) = 'unknown' THEN 1 END) AS unknown_cat,
             count(DISTINCT posted_year) AS years, count(posted_date) AS dates,
             count(CASE WHEN posted_date IS NOT NULL AND TRY_CAST(posted_date AS TIMESTAMP) IS NULL THEN 1 END) AS bad_dates
      FROM cl)
SELECT 'required_columns_missing' AS "check", 0.0::DOUBLE AS observed, 0.0::DOUBLE AS threshold, true AS passed FROM a
UNION ALL SELECT 'row_count', CAST(rows AS DOUBLE), 40000.0::DOUBLE, rows >= 40000 FROM a
UNION ALL SELECT 'null_skill_rows', CAST(null_skill AS DOUBLE), 0.0::DOUBLE, null_skill = 0 FROM a
UNION ALL SELECT 'year_out_of_range_rows', CAST(out_of_range AS DOUBLE), 0.0::DOUBLE, out_of_range = 0 FROM a
UNION ALL SELECT 'unknown_category_share', coalesce(unknown_cat / rows, 0.0), 0.05::DOUBLE, coalesce(unknown_cat / rows, 0.0) <= 0.05 FROM a
UNION ALL SELECT 'distinct_years', CAST(years AS DOUBLE), 3.0::DOUBLE, years >= 3 FROM a
UNION ALL SELECT 'unparsed_date_share', coalesce(bad_dates / dates, 0.0), 0.2::DOUBLE, coalesce(bad_dates / dates, 0.0) <= 0.2 FROM a""")
def q_quality_report(spark, sf_dir):
    return quality.quality_report(stored_clean_long(spark, sf_dir), REQUIRED)


@query("recommendation_check", "Q11", f"""
WITH {TREND_CTE.replace(analysis_sql("p_type", ["posted_year"]), analysis_sql("p_name", ["posted_year"]))},
rec AS (SELECT skill FROM tm WHERE skill IS NOT NULL GROUP BY skill ORDER BY count(*) DESC, skill LIMIT 40)
SELECT skill FROM rec WHERE skill NOT IN (SELECT unnest(trending) FROM tl)""")
def q_recommendation_check(spark, sf_dir):
    """Q11: of the 40 most frequent skills, those that are not trending."""
    counts = checkpointed(frequency.year_skill_counts(analysis_input(spark, sf_dir, "p_name", ["posted_year"])))
    recommended = frequency.top_of_counts(counts, 40)
    allowed = trends.trending_score(counts, 20, weight="mentions")
    return quality.subset_violations(recommended, allowed)


@query("column_overlap", "Q3", """
SELECT * FROM (VALUES ('doc_id', true, true), ('text', true, false), ('lang', true, false), ('source', true, false),
  ('n_chars', true, false), ('quality', false, true), ('toxic', false, true)) t("column", in_left, in_right)
LEFT JOIN (SELECT 'doc_id' AS "column", count(*) - count(doc_id) AS left_nulls FROM documents
  UNION ALL SELECT 'text', count(*) - count(text) FROM documents UNION ALL SELECT 'lang', count(*) - count(lang) FROM documents
  UNION ALL SELECT 'source', count(*) - count(source) FROM documents
  UNION ALL SELECT 'n_chars', count(*) - count(n_chars) FROM documents) l USING ("column")
LEFT JOIN (SELECT 'doc_id' AS "column", count(*) - count(doc_id) AS right_nulls FROM labels
  UNION ALL SELECT 'quality', count(*) - count(quality) FROM labels
  UNION ALL SELECT 'toxic', count(*) - count(toxic) FROM labels) r USING ("column")""")
def q_column_overlap(spark, sf_dir):
    return quality.column_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("value_counts", "Q2", """
SELECT "column", value, n, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value NULLS FIRST) AS r FROM (
    SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2
    UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2)) WHERE r <= 10""")
def q_value_counts(spark, sf_dir):
    return quality.value_counts(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("clean_steps", "Q7 Q9 Q12 C16", f"""
WITH {CLEAN_CTE}
SELECT 'skills_in' AS step, (SELECT count(*) FROM s0) AS rows, (SELECT count(*) FROM s0) = 0 AS empty
UNION ALL SELECT 'cleaned', (SELECT count(*) FROM cl), (SELECT count(*) FROM cl) = 0""")
def q_clean_steps(spark, sf_dir):
    """Row counts of the cleaning's steps, gathered while its one action runs."""
    jobs, skills = primary_sources(spark, sf_dir)
    out, log = quality.logged_clean_primary(skills, jobs)
    out.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(log.rows(), "step string, rows long, empty boolean")


@query("long_format_check", "Q7 Q8", f"""
WITH p AS ({TICKET_POSTINGS_SQL}),
b AS (SELECT count(*) AS rows, count(CASE WHEN skills_required IS NULL OR skills_required = '' THEN 1 END) AS none FROM p),
e AS (SELECT trim(unnest(string_split(skills_required, ','))) AS skill FROM p WHERE skills_required IS NOT NULL),
a AS (SELECT count(*) AS rows, count(CASE WHEN contains(skill, ',') THEN 1 END) AS lists FROM e WHERE skill <> '')
SELECT 'exploded_rows' AS "check", CAST(a.rows AS DOUBLE) AS observed, 0.0::DOUBLE AS threshold, a.rows >= b.rows - b.none AS passed FROM a, b
UNION ALL SELECT 'zero_extraction_rows', CAST(b.none AS DOUBLE), 0.0::DOUBLE, b.none = 0 FROM b
UNION ALL SELECT 'unsplit_values', CAST(a.lists AS DOUBLE), 0.0::DOUBLE, a.lists = 0 FROM a
UNION ALL SELECT 'derived_columns_missing', 1.0::DOUBLE, 0.0::DOUBLE, false FROM a""")
def q_long_format_check(spark, sf_dir):
    wide = checkpointed(ticket_postings(spark, sf_dir).select("job_title", "skills_required"))
    long = (wide.select("job_title", F.explode(F.split("skills_required", ",")).alias("s"))
            .select("job_title", F.trim("s").alias("skill")).filter(F.col("skill") != ""))
    return quality.long_format_report(wide, long, "skills_required", derived=["job_title", "category"])


@query("uploaded_table", "S4 S6 C2 C4 C10", f"""
WITH m AS ({mentions_sql("p_brand", ["posted_year"])}),
t AS (SELECT lower(trim(skill)) AS skill, CASE job_id % 3 WHEN 0 THEN CAST(posted_year AS VARCHAR)
        WHEN 1 THEN CAST(posted_year AS VARCHAR) || '.0' ELSE 'Not Specified' END AS y FROM m)
SELECT skill, CASE WHEN regexp_full_match(y, '[0-9]+') THEN CAST(y AS INTEGER) END AS posted_year, count(*) AS mentions
FROM t GROUP BY ALL""")
def q_uploaded_table(spark, sf_dir):
    """A table as users upload it: years as mixed text, a column too many, one too few."""
    raw = mentions(spark, sf_dir, "p_brand", ["posted_year", "line_number"])
    year = F.col("posted_year").cast("string")
    kind = F.col("job_id") % 3
    raw = raw.withColumn("posted_year", F.when(kind == 0, year).when(kind == 1, F.concat(year, F.lit(".0"))).otherwise("Not Specified"))
    clean = cleaning.load_clean(raw, ["job_id", "skill", "skill_category", "posted_year"])
    return clean.groupBy("skill", "posted_year").agg(F.count(F.lit(1)).alias("mentions"))


@query("optional_tables", "S4 S7 S8 S10", """
SELECT 'labels' AS name, (SELECT count(*) FROM labels) AS rows, 3 AS columns UNION ALL SELECT 'rules', 0, 2""")
def q_optional_tables(spark, sf_dir):
    """A table that is there and one that may be missing; the first through the
    intermediate that is reused while its input stays the same."""
    there = io.materialize(io.load_or_empty(spark, f"{sf_dir}/labels.parquet", "doc_id long, quality int, toxic int"), "labels")
    missing = io.load_or_empty(spark, f"{sf_dir}/rules_of_no_run.parquet", "antecedents string, consequents string")
    return there.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("labels").alias("name"), "rows", F.lit(len(there.columns)).alias("columns")).unionByName(
        missing.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("rules").alias("name"), "rows", F.lit(len(missing.columns)).alias("columns")))


@query("year_decimals", "C20", """
SELECT CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END AS year, count(*) AS orders
FROM orders GROUP BY 1""")
def q_year_decimals(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 11 == 0, "unknown").otherwise(F.concat(F.year("o_orderdate").cast("string"), F.lit(".0")))
    orders = table(spark, sf_dir, "orders").select(year_from_decimal(text).alias("year"))
    return orders.groupBy("year").agg(F.count(F.lit(1)).alias("orders"))


@query("sampled_join", "S2 J4", """
SELECT l_returnflag, count(*) AS lines, count(DISTINCT l_orderkey) AS orders FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1000) GROUP BY l_returnflag""")
def q_sampled_join(spark, sf_dir):
    """The first 1000 orders, as the sample of that name, joined with their lines."""
    sample = io.first_n(table(spark, sf_dir, "orders").select("o_orderkey"), 1000, "o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    return (lines.join(sample, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_returnflag")
            .agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("l_orderkey").alias("orders")))
