"""Registered queries: reading, refused values, ingest order and step log (S1,
S2, S6, S12, C3, C5, C6, C16, C17, J1, Q9)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.operators import cleaning, steplog
from demandlens.operators.quality import MIN_ROWS
from demandlens.plans.registry import query
from demandlens.session import tables_folder
from demandlens.sources import ingest, io
from demandlens.sources.tables import TICKET_POSTINGS_SQL, table, ticket_postings

_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
STEPS_CTE = f"""
p AS ({TICKET_POSTINGS_SQL}),
s1 AS (SELECT {_STRIP.format('job_title')} AS job_title, lower({_STRIP.format('skills_required')}) AS skills_required,
              lower({_STRIP.format('date_posted')}) AS date_posted, lower({_STRIP.format('experience_level')}) AS experience_level,
              lower({_STRIP.format('company_location')}) AS company_location
       FROM p WHERE skills_required IS NOT NULL AND {_STRIP.format('skills_required')} <> ''),
s5 AS (SELECT * FROM s1 WHERE TRY_CAST(date_posted AS TIMESTAMP) IS NOT NULL),
s8 AS (SELECT DISTINCT * FROM s5),
k AS (SELECT (SELECT count(*) FROM p) AS n0, (SELECT count(*) FROM s1) AS n1, (SELECT count(*) FROM s5) AS n5, (SELECT count(*) FROM s8) AS n8)"""


@query("posting_step_log", "C16 C17 Q7 Q9", f"""
WITH {STEPS_CTE},
l AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10]) AS step_no,
             unnest(['drop rows without skills', 'strip text', 'lower-case text', 'parse dates', 'drop unparsed dates',
                     'derive periods', 'fill levels', 'drop duplicates', 'reset index', 'final count']) AS step,
             unnest([n0, n1, n1, n1, n1, n5, n5, n5, n8, n8]) AS rows_before,
             unnest([n1, n1, n1, n1, n5, n5, n5, n8, n8, n8]) AS rows_after FROM k)
SELECT *, rows_before - rows_after AS dropped FROM l""")
def q_posting_step_log(spark, sf_dir):
    """Rows before and after each of the ten steps, counted in the cleaning's own action."""
    return steplog.clean_logged(ticket_postings(spark, sf_dir)).log(spark)


@query("cleaning_gates", "C17 Q9", f"""
WITH {STEPS_CTE}
SELECT 'rows_after_null_filter' AS "check", CAST(n1 AS DOUBLE) AS observed, 1.0::DOUBLE AS threshold, n1 >= 1 OR n0 = 0 AS passed FROM k
UNION ALL SELECT 'unparsed_date_share', (n1 - n5) / n1, 0.2::DOUBLE, (n1 - n5) / n1 <= 0.2 FROM k
UNION ALL SELECT 'derived_columns_missing', 0.0::DOUBLE, 0.0::DOUBLE, true FROM k""")
def q_cleaning_gates(spark, sf_dir):
    return steplog.clean_logged(ticket_postings(spark, sf_dir), strict=False).report(spark)


# --- refused values ---------------------------------------------------------

FIELDS = {"order_id": "bigint", "title": "string", "years": "bigint", "salary": "double", "posted": "date"}

RAW_LINES_SQL = """
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 41 = 0 THEN '2.5' WHEN o_orderkey % 43 = 0 THEN '' ELSE CAST(o_orderkey % 30 AS VARCHAR) END AS years,
       CASE WHEN o_orderkey % 37 = 0 THEN 'n/a' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS salary,
       CASE WHEN o_orderkey % 50 = 0 THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS posted, o_orderpriority AS title
FROM orders"""


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV lines of the orders as users hand them in: numbers that are none, blanks,
    dates that are none, and lines with a field too few or too many."""
    k = F.col("o_orderkey")
    years = F.when(k % 41 == 0, "2.5").when(k % 43 == 0, "").otherwise((k % 30).cast("string"))
    salary = F.when(k % 37 == 0, "n/a").otherwise(F.floor("o_totalprice").cast("string"))
    posted = F.when(k % 50 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    whole = F.concat_ws(",", k.cast("string"), "o_orderpriority", years, salary, posted)
    short = F.concat_ws(",", k.cast("string"), "o_orderpriority", years, salary)
    line = F.when(k % 101 == 0, short).when(k % 103 == 0, F.concat(whole, F.lit(",x"))).otherwise(whole)
    return table(spark, sf_dir, "orders").select(line.alias("value"))


def _uploaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    with tables_folder(spark) as folder:
        path = os.path.join(folder, "upload")
    raw_lines(spark, sf_dir).write.text(path)
    return ingest.read_csv_text(spark, path, list(FIELDS), header=False)


_BAD_CTE = f"""
r AS ({RAW_LINES_SQL}),
t AS (SELECT *, k % 101 = 0 OR k % 103 = 0 AS broken,
             concat_ws(',', k, title, years, salary) || CASE WHEN k % 101 = 0 THEN '' ELSE ',' || posted || ',x' END AS line FROM r),
bad AS (SELECT k AS order_id, NULL::VARCHAR AS "column", line AS raw, 'wrong number of fields' AS reason FROM t WHERE broken
  UNION ALL SELECT k, 'years', years, 'no whole number' FROM t WHERE NOT broken AND years = '2.5'
  UNION ALL SELECT k, 'salary', salary, 'no number' FROM t WHERE NOT broken AND salary = 'n/a'
  UNION ALL SELECT k, 'posted', posted, 'no date' FROM t WHERE NOT broken AND posted = 'not a date')"""


@query("quarantined_values", "S1 C3 C5", f"WITH {_BAD_CTE} SELECT * FROM bad")
def q_quarantined_values(spark, sf_dir):
    """Every refused value of an uploaded CSV, with its row's id, and why."""
    return ingest.quarantine(_uploaded(spark, sf_dir), FIELDS, ["order_id"])[1]


@query("quarantine_clean", "S1 C3 C5", f"""
WITH {_BAD_CTE}
SELECT k AS order_id, title, TRY_CAST(years AS BIGINT) AS years, CAST(salary AS DOUBLE) AS salary, CAST(posted AS DATE) AS posted
FROM t WHERE k NOT IN (SELECT order_id FROM bad)""")
def q_quarantine_clean(spark, sf_dir):
    """The typed rows of the same CSV in which nothing was refused."""
    return ingest.quarantine(_uploaded(spark, sf_dir), FIELDS)[0]


@query("quarantine_balance", "S1 C3 C5", f"""
WITH {_BAD_CTE}
SELECT (SELECT count(*) FROM r) AS rows, (SELECT count(*) FROM r) - count(DISTINCT order_id) AS clean,
       count(DISTINCT order_id) AS refused, count(*) AS refused_values FROM bad""")
def q_quarantine_balance(spark, sf_dir):
    return ingest.balance(_uploaded(spark, sf_dir), FIELDS)


# --- uploads, encodings -------------------------------------------------------

@query("uploaded_csv", "S6 S12 C2 C4 C10", r"""
WITH d AS (SELECT doc_id, lower(regexp_extract(text, '^[A-Za-zÀ-ÿ]+')) AS skill, lower(lang) AS lang FROM documents)
SELECT skill, lang AS skill_category, CASE WHEN doc_id % 3 > 0 THEN CAST(2000 + doc_id % 7 AS INTEGER) END AS posted_year, count(*) AS mentions
FROM d WHERE skill <> '' GROUP BY ALL""")
def q_uploaded_csv(spark, sf_dir):
    """From the files of an upload, some UTF-8, some Latin-1, to a count."""
    k = F.col("doc_id")
    year = (2000 + k % 7).cast("string")
    rows = table(spark, sf_dir, "documents").select(
        k.cast("string").alias("job_id"), F.concat(F.lit(" "), F.regexp_extract("text", "^[A-Za-zÀ-ÿ]+", 0)).alias("skill"),
        F.upper("lang").alias("skill_category"), F.when(k % 3 > 0, year).otherwise(F.concat(year, F.lit(".0"))).alias("posted_year"),
        F.lit("upload").alias("remark")).where("skill != ' '")
    with tables_folder(spark) as folder:
        path = os.path.join(folder, "upload")
    for odd, encoding in ((0, "UTF-8"), (1, "ISO-8859-1")):
        (rows.where(F.col("job_id").cast("long") % 2 == odd).write.mode("append").option("header", True)
         .option("encoding", encoding).option("ignoreLeadingWhiteSpace", False).csv(path))
    columns = ["job_id", "skill", "skill_category", "skill_level", "posted_year"]
    clean = ingest.load_upload(spark, path, rows.columns, columns)
    return clean.groupBy("skill", "skill_category", "posted_year").agg(F.count(F.lit(1)).alias("mentions"))


# --- order of ingest ----------------------------------------------------------

@query("ingest_first_last", "S2 C6 J1", """
WITH l AS (SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER () AS r FROM lineitem)
SELECT l_partkey, arg_min(l_orderkey, r) AS first_order, arg_min(l_linenumber, r) AS first_line,
       arg_max(l_orderkey, r) AS last_order, arg_max(l_linenumber, r) AS last_line FROM l GROUP BY l_partkey""")
def q_ingest_first_last(spark, sf_dir):
    """Per part its first and its last line as they stand in the files."""
    lines = ingest.read_ordered(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet").select("l_partkey", "l_orderkey", "l_linenumber", ingest.ORDINAL)
    row = F.struct("l_orderkey", "l_linenumber")
    ends = lines.groupBy("l_partkey").agg(F.min_by(row, ingest.ORDINAL).alias("a"), F.max_by(row, ingest.ORDINAL).alias("z"))
    return ends.select("l_partkey", F.col("a.l_orderkey").alias("first_order"), F.col("a.l_linenumber").alias("first_line"),
                       F.col("z.l_orderkey").alias("last_order"), F.col("z.l_linenumber").alias("last_line"))


@query("ingest_key_repair", "J1 S2 C6", """
WITH o AS (SELECT *, row_number() OVER () - 1 AS r FROM orders),
j AS (SELECT 'P' || CAST(o_custkey AS VARCHAR) AS prefix, o_orderkey, r FROM o)
SELECT prefix, arg_min(o_orderkey, r) AS first_order, arg_max(o_orderkey, r) AS last_order, min(r) AS first_row, max(r) AS last_row
FROM j GROUP BY prefix""")
def q_ingest_key_repair(spark, sf_dir):
    """The last row of a prefix wins, the first row of a key stays: by dense row
    numbers in ingest order."""
    orders = ingest.read_ordered(spark, f"{sf_dir.rstrip('/')}/orders.parquet").select("o_custkey", "o_orderkey", ingest.ORDINAL)
    rows = ingest.row_numbers(orders).select(F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("prefix"), "o_orderkey", "row_number")
    first = cleaning.first_by_key(rows, "prefix", "row_number").select("prefix", F.col("o_orderkey").alias("first_order"))
    last = cleaning.last_by_key(rows, "prefix", "o_orderkey", "row_number", "last_order")
    ends = rows.groupBy("prefix").agg(F.min("row_number").alias("first_row"), F.max("row_number").alias("last_row"))
    return first.join(last, "prefix").join(ends, "prefix")


@query("ingest_sample", "S2 J4", """
SELECT l_orderkey, l_linenumber, l_returnflag FROM (SELECT *, row_number() OVER () AS r FROM lineitem) WHERE r <= 1000""")
def q_ingest_sample(spark, sf_dir):
    """The first 1000 rows as they stand in the files, the sample of that name."""
    lines = ingest.read_ordered(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", ingest.ORDINAL)
    return ingest.first_rows(lines, 1000).drop(ingest.ORDINAL)


@query("validated_upload", "Q4 Q5 Q6 S5", """
SELECT 'required_columns_missing' AS "check", 1.0::DOUBLE AS observed, 0.0::DOUBLE AS threshold, false AS passed
UNION ALL SELECT 'row_count_at_least', CAST(count(*) AS DOUBLE), 40000.0::DOUBLE, count(*) >= 40000 FROM orders""")
def q_validated_upload(spark, sf_dir):
    """The report on an uploaded CSV that lacks a required column; nothing is raised."""
    with tables_folder(spark) as folder:
        path = os.path.join(folder, "jobs")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("job_title"))
    io.write_table(rows, path, "csv")
    report = io.validated_load(spark, path, "job_id string, job_title string", ["job_id", "job_title", "posted_year"], MIN_ROWS)[1]
    return io.validation_report(spark, report)
