"""Driver tables and the long "mention" views built over them.

The reference works on one long fact table ``(job, skill, category, level,
year, experience, ...)``. Here it is a lazy view over the TPC-H-like tables:

    job_id           <- l_orderkey
    skill            <- a part attribute (p_brand by default, p_type, p_name)
    skill_category   <- p_type
    skill_level      <- l_returnflag
    posted_year      <- year(o_orderdate)
    experience_level <- c_mktsegment
    priority         <- o_orderpriority

The join is made once and kept (``mention_fact``). Its joins are plain
equi-joins; no side is forced to broadcast, so AQE picks broadcast only for a
side whose runtime size is below the threshold and sort-merge otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Which driver table each optional mention field needs.
_FIELD_SOURCE = {
    "skill_category": "part",
    "skill_level": "lineitem",
    "line_number": "lineitem",
    "posted_year": "orders",
    "order_date": "orders",
    "priority": "orders",
    "order_status": "orders",
    "customer_id": "orders",
    "experience_level": "customer",
}
ALL_FIELDS = tuple(_FIELD_SOURCE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (a parquet file or directory), read as it is laid out;
    ``spark.sql.files.maxPartitionBytes`` sizes the scan's tasks."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item with its part, order and customer."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), "l_partkey",
        F.col("l_linenumber").alias("line_number"), F.col("l_returnflag").alias("skill_level"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", "p_name")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("customer_id"),
        F.year("o_orderdate").cast("int").alias("posted_year"), F.col("o_orderdate").alias("order_date"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("order_status"))
    # a line counts where its part is known; what has no order or customer has nulls,
    # and the marks tell it from one whose fields are null
    cust = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("experience_level"), F.lit(True).alias("has_customer"))
    out = li.join(part, "l_partkey").join(orders.withColumn("has_order", F.lit(True)), "job_id", "left")
    return out.join(cust, "customer_id", "left")


def mention_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined line items, written to the shared folder by the first query that
    reads them and found again by the others as long as the tables stay the same:
    what is joined once serves every analysis with one scan of the columns it takes."""
    from demandlens.sources.io import materialize
    return materialize(_joined(spark, sf_dir), "mention_fact")


def mentions(spark: SparkSession, sf_dir: str, skill: str = "p_brand",
             fields: Iterable[str] = ALL_FIELDS) -> DataFrame:
    """Long mention table: one row per line item, ``job_id`` and ``skill`` always
    present, other ``fields`` on request (rows without what they come from drop out)."""
    fields = list(fields)
    unknown = set(fields) - set(_FIELD_SOURCE)
    if unknown:
        raise ValueError(f"unknown mention fields {sorted(unknown)}")
    need = {_FIELD_SOURCE[f] for f in fields}
    out = mention_fact(spark, sf_dir)
    if need & {"orders", "customer"}:
        out = out.where("has_order")
    if "customer" in need:
        out = out.where("has_customer")
    named = {"skill_category": F.col("p_type").alias("skill_category")}
    return out.select("job_id", F.col(skill).alias("skill"), *[named.get(f, F.col(f)) for f in fields])


def mentions_sql(skill: str = "p_brand", fields: Iterable[str] = ALL_FIELDS) -> str:
    """The same view as DuckDB SQL over the pre-registered driver views."""
    fields = list(fields)
    need = {_FIELD_SOURCE[f] for f in fields}
    if "customer" in need:
        need.add("orders")
    expr = {
        "skill_category": "p.p_type",
        "skill_level": "l.l_returnflag",
        "line_number": "l.l_linenumber",
        "posted_year": "CAST(year(o.o_orderdate) AS INTEGER)",
        "order_date": "o.o_orderdate",
        "priority": "o.o_orderpriority",
        "order_status": "o.o_orderstatus",
        "customer_id": "o.o_custkey",
        "experience_level": "c.c_mktsegment",
    }
    cols = ["l.l_orderkey AS job_id", f"p.{skill} AS skill"]
    cols += [f"{expr[f]} AS {f}" for f in fields]
    sql = f"SELECT {', '.join(cols)} FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey"
    if "orders" in need:
        sql += " JOIN orders o ON l.l_orderkey = o.o_orderkey"
    if "customer" in need:
        sql += " JOIN customer c ON o.o_custkey = c.c_custkey"
    return sql


def validation_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stand-in for the secondary (validation) inputs.

    ``job_skills``: (job_link, job_skills) -- each document's text is the
    comma-separated skill list. ``postings``: the postings sample, i.e. the
    documents that carry labels, with job_title <- source, job_level <- lang.
    """
    docs = table(spark, sf_dir, "documents")
    job_skills = docs.select(F.col("doc_id").alias("job_link"), F.col("text").alias("job_skills"))
    postings = (table(spark, sf_dir, "labels").select(F.col("doc_id").alias("job_link"))
                .join(docs.select(F.col("doc_id").alias("job_link"),
                                  F.col("source").alias("job_title"),
                                  F.col("lang").alias("job_level")), "job_link"))
    return job_skills, postings


VALIDATION_POSTINGS_SQL = (
    "SELECT l.doc_id AS job_link, d.source AS job_title, d.lang AS job_level "
    "FROM labels l JOIN documents d ON l.doc_id = d.doc_id")


def profiles(spark: SparkSession, sf_dir: str, bought: DataFrame | None = None) -> DataFrame:
    """Stand-in for user skill profiles: one row per customer (``user_id``,
    ``skills_text``). The text lists the part types of all the customer's
    orders, in the order they were first bought (then by name); a customer
    without orders has none. By customer number modulo 25 some texts are junk,
    as users write it: 0 a trivial word, 1 a single letter, 2 aliases and a
    repeat before the list, 3 a long phrase before it, 4 skills that no part
    has. ``bought`` (customer_id, job_id, skill) stands in for the joined line
    items where they have been read already."""
    if bought is None:
        bought = mentions(spark, sf_dir, "p_type", ["customer_id"])
    types = (bought.where("skill is not null").groupBy(F.col("customer_id").alias("user_id"), F.col("skill").alias("p_type"))
             .agg(F.min("job_id").alias("first")))  # partial aggregate per task
    lists = types.groupBy("user_id").agg(F.array_join(F.transform(  # bounded by the number of part types
        F.sort_array(F.collect_list(F.struct("first", "p_type"))), lambda x: x["p_type"]), ", ").alias("own"))
    kind = F.col("user_id") % 25
    text = (F.when(kind == 0, F.lit("n/a")).when(kind == 1, F.lit("R"))
             .when(kind == 2, F.concat(F.lit("sklearn, Scikit Learn,  SQL , sql, "), "own"))
             .when(kind == 3, F.concat(F.lit("a person who is good with people, "), "own"))
             .when(kind == 4, F.lit("Pottery, Gardening")).otherwise(F.col("own")))
    return (table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")).join(lists, "user_id", "left")
            .select("user_id", text.alias("skills_text")))


PROFILES_SQL = """
SELECT c.c_custkey AS user_id,
       CASE c.c_custkey % 25 WHEN 0 THEN 'n/a' WHEN 1 THEN 'R' WHEN 2 THEN 'sklearn, Scikit Learn,  SQL , sql, ' || own
            WHEN 3 THEN 'a person who is good with people, ' || own WHEN 4 THEN 'Pottery, Gardening' ELSE own END AS skills_text
FROM customer c LEFT JOIN (
  SELECT user_id, string_agg(p_type, ', ' ORDER BY f, p_type) AS own
  FROM (SELECT o.o_custkey AS user_id, p.p_type, min(o.o_orderkey) AS f
        FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey
        GROUP BY o.o_custkey, p.p_type) GROUP BY user_id) t ON t.user_id = c.c_custkey"""


def primary_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stand-in for the two raw primary files (jobs, skills), with the id
    defects the key repair exists for.

    jobs (one row per order): job_id = 11-char zero-padded (orderkey div 2) + (orderkey mod 2),
    so two jobs share each 11-char prefix; ordinal = orderkey (file order);
    text metadata with raw case; numbers and dates as text.
    skills (one row per line item): job_id by line number mod 3 -- the job id
    as is, 'E' + its first 11 characters, or a junk id, which stays unmatched; skill = p_brand,
    upper-cased on even line numbers (case variants); category p_type; level
    l_returnflag.
    """
    jid = F.concat(F.lpad(F.expr("CAST(o_orderkey DIV 2 AS STRING)"), 11, "0"),
                   F.expr("CAST(o_orderkey % 2 AS STRING)"))
    orders = table(spark, sf_dir, "orders")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    jobs = (orders
            .join(cust, orders["o_custkey"] == cust["c_custkey"])
            .join(nation, "c_nationkey")
            .select(jid.alias("job_id"), F.col("o_orderkey").alias("ordinal"),
                    F.col("o_orderpriority").alias("job_title"),
                    F.col("c_mktsegment").alias("experience_level"),
                    F.col("n_name").alias("country"),
                    F.col("c_nationkey").cast("string").alias("min_experience_years"),
                    F.floor("o_totalprice").cast("string").alias("salary_min_usd"),
                    F.col("o_totalprice").cast("string").alias("salary_max_usd"),
                    F.year("o_orderdate").cast("string").alias("posted_year"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("posted_date")))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    own = F.concat(F.lpad(F.expr("CAST(l_orderkey DIV 2 AS STRING)"), 11, "0"),
                   F.expr("CAST(l_orderkey % 2 AS STRING)"))
    form = F.col("l_linenumber") % 3
    skill_id = (F.when(form == 0, own)
                 .when(form == 1, F.concat(F.lit("E"), F.substring(own, 1, 11)))
                 .otherwise(F.concat(F.lit("J"), own)))
    skills = (li.join(part, "l_partkey")
              .select(skill_id.alias("job_id"),
                      F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("skill"),
                      F.col("p_type").alias("skill_category"),
                      F.col("l_returnflag").alias("skill_level")))
    return jobs, skills


PRIMARY_JOBS_SQL = """
SELECT lpad(CAST(o.o_orderkey // 2 AS VARCHAR), 11, '0') || CAST(o.o_orderkey % 2 AS VARCHAR) AS job_id,
       o.o_orderkey AS ordinal, o.o_orderpriority AS job_title, c.c_mktsegment AS experience_level,
       n.n_name AS country, CAST(c.c_nationkey AS VARCHAR) AS min_experience_years,
       CAST(CAST(floor(o.o_totalprice) AS BIGINT) AS VARCHAR) AS salary_min_usd,
       CAST(o.o_totalprice AS VARCHAR) AS salary_max_usd,
       CAST(year(o.o_orderdate) AS VARCHAR) AS posted_year, strftime(o.o_orderdate, '%Y-%m-%d') AS posted_date
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey"""

PRIMARY_SKILLS_SQL = """
SELECT CASE l.l_linenumber % 3
         WHEN 0 THEN lpad(CAST(l.l_orderkey // 2 AS VARCHAR), 11, '0') || CAST(l.l_orderkey % 2 AS VARCHAR)
         WHEN 1 THEN 'E' || substr(lpad(CAST(l.l_orderkey // 2 AS VARCHAR), 11, '0') || CAST(l.l_orderkey % 2 AS VARCHAR), 1, 11)
         ELSE 'J' || lpad(CAST(l.l_orderkey // 2 AS VARCHAR), 11, '0') || CAST(l.l_orderkey % 2 AS VARCHAR) END AS job_id,
       CASE WHEN l.l_linenumber % 2 = 0 THEN upper(p.p_brand) ELSE p.p_brand END AS skill,
       p.p_type AS skill_category, l.l_returnflag AS skill_level
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey"""


def ticket_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for the contract's postings table (job_title, skills_required,
    date_posted, experience_level, company_location), one row per order:
    title <- market segment (raw case), skills <- the order's distinct part brands as a
    comma list (orders without lines have none), date <- order date as text
    (every 50th order carries an unparsable date), level <- a code from the
    order priority (EX / SE / MI / EN; '4-NOT SPECIFIED' has none),
    location <- the customer's nation."""
    orders = table(spark, sf_dir, "orders")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    lines = (table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
             .join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
             .select("o_orderkey", "p_brand").distinct()  # a partial aggregate: what is collected is bounded by the brands, not by the order's lines
             .groupBy("o_orderkey").agg(F.concat_ws(", ", F.sort_array(F.collect_list("p_brand"))).alias("skills_required")))
    level = (F.when(F.col("o_orderpriority") == "1-URGENT", "EX").when(F.col("o_orderpriority") == "2-HIGH", "SE")
              .when(F.col("o_orderpriority") == "3-MEDIUM", "MI").when(F.col("o_orderpriority") == "5-LOW", "EN"))
    date = F.when(F.col("o_orderkey") % 50 == 0, F.lit("not a date")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd"))
    return (orders.join(cust, orders["o_custkey"] == cust["c_custkey"]).join(nation, "c_nationkey")
            .join(lines, "o_orderkey", "left")
            .select(F.col("c_mktsegment").alias("job_title"), "skills_required", date.alias("date_posted"),
                    level.alias("experience_level"), F.col("n_name").alias("company_location")))


TICKET_POSTINGS_SQL = """
SELECT c.c_mktsegment AS job_title, li.skills_required,
       CASE WHEN o.o_orderkey % 50 = 0 THEN 'not a date' ELSE strftime(o.o_orderdate, '%Y-%m-%d') END AS date_posted,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'EX' WHEN '2-HIGH' THEN 'SE' WHEN '3-MEDIUM' THEN 'MI'
                              WHEN '5-LOW' THEN 'EN' END AS experience_level,
       n.n_name AS company_location
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT l.l_orderkey, array_to_string(list_sort(list(DISTINCT p.p_brand)), ', ') AS skills_required
           FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY l.l_orderkey) li
  ON li.l_orderkey = o.o_orderkey"""
