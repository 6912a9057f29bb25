"""Registered queries: extraction with a large taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.operators import extract, phrases
from demandlens.plans.registry import query
from demandlens.session import checkpointed
from demandlens.sources.tables import table

#: The beginning of a line: three words with what stands between and behind them.
OPENING = r"^[^ \t\r\n]+ [^ \t\r\n]+ [^ \t\r\n]+"


def line_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(category, skill): all part names and types, and how the lines of the
    documents begin; its size follows the tables."""
    part = table(spark, sf_dir, "part")
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    opening = lines.select(F.regexp_extract("line", OPENING, 0).alias("skill")).where("skill != ''")
    named = part.select(F.explode(F.array(F.struct(F.lit("name").alias("category"), F.col("p_name").alias("skill")),
                                          F.struct(F.lit("type").alias("category"), F.col("p_type").alias("skill")))).alias("x")).select("x.*")
    # a skill belongs to one category
    return named.unionByName(opening.select(F.lit("opening").alias("category"), "skill")).groupBy("skill").agg(F.min("category").alias("category"))


@query("large_taxonomy_extract", "X1 X2 X3 X4", r"""
WITH named AS (
  SELECT 'name' AS category, p_name AS skill FROM part UNION ALL SELECT 'type', p_type FROM part
  UNION ALL SELECT 'opening', regexp_extract(line, '^[^ \t\r\n]+ [^ \t\r\n]+ [^ \t\r\n]+') FROM (
    SELECT unnest(string_split(text, chr(10))) AS line FROM documents)),
tax AS MATERIALIZED (
  SELECT skill, min(category) AS category, lower(skill) AS low, regexp_extract(lower(skill), '[\p{L}\p{N}_]+') AS word,
         '(?i)(^|[^\p{L}\p{N}_])' || regexp_replace(skill, '([.^$*+?()\[\]{}|\\])', '\\\1', 'g') || '([^\p{L}\p{N}_]|$)' AS pattern
  FROM named WHERE skill != '' GROUP BY skill),
d AS MATERIALIZED (SELECT doc_id, text, lower(text) AS low, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') || ['']) AS words FROM documents),
u AS (SELECT doc_id, unnest(words) AS word FROM d),
pair AS MATERIALIZED (SELECT u.doc_id, tax.skill FROM u JOIN tax USING (word)),
near AS MATERIALIZED (SELECT doc_id, skill FROM pair JOIN d USING (doc_id) JOIN tax USING (skill) WHERE contains(d.low, tax.low))
SELECT doc_id, skill, category FROM near JOIN d USING (doc_id) JOIN tax USING (skill) WHERE regexp_matches(text, pattern)""")
def q_large_taxonomy_extract(spark, sf_dir):
    """Every phrase of a taxonomy that grows with the tables, in every document."""
    taxonomy = checkpointed(line_taxonomy(spark, sf_dir))  # read by the index and for the categories
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return extract.attach_category(phrases.match_phrases(docs, "text", taxonomy, "doc_id"), taxonomy)
