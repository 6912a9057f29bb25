"""Registered queries: wide forms, distinct counts, key sets, names in names and
checked outputs (M8, K2, A13, A19, A4, A7, Q1, Q2, S3, J5, J8, G5, S9, Q12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlens.operators import containment, cooccur, crosstab, distinct, gap, keyset, wide
from demandlens.plans.baskets import RULES_SQL, _rules
from demandlens.plans.gap import GAP_CTE, _match
from demandlens.plans.inputs import analysis_input, analysis_sql
from demandlens.plans.registry import query
from demandlens.session import checkpointed
from demandlens.sources.tables import mentions, mentions_sql, profiles, table

#: Part types as the analysis sees them, and as they are written; the years.
TYPES = ["economy", "large", "medium", "promo", "small", "standard"]
RAW_TYPES = [t.upper() for t in TYPES]
YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]


def _cells(names, when: str, then: str, fill: str = "0") -> str:
    return ", ".join(f'coalesce(sum(CASE WHEN {when} = {n!r} THEN {then} END), {fill}) AS "{n}"' for n in names)


@query("rule_lift_wide", "M8", RULES_SQL + f"""
, l AS (SELECT antecedents, consequents, avg(lift) AS lift FROM sel GROUP BY ALL)
SELECT antecedents, {", ".join(f'''max(CASE WHEN consequents = '{t}' THEN lift END) AS "{t}"''' for t in RAW_TYPES)} FROM l GROUP BY antecedents""")
def q_rule_lift_wide(spark, sf_dir):
    return wide.lift_table(_rules(spark, sf_dir), RAW_TYPES)


@query("cooccurrence_wide", "K2", f"""
WITH m AS ({analysis_sql("p_type", [])}),
js AS (SELECT DISTINCT job_id, skill FROM m WHERE skill IS NOT NULL),
p AS (SELECT a.skill AS skill_a, b.skill AS skill_b, count(*) AS n FROM js a JOIN js b ON a.job_id = b.job_id AND a.skill != b.skill GROUP BY ALL),
g AS (SELECT DISTINCT skill AS skill_a FROM js)
SELECT skill_a, {", ".join(f'''CAST(coalesce(sum(CASE WHEN skill_b = '{t}' THEN n END), 0) AS BIGINT) AS "{t}"''' for t in TYPES)}
FROM g LEFT JOIN p USING (skill_a) GROUP BY skill_a""")
def q_cooccurrence_wide(spark, sf_dir):
    return wide.cooccurrence_table(cooccur.cooccurrence_matrix(analysis_input(spark, sf_dir, "p_type", []), top_n=11), TYPES)


@query("annual_share_wide", "A13", f"""
WITH m AS ({analysis_sql("p_name", ["posted_year"])}),
a AS (SELECT posted_year, skill, count(*) / sum(count(*)) OVER (PARTITION BY posted_year) AS share FROM m
      WHERE posted_year IS NOT NULL GROUP BY posted_year, skill),
w AS (SELECT skill, {", ".join(f'max(CASE WHEN posted_year = {y} THEN share END) AS "{y}"' for y in YEARS)} FROM a WHERE skill IS NOT NULL GROUP BY skill)
SELECT skill, {", ".join(f'coalesce("{y}", 0.0) AS "{y}"' for y in YEARS)}, ("{YEARS[-1]}" - "{YEARS[0]}") * 100 AS change_pp FROM w""")
def q_annual_share_wide(spark, sf_dir):
    return wide.share_table(analysis_input(spark, sf_dir, "p_name", ["posted_year"]), YEARS)


_LEVELS = f"""m AS ({analysis_sql("p_type", ["experience_level"])}),
x AS (SELECT experience_level, skill, count(*) AS n FROM m WHERE experience_level IS NOT NULL AND skill IS NOT NULL GROUP BY ALL)"""


@query("experience_counts_wide", "A19", f"""
WITH {_LEVELS}
SELECT experience_level, {", ".join(f'''CAST(coalesce(sum(CASE WHEN skill = '{t}' THEN n END), 0) AS BIGINT) AS "{t}"''' for t in TYPES)}
FROM x GROUP BY experience_level""")
def q_experience_counts_wide(spark, sf_dir):
    return wide.level_table(crosstab.experience_crosstab(analysis_input(spark, sf_dir, "p_type", ["experience_level"])), TYPES)


@query("experience_share_wide", "A20", f"""
WITH {_LEVELS}, s AS (SELECT *, n / sum(n) OVER (PARTITION BY experience_level) AS share FROM x)
SELECT experience_level, {", ".join(f'''coalesce(max(CASE WHEN skill = '{t}' THEN share END), 0.0) AS "{t}"''' for t in TYPES)}
FROM s GROUP BY experience_level""")
def q_experience_share_wide(spark, sf_dir):
    cells = crosstab.experience_crosstab(analysis_input(spark, sf_dir, "p_type", ["experience_level"]))
    return wide.level_table(cells, TYPES, "share")


# --- distinct counts -------------------------------------------------------

_CARDS = ["job_id", "skill", "skill_category", "customer_id"]
_CARDS_SQL = mentions_sql("p_name", ["skill_category", "posted_year", "customer_id"])


def _yearly_sql(rows: str) -> str:
    return " UNION ALL ".join(f"SELECT {rows}, '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, "
                              f"count(DISTINCT {c}) AS distinct FROM m GROUP BY ALL" for c in _CARDS)


@query("yearly_distinct", "A4 A7 Q2", f"WITH m AS ({_CARDS_SQL}) {_yearly_sql('posted_year')}")
def q_yearly_distinct(spark, sf_dir):
    """Exact distinct values of four columns in each year, from one read."""
    rows = mentions(spark, sf_dir, "p_name", ["skill_category", "posted_year", "customer_id"])
    return distinct.distinct_counts(rows, _CARDS, ["posted_year"])


@query("sketched_distinct", "A4 A7 Q1", f"""
WITH m AS ({_CARDS_SQL}), e AS ({_yearly_sql("CAST(NULL AS INTEGER) AS posted_year")} UNION ALL {_yearly_sql('posted_year')})
SELECT posted_year, "column", rows, "distinct" AS exact, true AS within_bound FROM e""")
def q_sketched_distinct(spark, sf_dir):
    """Each year's sketches, and all years' from merging them, beside the exact
    counts: within four standard errors."""
    rows = mentions(spark, sf_dir, "p_name", ["skill_category", "posted_year", "customer_id"])
    parts = checkpointed(distinct.sketches(rows, _CARDS, ["posted_year"]))  # a few KB for each year and column
    none = F.lit(None).cast("int").alias("posted_year")
    found = distinct.estimates(parts).unionByName(distinct.estimates(distinct.merged(parts)).select(none, "column", "rows", "distinct"))
    exact = distinct.distinct_counts(rows, _CARDS, ["posted_year"]).unionByName(distinct.distinct_counts(rows, _CARDS).select(none, "column", "rows", "nulls", "distinct"))
    exact = exact.select("posted_year", "column", F.col("distinct").alias("exact"))
    off = F.abs(F.col("distinct") - F.col("exact")) <= F.col("exact") * 4 * 1.04 / 2 ** (distinct.LG_K / 2)
    same = F.col("x.posted_year").eqNullSafe(F.col("y.posted_year")) & (F.col("x.column") == F.col("y.column"))
    return found.alias("x").join(exact.alias("y"), same).select("x.posted_year", "x.column", "rows", "exact", off.alias("within_bound"))


# --- key sets and names -----------------------------------------------------

@query("key_set_lines", "S3 J5", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')""")
def q_key_set_lines(spark, sf_dir):
    """The lines of a large set of orders: filtered in the scan, then joined exactly."""
    chosen = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return keyset.semi_join(lines, chosen, "l_orderkey")


_NAMES_SQL = """
SELECT DISTINCT lower(p_name) AS name FROM part UNION SELECT lower(p_type) FROM part UNION SELECT lower(p_brand) FROM part
UNION SELECT lower(w) FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)"""


def _names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    each = F.concat(F.array("p_name", "p_type", "p_brand"), F.split("p_name", " "))
    return part.select(F.explode(each).alias("name")).select(F.lower("name").alias("name")).distinct()


@query("names_in_names", "J8", f"""
WITH n AS ({_NAMES_SQL})
SELECT a.name AS "left", b.name AS "right" FROM n a JOIN n b ON {_match('a.name', 'b.name')}""")
def q_names_in_names(spark, sf_dir):
    """All pairs among the parts' names, types, brands and words that match."""
    names = _names(spark, sf_dir)
    return containment.matches(names, names)


@query("profile_name_matches", "G5 J8", f"""
WITH {GAP_CTE}, n AS ({_NAMES_SQL}),
u AS (SELECT user_id, unnest(user_skills) AS skill FROM p5)
SELECT u.user_id, u.skill, n.name FROM u JOIN n ON {_match('u.skill', 'n.name')}""")
def q_profile_name_matches(spark, sf_dir):
    """Every profile's skills against all names instead of a list of 20."""
    parsed = gap.parse_profiles(profiles(spark, sf_dir)).where("valid").select("user_id", "user_skills")
    return containment.matched_skills(parsed, _names(spark, sf_dir))
