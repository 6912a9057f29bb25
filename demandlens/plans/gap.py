"""Registered queries: skill-gap matching over the profiles table."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlens.operators import basket, gap
from demandlens.plans.baskets import RULES_SQL
from demandlens.plans.inputs import analysis_sql
from demandlens.plans.registry import query
from demandlens.session import checkpointed
from demandlens.sources.tables import PROFILES_SQL, mentions, profiles


def _q(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x=x)


def _valid(t: str) -> str:
    return (f"({t} <> '' AND lower({t}) NOT IN ({_q(gap.TRIVIAL_INPUTS)}) AND length({t}) >= 2 "
            f"AND regexp_matches({t}, '[a-zA-Z]') AND lower({t}) NOT IN ({_q(gap.EVERYTHING_PHRASES)}) "
            f"AND (len(string_split_regex({t}, '\\s+')) <= {gap.LONG_PHRASE_WORDS} "
            f"OR regexp_matches({t}, '{gap.LONG_PHRASE_KEYWORDS}')))")


def _canon(t: str) -> str:
    c = f"regexp_replace({_strip(t)}, '\\s+', ' ', 'g')"
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in gap.COMMON_SKILL_ALIASES.items())
    return (f"coalesce(CASE lower({c}) {cases} END, "
            f"CASE WHEN lower({c}) IN ({_q(gap.LOWER_CASE_SKILLS)}) THEN lower({c}) END, {c})")


def _match(u: str, t: str) -> str:
    x, y = f"lower({_strip(u)})", f"lower({_strip(t)})"
    return (f"(CASE WHEN length({x}) < 3 OR length({y}) < 3 THEN {x} = {y} "
            f"ELSE {x} = {y} OR contains({x}, {y}) OR contains({y}, {x}) END)")


TREND_CTE = f"""
tm AS ({analysis_sql("p_type", ["posted_year"])}),
tr AS (SELECT skill, CAST(posted_year AS INTEGER) AS posted_year FROM tm WHERE posted_year IS NOT NULL),
ta0 AS (SELECT posted_year, skill, count(*) AS mentions FROM tr GROUP BY posted_year, skill),
ta AS (SELECT *, mentions / sum(mentions) OVER (PARTITION BY posted_year) AS share FROM ta0),
tyb AS (SELECT min(posted_year) AS fy, max(posted_year) AS ly FROM ta),
tnr AS (SELECT count(DISTINCT posted_year) AS n FROM ta WHERE posted_year >= (SELECT ly FROM tyb) - 2),
ttot AS (SELECT count(*) AS n FROM tr WHERE skill IS NOT NULL),
ts AS (SELECT skill,
              sum(CASE WHEN posted_year >= (SELECT ly FROM tyb) - 2 THEN share END) AS recent_sum,
              coalesce(max(CASE WHEN posted_year = (SELECT ly FROM tyb) THEN share END), 0.0) AS share_last,
              coalesce(max(CASE WHEN posted_year = (SELECT fy FROM tyb) THEN share END), 0.0) AS share_first,
              sum(mentions) AS mentions
       FROM ta WHERE skill IS NOT NULL GROUP BY skill),
tsc AS (SELECT skill, coalesce(recent_sum, 0.0) / (SELECT n FROM tnr) AS recent_share,
               share_last - share_first AS share_change, mentions / (SELECT n FROM ttot) AS overall_share FROM ts),
trk AS (SELECT skill, row_number() OVER (ORDER BY recent_share * 0.55 + greatest(share_change, 0.0) * 0.30
                                          + overall_share * 0.15 DESC, skill) AS rank FROM tsc),
tl AS (SELECT list(skill ORDER BY rank) AS trending FROM trk WHERE rank <= 20)"""

GAP_CTE = f"""
{TREND_CTE},
pr AS ({PROFILES_SQL}),
p0 AS (SELECT user_id, skills_text, {_strip('skills_text')} AS raw FROM pr),
p1 AS (SELECT *, list_filter(list_transform(string_split(raw, ','), lambda x: {_strip('x')}), lambda x: x <> '') AS tokens
       FROM p0),
p2 AS (SELECT *, list_transform(list_filter(tokens, lambda t: {_valid('t')}), lambda t: {_canon('t')}) AS canon FROM p1),
p3 AS (SELECT *, list_filter(canon, lambda x, i: list_position(canon, x) = i) AS cleaned FROM p2),
p4 AS (SELECT *, CASE WHEN skills_text IS NULL THEN '{gap.MSG_EMPTY}'
                      WHEN raw = '' OR lower(raw) IN ({_q(gap.TRIVIAL_INPUTS)}) OR len(tokens) = 0 THEN '{gap.MSG_TRIVIAL}'
                      WHEN len(cleaned) = 0 THEN '{gap.MSG_NONE_VALID}' END AS message FROM p3),
p5 AS (SELECT user_id, skills_text, message, message IS NULL AS valid,
              CASE WHEN message IS NULL THEN cleaned END AS user_skills,
              CASE WHEN message IS NULL THEN list_transform((SELECT trending FROM tl), lambda t: {_canon('t')}) END
                AS trending_skills FROM p4),
p6 AS (SELECT *, list_filter(user_skills, lambda u: len(list_filter(trending_skills, lambda t: {_match('u', 't')})) > 0)
                AS matched_skills FROM p5),
p7 AS (SELECT *, list_filter(trending_skills, lambda t: NOT list_contains(list_transform(matched_skills, lambda m: lower(m)),
                                                                          lower(t))) AS missing_skills FROM p6),
g AS (SELECT *, list_slice(missing_skills, 1, {gap.PRIORITY_N}) AS priority_skills FROM p7)"""


def _counted(spark, sf_dir):
    """(job_id, customer_id, posted_year, skill, k): the line items with their
    joins, read and written once; trends, profiles and baskets come from it."""
    rows = mentions(spark, sf_dir, "p_type", ["posted_year", "customer_id"])
    return checkpointed(rows.groupBy("job_id", "customer_id", "posted_year", "skill").agg(F.count(F.lit(1)).alias("k")))


def _gap(spark, sf_dir, counted=None):
    counted = _counted(spark, sf_dir) if counted is None else counted
    trending = gap.trending_list(counted, weight="k")
    return gap.skill_gap(gap.parse_profiles(profiles(spark, sf_dir, counted)), trending)


def _strings(df):
    cols = ["user_skills", "trending_skills", "matched_skills", "missing_skills", "priority_skills"]
    return df.select("user_id", "skills_text", "valid", "message",
                     *[F.array_join(c, ", ").alias(c) for c in cols])


@query("skill_gap", "G1 G2 G3 G4 G5 G6 J8 J10 A16", f"""
WITH {GAP_CTE}
SELECT user_id, skills_text, valid, message,
       array_to_string(user_skills, ', ') AS user_skills, array_to_string(trending_skills, ', ') AS trending_skills,
       array_to_string(matched_skills, ', ') AS matched_skills, array_to_string(missing_skills, ', ') AS missing_skills,
       array_to_string(priority_skills, ', ') AS priority_skills FROM g""")
def q_skill_gap(spark, sf_dir):
    return _strings(_gap(spark, sf_dir))


def _rules(counted):
    return basket.select_rules(basket.association_rules(basket.mined_itemsets(counted, weight="k")))


def _insight(spark, sf_dir):
    counted = _counted(spark, sf_dir)
    return gap.rule_insight(_gap(spark, sf_dir, counted), _rules(counted))


INSIGHT_CTE = f"""
{RULES_SQL.replace("WITH ", "", 1)},
{GAP_CTE},
us AS (SELECT user_id, lower({_strip('unnest(user_skills)')}) AS ante_key FROM g),
h AS (SELECT us.user_id, sel.antecedents, sel.consequents, sel.confidence,
             row_number() OVER (PARTITION BY us.user_id ORDER BY sel.lift DESC, sel.antecedents, sel.consequents) AS k
      FROM us JOIN sel ON lower({_strip('sel.antecedents')}) = us.ante_key),
ins AS (SELECT user_id, 'Association insight: Jobs requiring ' || antecedents || ' also require ' || consequents
               || ' with ' || printf('%.0f', confidence * 100) || '% confidence.' AS insight FROM h WHERE k = 1),
gi AS (SELECT g.*, ins.insight FROM g LEFT JOIN ins USING (user_id))"""


@query("gap_rule_insight", "G7", f"""
WITH {INSIGHT_CTE}
SELECT user_id, insight FROM gi""")
def q_gap_rule_insight(spark, sf_dir):
    return _insight(spark, sf_dir).select("user_id", "insight")


def _j(x):
    return f"array_to_string({x}, ', ')"


_NO_OVERLAP_PRE, _NO_OVERLAP_POST = gap.ADVICE_NO_OVERLAP.split("{start}")
_GAPS_PRE, _rest = gap.ADVICE_GAPS.split("{have}")
_GAPS_MID, _GAPS_TAIL = _rest.split("{gaps}")


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ADVICE_SQL = f"""CASE
  WHEN len(user_skills) = 0 THEN {_lit(gap.ADVICE_NO_SKILLS)}
  WHEN len(matched_skills) = 0 THEN {_lit(_NO_OVERLAP_PRE)} ||
       CASE WHEN len(priority_skills) > 0 THEN {_j('list_slice(priority_skills, 1, 3)')}
            ELSE {_j('list_slice(trending_skills, 1, 3)')} END || {_lit(_NO_OVERLAP_POST)}
  WHEN len(list_slice(priority_skills, 1, 4)) = 0 THEN {_lit(gap.ADVICE_COVERED)}
  ELSE {_lit(_GAPS_PRE)} || {_j('list_slice(matched_skills, 1, 3)')} || {_lit(_GAPS_MID)}
       || {_j('list_slice(priority_skills, 1, 4)')} || {_lit(_GAPS_TAIL)} END"""

_PL = gap.PROMPT_LONG.replace("{user}", "\x00").replace("{trending}", "\x00").replace("{priority}", "\x00").split("\x00")
_PC = gap.PROMPT_CONCISE.replace("{user}", "\x00").replace("{trending}", "\x00").split("\x00")


@query("gap_advice", "G8 G9 G10", f"""
WITH {INSIGHT_CTE},
ad AS (SELECT *, {ADVICE_SQL} AS adv FROM gi)
SELECT user_id, valid,
       CASE WHEN valid THEN (CASE WHEN insight IS NOT NULL THEN adv || chr(10) || chr(10) || insight ELSE adv END)
            ELSE message END AS advice,
       insight,
       CASE WHEN valid THEN {_lit(_PL[0])} || {_j('user_skills')} || {_lit(_PL[1])} || {_j('trending_skills')}
            || {_lit(_PL[2])} || CASE WHEN len(priority_skills) > 0 THEN {_j('priority_skills')}
                                    ELSE {_lit(gap.PRIORITY_FALLBACK)} END || {_lit(_PL[3])} END AS prompt_long,
       CASE WHEN valid THEN {_lit(_PC[0])} || {_j('user_skills')} || {_lit(_PC[1])} || {_j('trending_skills')}
            || {_lit(_PC[2])} END AS prompt_concise
FROM ad""")
def q_gap_advice(spark, sf_dir):
    return gap.preview(_insight(spark, sf_dir))
