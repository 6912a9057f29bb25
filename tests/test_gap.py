"""Skill-gap advisor cases (the reference's advisor smoke inputs)."""

import pytest
from pyspark.sql import functions as F

from demandlens.operators import gap


def _parse(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "user_id long, skills_text string")
    return {r.user_id: r for r in gap.parse_profiles(df).collect()}


def test_valid_inputs_canonical_names(spark):
    got = _parse(spark, ["SQL, Azure ,PANDAS", "cuda,Excel", "GCP, Looms, llm",
                         "scikit learn, Sklearn,  Power   BI", "Docker, docker"])
    assert got[0].user_skills == ["sql", "azure", "pandas"]
    assert got[1].user_skills == ["cuda", "excel"]
    assert got[2].user_skills == ["gcp", "Looms", "llm"]
    assert got[3].user_skills == ["scikit-learn", "power bi"]
    assert got[4].user_skills == ["Docker", "docker"]  # unknown names keep their case


@pytest.mark.parametrize("text,message", [("", gap.MSG_TRIVIAL), ("None", gap.MSG_TRIVIAL),
                                          ("x", gap.MSG_NONE_VALID), (None, gap.MSG_EMPTY),
                                          (" , , ", gap.MSG_TRIVIAL), ("123, 456", gap.MSG_NONE_VALID)])
def test_invalid_inputs(spark, text, message):
    r = _parse(spark, [text])[0]
    assert not r.valid and r.message == message and r.user_skills is None


def test_long_phrase_needs_keyword(spark):
    r = _parse(spark, ["I like to do many things every day, building data pipelines at work every day"])[0]
    assert r.user_skills == ["building data pipelines at work every day"]


def test_partial_match_keeps_trending_missing(spark):
    df = spark.createDataFrame([(1, "tensor, SQL")], "user_id long, skills_text string")
    trending = F.array(F.lit("tensorflow"), F.lit("sql"), F.lit("aws"), F.lit("r"))
    r = gap.skill_gap(gap.parse_profiles(df), trending).first()
    assert r.matched_skills == ["tensor", "sql"]
    assert r.missing_skills == ["tensorflow", "aws", "r"]
    assert r.priority_skills == ["tensorflow", "aws", "r"]


def test_missing_keeps_repeats_of_the_list(spark):
    df = spark.createDataFrame([(1, "sql")], "user_id long, skills_text string")
    trending = F.array(*[F.lit(x) for x in ("scikit-learn", "sql", "scikit-learn", "aws")])
    assert gap.skill_gap(gap.parse_profiles(df), trending).first().missing_skills == ["scikit-learn", "scikit-learn", "aws"]


@pytest.mark.parametrize("confidence,pct", [(0.385, "38"), (0.125, "12"), (0.386, "39")])
def test_insight_rounds_halves_to_even(spark, confidence, pct):
    df = spark.createDataFrame([(1, "NLP")], "user_id long, skills_text string")
    g = gap.skill_gap(gap.parse_profiles(df), F.array(F.lit("aws")))
    rules = spark.createDataFrame([("NLP", "AWS", confidence, 1.0)], "antecedents string, consequents string, confidence double, lift double")
    assert f"with {pct}% confidence" in gap.rule_insight(g, rules).first().insight


def test_advice_cases(spark):
    df = spark.createDataFrame([(1, "Excel"), (2, "sql, aws")], "user_id long, skills_text string")
    trending = F.array(F.lit("sql"), F.lit("aws"))
    g = gap.skill_gap(gap.parse_profiles(df), trending).withColumn("insight", F.lit(None).cast("string"))
    adv = {r.user_id: r.advice for r in gap.preview(g).collect()}
    assert adv[1].startswith("Your profile does not overlap") and "Start with sql, aws," in adv[1]
    assert adv[2] == gap.ADVICE_COVERED


def test_rule_insight_highest_lift(spark):
    df = spark.createDataFrame([(1, "PyTorch, NLP")], "user_id long, skills_text string")
    g = gap.skill_gap(gap.parse_profiles(df), F.array(F.lit("aws")))
    rules = spark.createDataFrame([("PyTorch", "TensorFlow", 0.385, 0.93), ("NLP", "AWS", 0.3857, 0.94)],
                                  "antecedents string, consequents string, confidence double, lift double")
    r = gap.rule_insight(g, rules).first()
    assert r.insight == "Association insight: Jobs requiring NLP also require AWS with 39% confidence."


def test_profiles_are_cut_once(spark):
    """Texts are split once a row, and no pattern runs on tokens for each trending name."""
    df = spark.createDataFrame([(1, " SQL , sql,\tmachine  learning\n, n/a"), (2, None), (3, " R  , a b \u0085")], "user_id long, skills_text string")
    parsed = gap.parse_profiles(df)
    trending = spark.range(1).select(F.array(F.lit("sql"), F.lit("machine learning"), F.lit("excel")).alias("t")).agg(F.first("t")).scalar()
    out = gap.skill_gap(parsed, trending)
    rows = {r.user_id: r for r in out.collect()}
    assert rows[1].matched_skills == rows[1].user_skills and rows[1].missing_skills == ["excel"] and rows[2].missing_skills is None
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(_raw") == 1 and plan.count("xists(") == 1
