"""Taxonomy extraction cases (the reference's extraction ticket)."""

from pyspark.sql import functions as F

from demandlens.operators import extract


def _found(spark, texts, word=True):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return [r.skills_found for r in extract.apply_extraction(df, "text", word=word).collect()]


def test_word_boundary_case_and_dedup(spark):
    got = _found(spark, ["Roots and rivers are no letters",
                         "python, PYTHON and once more Python!",
                         None, "", "Charts: power bi; queries: sql; plots: r", "Ré and Résumé", "CI/CD with Git"])
    assert got[0] == []
    assert got[1] == ["Python"]
    assert got[2] == [] and got[3] == []
    assert sorted(got[4]) == ["Power BI", "R", "SQL"]
    assert got[5] == []  # "R" next to an accented letter is not a word of its own
    assert sorted(got[6]) == ["CI/CD", "Git"]


def test_substring_variant(spark):
    assert _found(spark, ["Boar"], word=False)[0] == ["R"]


def test_category_unknown_default(spark):
    df = spark.createDataFrame([("Python",), ("Cobol",)], "skill string")
    got = {r.skill: r.category for r in extract.attach_category(df, extract.taxonomy_frame(spark)).collect()}
    assert got == {"Python": "Languages", "Cobol": "Unknown"}


def test_explode_drops_empty_and_flatten(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id long, skills_found array<string>")
    assert extract.explode_skills(df).count() == 2
    nested = spark.createDataFrame([([["a"], ["b", "c"]],)], "x array<array<string>>")
    assert nested.select(extract.flatten_nested(F.col("x")).alias("f")).first().f == ["a", "b", "c"]


def test_taxonomy_flatten_longest_first():
    flat = extract.flatten_taxonomy()
    assert len(flat) == 50 and flat[0][1] == "Hypothesis Testing" and flat[-1][1] == "R"
