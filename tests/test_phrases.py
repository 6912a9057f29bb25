"""Extraction through the phrase index against the regular expressions."""

import random

import pytest
from pyspark.sql import functions as F

from demandlens.operators import extract, keyset, phrases

TAXONOMY = ["Python", "SQL", "R", "C", "C++", "C#", ".NET", "Machine Learning", "machine  learning", "CI/CD", "A/B Testing", "scikit-learn",
            "All rights reserved.", "ÉTÉ", "straße", "ΟΔΟΣ", "µ-law", "Kelvin", "İstanbul", "++", "日本", "a b c d", "x_y", "(R)", "-", "9", "the", "the the"]


def by_regex(spark, rows, taxonomy):
    df = spark.createDataFrame(rows, "id long, text string")
    hits = [F.when(F.col("text").rlike(extract.phrase_pattern(t)), F.lit(t)) for t in taxonomy]
    found = df.select("id", F.explode(F.array_compact(F.array(*hits))).alias("skill")).distinct()
    return sorted(map(tuple, found.collect()))


def by_index(spark, rows, taxonomy):
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    return sorted(map(tuple, phrases.match_phrases(df, "text", spark.createDataFrame([(t,) for t in taxonomy], "skill string"), "id").collect()))


def _texts(n, seed):
    rnd = random.Random(seed)
    parts = [*TAXONOMY, "python", "sql", "r", "c", "NET", "asp.net", " .net", "c++", "Regression", "été", "STRASSE", "οδος", "οδοσ", "μ-LAW", "Kelvin",
             "istanbul", "machine\nlearning", "ci / cd", "++", ",", "", "rights reserved", "ſql", "x_y_z", "A", "b", "c", "d", "the"]
    return [(k, "".join(rnd.choice(parts) + rnd.choice([" ", "", ", ", "\n", ".", "  ", "-", "_", "/"]) for _ in range(rnd.randrange(0, 14)))) for k in range(n)]


@pytest.fixture(params=["filed", "all grams"])
def form(request, monkeypatch):
    """Both ways: around broadcast filing words, and without a broadcast."""
    if request.param == "all grams":
        monkeypatch.setattr(phrases, "FILED", 0)


def test_equals_the_regular_expressions(spark, form):
    rows = _texts(400, 1) + [(1000, None), (1001, ""), (1002, "R"), (1003, "C++"), (1004, "C+++"), (1005, "C++ "), (1006, ".NET"), (1007, "..NET"),
                             (1008, "A.NET"), (1009, " \n"), (1010, "(R)"), (1010, "sql")]
    expected = by_regex(spark, rows, TAXONOMY)
    assert len({s for _, s in expected}) > 20
    assert by_index(spark, rows, TAXONOMY) == expected


@pytest.mark.parametrize("chunk,piece", [(1, 1), (2, 9), (16, 5), (50, 16)])
def test_chunks_lose_and_add_nothing(spark, form, monkeypatch, chunk, piece):
    rows = _texts(60, chunk)
    expected = by_index(spark, rows, TAXONOMY)
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    monkeypatch.setattr(phrases, "PIECE", piece)
    assert by_index(spark, rows, TAXONOMY) == expected


def test_long_text_and_hot_phrase(spark, form):
    text = "the quick brown fox " * 40_000 + "C++"
    assert by_index(spark, [(1, text), (2, "quick")], ["quick", "C++", "C", "brown fox", "fox the", "lazy"]) == [
        (1, "C"), (1, "C++"), (1, "brown fox"), (1, "fox the"), (1, "quick"), (2, "quick")]


def test_empty_inputs_and_attached_lists(spark):
    rows = [(1, "python and SQL"), (2, None), (3, "nothing")]
    df = spark.createDataFrame(rows, "id long, text string")
    none = spark.createDataFrame([], "skill string")
    assert phrases.match_phrases(df, "text", none, "id").collect() == []
    assert phrases.match_phrases(df.limit(0), "text", spark.createDataFrame([("a",)], "skill string"), "id").collect() == []
    tax = spark.createDataFrame([("Python",), ("SQL",), (None,), ("Python",)], "skill string")
    got = phrases.attach_found(df, phrases.match_phrases(df, "text", tax, "id"), "id").collect()
    assert {r.id: r.skills_found for r in got} == {1: ["Python", "SQL"], 2: [], 3: []}


def test_no_pairs_of_texts_and_phrases(spark):
    df = spark.createDataFrame([(1, "python")], "id long, text string")
    tax = spark.createDataFrame([(f"skill {k}",) for k in range(3000)], "skill string")
    plan = phrases.match_phrases(df, "text", tax, "id")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_folded_search_equals_the_regular_expressions(spark):
    rows = _texts(500, 9)
    df = spark.createDataFrame(rows, "id long, text string")
    for word in (True, False):
        hits = [F.when(F.col("text").rlike(extract.phrase_pattern(t, word)), F.lit(t)) for t in TAXONOMY]
        both = df.select(F.array_compact(F.array(*hits)).alias("a"), extract.extract_skills(F.col("text"), TAXONOMY, word).alias("b"))
        assert both.where("a != b").collect() == [] and both.where("size(a) > 2").count() > 100


def test_only_hits_leave_the_scan(spark, form):
    """Stretches that are no phrase don't reach the join, whatever the phrases' number."""
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(50)) + " quick brown fox jumps over") for k in range(40)]
    df = spark.createDataFrame(rows, "id long, text string")
    tax = spark.createDataFrame([(f"skill {k} of many others",) for k in range(2000)] + [("brown fox",), ("quick brown fox jumps",)], "skill string")
    seen = []
    plain = phrases._grams

    def watched(*args):
        grams = plain(*args)
        seen.append(grams.count())
        return grams

    phrases._grams = watched
    try:
        assert len(phrases.match_phrases(df, "text", tax, "id").collect()) == 80
    finally:
        phrases._grams = plain
    assert 80 <= seen[0] <= 400  # of some 6,500


def test_filter_is_no_value_of_the_plan(spark, form):
    """The filter reaches the tasks as a broadcast table, not as a value that every stage's
    code holds several times, on the driver too."""
    df = spark.createDataFrame([(1, "python and sql x1 y")], "id long, text string")
    tax = spark.createDataFrame([(f"x{k} y",) for k in range(3000)], "skill string")
    found = phrases.match_phrases(df, "text", tax, "id")
    plan = found._jdf.queryExecution().toString().lower()
    assert "scalar-subquery" not in plan and "subquery#" not in plan and "__strip" in plan
    assert [tuple(r) for r in found.collect()] == [(1, "x1 y")]


@pytest.mark.parametrize("bits", [1 << 10, 1 << 14, 1 << 20])
def test_strips_let_all_keys_pass(spark, bits):
    keys = spark.range(0, 1000).selectExpr("id * 7 as h")
    rows = spark.range(0, 20000).selectExpr("id as h", "id % 3 as other")
    got = {r.h for r in keyset.passing(rows, "h", keyset.strips_of(keys, "h", bits), bits).collect()}
    assert {k * 7 for k in range(1000)} <= got
    assert bits < 1 << 14 or len(got) < 1000 + 0.05 * 20000
    assert keyset.passing(rows, "h", keyset.strips_of(keys.limit(0), "h", bits), bits).count() == 0
