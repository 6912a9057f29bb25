"""Frequency, co-occurrence and cross-tab cases (the reference's analysis tickets)."""

import pytest

from demandlens.operators import cooccur, crosstab, frequency, trends

BASKETS = [["oak", "elm", "ash"], ["oak", "fir"], ["elm", "oak", "yew"], ["elm", "oak"], ["fir", "yew"]]


def _long(spark, baskets):
    rows = [(i, s) for i, b in enumerate(baskets) for s in b]
    return spark.createDataFrame(rows, "job_id long, skill string")


def test_pair_counts_symmetric_zero_diagonal(spark):
    df = _long(spark, BASKETS)
    pairs = {(r.skill_a, r.skill_b): r.co_occurrence for r in cooccur.cooccurrence_pairs(df, 11).collect()}
    assert pairs[("elm", "oak")] == 3
    m = {(r.skill_a, r.skill_b): r.n for r in cooccur.cooccurrence_matrix(df, 3).collect()}
    assert len(m) == 9  # top_n = 3 -> 3 x 3
    for (a, b), n in m.items():
        assert m[(b, a)] == n
        if a == b:
            assert n == 0
    cards = cooccur.matrix_cards(*cooccur.matrix_and_pairs(df, 11)).first()
    assert cards.enough_pairs and not cooccur.matrix_cards(*cooccur.matrix_and_pairs(df, 2)).first().enough_pairs
    top = cooccur.top_pairs(cooccur.cooccurrence_pairs(df, 11), 2).collect()
    assert [(r["rank"], r.skill_pair, r.co_occurrence) for r in top] == [(1, "elm + oak", 3), (2, "ash + elm", 1)]
    assert cards.symmetric and cards.top_pair == "elm + oak" and cards.top_pair_count == 3


def test_explode_count(spark):
    df = _long(spark, [["a", "b"], ["c", "d", "e"]])
    assert df.count() == 5


def test_top_skills_ties_by_name(spark):
    df = _long(spark, [["b", "a"], ["c"]])
    top = frequency.top_skills(df, n=2).collect()
    assert [r.skill for r in top] == ["a", "b"]
    assert abs(sum(r.share_pct for r in frequency.top_skills(df, n=None).collect()) - 100) < 1e-9


def test_category_counts_keep_null_group(spark):
    df = spark.createDataFrame([("x", "ml"), ("y", None), ("z", None)], "skill string, skill_category string")
    got = {r.skill_category: r.mentions for r in frequency.category_counts(df).collect()}
    assert got == {"ml": 1, None: 2}


def test_crosstab_rows_sum_to_100_and_codes_mapped(spark):
    levels = ["EX", "SE", "SE", "EN", "MI", "EN", "EX", "EN", "MI"]
    skills = ["oak", "elm", "oak", "oak", "fir", "elm", "yew", "yew", "elm"]
    df = spark.createDataFrame(list(zip(range(9), skills, levels)), "job_id long, skill string, experience_level string")
    ct = crosstab.experience_crosstab(df, top_n=11)
    sums = {r.experience_level: r.pct_total for r in crosstab.crosstab_row_check(ct).collect()}
    assert set(sums) == {"Entry-Level", "Mid-Level", "Senior", "Executive"}
    assert all(abs(v - 100) <= 0.1 for v in sums.values())
    # zero fill: every level has every top skill
    assert ct.count() == 4 * 4
    champ = {r.experience_level: r.skill for r in crosstab.level_champions(ct).collect()}
    assert champ["Entry-Level"] == "elm"  # ties (elm, oak, yew) broken by name


def test_ordered_crosstab_orders_by_all_levels(spark):
    rows = [("entry", "a"), ("entry", "a"), ("entry", "b")] + [("not specified", "b")] * 5
    df = spark.createDataFrame([(i, s, lv) for i, (lv, s) in enumerate(rows)], "job_id long, skill string, experience_level string")
    out = crosstab.ordered_crosstab(crosstab.experience_crosstab(df)).collect()
    assert {r.experience_level for r in out} == {"entry"}
    assert sorted((r.skill_order, r.skill) for r in out) == [(1, "b"), (2, "a")]


def test_ordered_crosstab_keeps_labels_of_codes(spark):
    df = spark.createDataFrame([(i, "a", c) for i, c in enumerate(["EN", "MI", "SE", "EX"])],
                               "job_id long, skill string, experience_level string")
    out = crosstab.ordered_crosstab(crosstab.experience_crosstab(df))
    assert {r.experience_level: r.level_order for r in out.collect()} == {"Entry-Level": 1, "Mid-Level": 2, "Senior": 3}


def test_trending_coerces_years(spark):
    df = spark.createDataFrame([("2020", "a"), ("2021.0", "b"), ("Not Specified", "c")], "posted_year string, skill string")
    assert {r.skill for r in trends.trending_score(df).collect()} == {"a", "b"}


def test_annual_share_sums_to_one(spark):
    df = spark.createDataFrame([(2020, "a"), (2020, "b"), (2020, "a"), (2021, "b"), (None, "a")],
                               "posted_year int, skill string")
    a = trends.annual_share(df).collect()
    by_year = {}
    for r in a:
        by_year[r.posted_year] = by_year.get(r.posted_year, 0) + r.share
    assert set(by_year) == {2020, 2021}
    assert all(abs(v - 1) < 1e-12 for v in by_year.values())


def test_trending_score_zero_fill(spark):
    # b is missing in 2021: its share there counts as 0 in the recent mean
    df = spark.createDataFrame([(2020, "a"), (2020, "b"), (2021, "a")], "posted_year int, skill string")
    got = {r.skill: r for r in trends.trending_score(df).collect()}
    assert got["a"].recent_share == pytest.approx((0.5 + 1.0) / 2)
    assert got["b"].recent_share == pytest.approx(0.5 / 2)
    assert got["a"].rank == 1


def test_trending_falls_back_to_frequency_without_years(spark):
    df = spark.createDataFrame([(None, "b"), (None, "a"), (None, "b")], "posted_year int, skill string")
    got = [(r.skill, r.rank, r.score) for r in trends.trending_score(df).orderBy("rank").collect()]
    assert got == [("b", 1, None), ("a", 2, None)]


def test_trending_list_fallback_on_empty_input(spark):
    from demandlens.operators import gap
    df = spark.createDataFrame([], "posted_year int, skill string")
    lst = spark.range(1).select(gap.trending_list(df, 3).alias("t")).first().t
    assert lst == ["aws", "gcp", "tensorflow"]
