"""Baskets, itemsets and rule metrics, with the metrics held against exact fractions."""

import itertools
from fractions import Fraction

import pytest

from demandlens.operators import basket

# Baskets, and baskets with each item and each pair of items.
N_BASKETS = 50_000
ITEMS = {
    "AWS": 20638, "Azure": 20517, "Computer Vision": 20313, "GCP": 20552, "NLP": 20414, "PyTorch": 20185,
    "Python": 20396, "R": 20205, "SQL": 20322, "Scikit-learn": 20511, "TensorFlow": 20552,
}
PAIRS = [
    ("PyTorch", "TensorFlow", 7773), ("NLP", "AWS", 7875), ("AWS", "NLP", 7875), ("Azure", "Scikit-learn", 7861),
    ("Scikit-learn", "Azure", 7861), ("Computer Vision", "AWS", 7812), ("TensorFlow", "Scikit-learn", 7853),
    ("Scikit-learn", "TensorFlow", 7853), ("TensorFlow", "NLP", 7813), ("NLP", "TensorFlow", 7813), ("AWS", "GCP", 7892),
    ("GCP", "AWS", 7892), ("SQL", "Azure", 7754), ("NLP", "Scikit-learn", 7778), ("AWS", "Scikit-learn", 7857),
    ("Scikit-learn", "AWS", 7857), ("Python", "GCP", 7780), ("R", "TensorFlow", 7698), ("TensorFlow", "AWS", 7862),
    ("AWS", "TensorFlow", 7862), ("R", "Scikit-learn", 7679), ("Azure", "AWS", 7831), ("R", "AWS", 7699),
]


def _exact(a: Fraction, c: Fraction, s: Fraction) -> dict:
    """The metrics from their definitions, in fractions."""
    conf, lev = s / a, s - a * c
    return {
        "confidence": conf, "lift": conf / c, "representativity": 1, "leverage": lev,
        "conviction": (1 - c) / (1 - conf), "zhangs_metric": lev / max(s * (1 - a), a * (c - s)),
        "jaccard": s / (a + c - s), "certainty": (conf - c) / (1 - c), "kulczynski": (s / a + s / c) / 2,
    }


def test_metrics_of_counted_rules(spark):
    sides = [(Fraction(ITEMS[a], N_BASKETS), Fraction(ITEMS[c], N_BASKETS), Fraction(s, N_BASKETS)) for a, c, s in PAIRS]
    df = spark.createDataFrame([tuple(map(float, x)) for x in sides],
                               "antecedent_support double, consequent_support double, support double")
    got = basket.rule_metrics(df).collect()
    assert len(got) == 23
    for row, x in zip(got, sides, strict=True):
        for name, value in _exact(*x).items():
            assert row[name] == pytest.approx(float(value), rel=1e-12, abs=1e-15), name


def test_rules_of_many_items_are_split_over_a_range(spark):
    """Nine items that always come together: 2^9 - 2 rules from the largest itemset alone."""
    its = basket.frequent_itemsets(basket.baskets(_long(spark, [list("abcdefghi")] * 3)), 0.5, None)
    assert its.count() == 2**9 - 1
    rules = basket.association_rules(its)
    assert rules.where("size(antecedent_items) + size(consequent_items) = 9").count() == 2**9 - 2
    assert rules.where("size(consequent_items) > 1").count() > 0


def test_mining_retries_with_fewer_items_then_fails(spark):
    rows = [["a", "b"]] * 2 + [[f"i{k}", f"j{k}"] for k in range(100)]
    with pytest.raises(RuntimeError):
        basket.mined_itemsets(_long(spark, rows), top_n=300, retry_top_n=200)
    assert basket.mined_itemsets(_long(spark, rows), top_n=300, retry_top_n=2).count() == 3


def _long(spark, baskets):
    return spark.createDataFrame([(i, s) for i, b in enumerate(baskets) for s in b], "job_id long, skill string")


def test_basket_length_counts_repeats(spark):
    b = basket.baskets(_long(spark, [["SQL", "SQL"], ["SQL"]])).collect()
    assert len(b) == 1 and b[0].n_items == 2 and b[0].items == ["SQL"]


def _brute_itemsets(baskets, min_support):
    n = len(baskets)
    counts = {}
    for b in baskets:
        items = sorted(set(b))
        for k in range(1, len(items) + 1):
            for combo in itertools.combinations(items, k):
                counts[combo] = counts.get(combo, 0) + 1
    return {c: f for c, f in counts.items() if f / n >= min_support}


def test_itemsets_and_rules_match_brute_force(spark):
    baskets = [["a", "b", "c"], ["a", "b"], ["a", "c"], ["b", "c"], ["a", "b", "c", "d"], ["d", "a"]]
    bask = basket.baskets(_long(spark, baskets))
    its = basket.frequent_itemsets(bask, min_support=0.3, fallback_support=None)
    got = {tuple(r["items"]): r["freq"] for r in its.collect()}
    assert got == _brute_itemsets(baskets, 0.3)
    rules = basket.association_rules(its).collect()
    n = len(baskets)
    expected = 0
    for items, f in got.items():
        if len(items) < 2:
            continue
        for k in range(1, len(items)):
            for ante in itertools.combinations(items, k):
                expected += 1
    assert len(rules) == expected
    for r in rules:
        full = tuple(sorted(r.antecedent_items + r.consequent_items))
        assert r.support == pytest.approx(got[full] / n)
        assert r.confidence == pytest.approx(got[full] / got[tuple(r.antecedent_items)])


def test_support_fallback_only_when_no_itemset(spark):
    baskets = [["a", "b"]] * 2 + [["c", "d"]] * 48  # a: 0.04, c: 0.96 -> something frequent at 0.05
    its = basket.frequent_itemsets(basket.baskets(_long(spark, baskets)))
    assert {tuple(r["items"]) for r in its.collect()} == {("c",), ("d",), ("c", "d")}


def test_tier_two_used_only_without_tier_one(spark):
    df = spark.createDataFrame([("a", "b", 1.3, 0.6), ("c", "d", 0.95, 0.4)],
                               "antecedents string, consequents string, lift double, confidence double")
    assert [r.tier for r in basket.select_rules(df).collect()] == [1]
    only2 = df.filter("lift < 1")
    assert [(r.antecedents, r.tier) for r in basket.select_rules(only2).collect()] == [("c", 2)]
    assert basket.select_rules(df.filter("lift < 0.5")).count() == 0
