"""Property tests: operators against brute-force Python on generated data,
including a hot job and a hot skill that hold a large share of all rows."""

import itertools
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from demandlens.operators import basket, cleaning, cooccur, frequency, trends

SKILLS = list("abcdefgh")

rows_strategy = st.lists(
    st.tuples(st.integers(0, 12), st.sampled_from(SKILLS), st.sampled_from([2020, 2021, 2022])),
    min_size=1, max_size=60,
).map(lambda rows: rows + [(0, "a", 2021)] * (len(rows) // 2))  # job 0 / skill a: a third of the rows

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def _df(spark, rows):
    return spark.createDataFrame(rows, "job_id long, skill string, posted_year int")


def _top(rows, n):
    c = Counter(s for _, s, _ in rows)
    return [s for s, _ in sorted(c.items(), key=lambda kv: (-kv[1], kv[0]))[:n]]


@SETTINGS
@given(rows=rows_strategy, top_n=st.integers(2, 6))
def test_cooccurrence_matches_brute_force(spark, rows, top_n):
    top = set(_top(rows, top_n))
    per_job = {}
    for j, s, _ in rows:
        if s in top:
            per_job.setdefault(j, set()).add(s)
    expected = Counter()
    for items in per_job.values():
        for a, b in itertools.combinations(sorted(items), 2):
            expected[(a, b)] += 1
    got = {(r.skill_a, r.skill_b): r.co_occurrence
           for r in cooccur.cooccurrence_pairs(_df(spark, rows), top_n).collect()}
    assert got == dict(expected)


@SETTINGS
@given(rows=rows_strategy)
def test_baskets_match_brute_force(spark, rows):
    lists = {}
    for j, s, _ in rows:
        lists.setdefault(j, []).append(s)
    expected = {j: (len(v), sorted(set(v))) for j, v in lists.items() if len(v) >= 2}
    got = {r.job_id: (r.n_items, r["items"]) for r in basket.baskets(_df(spark, rows)).collect()}
    assert got == expected


@SETTINGS
@given(rows=rows_strategy)
def test_annual_share_and_top_skills(spark, rows):
    df = _df(spark, rows)
    per_year = Counter(y for _, _, y in rows)
    cell = Counter((y, s) for _, s, y in rows)
    got = {(r.posted_year, r.skill): (r.mentions, r.share) for r in trends.annual_share(df).collect()}
    assert got == {k: (n, n / per_year[k[0]]) for k, n in cell.items()}
    assert [r.skill for r in frequency.top_skills(df, 3).collect()] == _top(rows, 3)


@SETTINGS
@given(rows=rows_strategy)
def test_first_by_key_is_lowest_ordinal(spark, rows):
    data = [(j, i, s) for i, (j, s, _) in enumerate(rows)]
    df = spark.createDataFrame(data, "job_id long, ordinal long, skill string")
    expected = {}
    for j, o, s in data:
        if j not in expected or o < expected[j][0]:
            expected[j] = (o, s)
    got = {r.job_id: (r.ordinal, r.skill) for r in cleaning.first_by_key(df, "job_id", "ordinal").collect()}
    assert got == expected
