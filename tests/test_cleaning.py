"""Cleaning and key-repair cases (the reference's cleaning tickets and code)."""

from pyspark.sql import functions as F

from demandlens.functions.text import coerce_int, digit_year, level_label, normalize_text
from demandlens.operators import cleaning


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_normalize_strips_tabs_and_newlines_and_keeps_null(spark):
    df = spark.createDataFrame([("  SQL\t",), ("\nPython ",), (None,)], "s string")
    assert [r[0] for r in df.select(normalize_text("s")).collect()] == ["sql", "python", None]


def test_coerce_int(spark):
    df = spark.createDataFrame([("2020",), ("2020.0",), ("1.5",), ("abc",), (None,)], "s string")
    assert [r[0] for r in df.select(coerce_int(F.col("s"))).collect()] == [2020, 2020, None, None, None]


def test_digit_year(spark):
    df = spark.createDataFrame([("2021",), ("Not Specified",), (" 2019 ",)], "s string")
    assert [r[0] for r in df.select(digit_year("s")).collect()] == [2021, None, 2019]


def test_level_codes_mapped_unmapped_kept(spark):
    df = spark.createDataFrame([("EN",), ("MI",), ("SE",), ("EX",), ("XX",)], "s string")
    out = [r[0] for r in df.select(level_label("s")).collect()]
    assert out == ["Entry-Level", "Mid-Level", "Senior", "Executive", "XX"]


def _jobs(spark, rows):
    return spark.createDataFrame(rows, "job_id string, ordinal long")


def _skills(spark, ids):
    return spark.createDataFrame([(i, "SQL", "Programming", "Basic") for i in ids],
                                 "job_id string, skill string, skill_category string, skill_level string")


def test_key_repair_prefix_match(spark):
    out = cleaning.repair_job_ids(_skills(spark, ["EABCDEFGHIJK"]), _jobs(spark, [("ABCDEFGHIJKL", 1)]))
    assert _rows(out, "job_id_normalized", "job_match_method") == [("ABCDEFGHIJKL", "prefix11")]


def test_key_repair_exact_and_unmatched(spark):
    jobs = _jobs(spark, [("ABCDEFGHIJKL", 1)])
    out = cleaning.repair_job_ids(_skills(spark, ["ABCDEFGHIJKL", "ZZZ"]), jobs)
    assert _rows(out, "job_id", "job_id_normalized", "job_match_method") == [
        ("ABCDEFGHIJKL", "ABCDEFGHIJKL", "exact"), ("ZZZ", "ZZZ", "unmatched")]


def test_key_repair_prefix_beats_exact(spark):
    # the skill id is itself a job id starting with 'E', and its tail hits a prefix
    jobs = _jobs(spark, [("EABCDEFGHIJK", 1), ("ABCDEFGHIJKQ", 2)])
    out = cleaning.repair_job_ids(_skills(spark, ["EABCDEFGHIJK"]), jobs)
    assert _rows(out, "job_id_normalized", "job_match_method") == [("ABCDEFGHIJKQ", "prefix11")]


def test_key_repair_prefix_collision_last_row_wins(spark):
    jobs = _jobs(spark, [("ABCDEFGHIJK1", 1), ("ABCDEFGHIJK2", 2)])
    out = cleaning.repair_job_ids(_skills(spark, ["EABCDEFGHIJK"]), jobs)
    assert _rows(out, "job_id_normalized") == [("ABCDEFGHIJK2",)]


def test_first_by_key_keeps_lowest_ordinal(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z")], "k string, o long, v string")
    assert _rows(cleaning.first_by_key(df, "k", "o"), "k", "o", "v") == [("a", 1, "y"), ("b", 2, "z")]


def test_dedup_before_normalisation_keeps_case_variants(spark):
    jobs = spark.createDataFrame([("J1", 1, "Senior", "2021")],
                                 "job_id string, ordinal long, experience_level string, posted_year string")
    skills = spark.createDataFrame([("J1", "SQL", "Programming", "Basic"), ("J1", "sql ", "Programming", "Basic"),
                                    ("J1", "SQL", "Programming", "Basic")],
                                   "job_id string, skill string, skill_category string, skill_level string")
    out = cleaning.clean_primary(skills, jobs)
    assert _rows(out, "skill") == [("sql",), ("sql",)]
    r = out.first()
    assert r["job_match_method"] == "exact" and r["posted_year"] == 2021 and r["source"] == "primary"


def test_unmatched_metadata_filled(spark):
    jobs = spark.createDataFrame([("J1", 1, "Senior", "2021")],
                                 "job_id string, ordinal long, experience_level string, posted_year string")
    skills = spark.createDataFrame([("J9", "SQL", "Programming", "Basic")],
                                   "job_id string, skill string, skill_category string, skill_level string")
    r = cleaning.clean_primary(skills, jobs).first()
    assert r["experience_level"] == "Not Specified" and r["posted_year"] is None
    assert r["posted_year_label"] == "Not Specified" and r["job_match_method"] == "unmatched"


def test_comma_list_explode(spark):
    df = spark.createDataFrame([("L1", " Python , ,SQL,python"), ("L2", None)], "job_link string, job_skills string")
    out = cleaning.explode_skill_list(df, "job_link", "job_skills")
    assert _rows(out, "job_link", "skill") == [("L1", "python"), ("L1", "sql")]


def test_year_filter_empty_selection_is_no_filter(spark):
    df = spark.createDataFrame([(2020, "ml"), (2021, "cloud"), (None, "ml")], "posted_year int, skill_category string")
    assert cleaning.year_filter(df).count() == 3  # rows without a year stay
    assert cleaning.year_filter(df, years=["Not Specified", 2021]).count() == 2
    assert cleaning.verified_years(df).count() == 2
    assert cleaning.year_filter(df, years=[2020]).count() == 1
    assert cleaning.year_filter(df, categories=["cloud"]).count() == 1


def test_year_beyond_an_int_is_null(spark):
    jobs = spark.createDataFrame([("J00000000001", 1, "20200101000")], "job_id string, ordinal long, posted_year string")
    skills = spark.createDataFrame([("J00000000001", "SQL", "P", "B")],
                                   "job_id string, skill string, skill_category string, skill_level string")
    jobs = jobs.withColumns({c: F.lit(None).cast("string") for c in ("experience_level", "country")})
    row = cleaning.clean_primary(skills, jobs).first()
    assert row.posted_year is None and row.posted_year_label == "Not Specified"


def test_filter_values_numeric_years_first(spark):
    df = spark.createDataFrame([("2021", "ml"), ("Not Specified", "cloud"), ("2020", "ml")],
                               "posted_year_label string, skill_category string")
    vals = cleaning.filter_values(df).orderBy("kind", "sort_group", "value").collect()
    years = [r["value"] for r in vals if r["kind"] == "year"]
    assert years == ["2020", "2021", "Not Specified"]


def test_clean_postings_contract_cases(spark):
    rows = [("Data Scientist", "Python, SQL", "2024-05-02", "EN", "US"),
            ("Data Scientist", "Python, SQL", "2024-05-02", "EN", "US"),      # exact duplicate
            ("Analyst", None, "2024-01-01", "MI", "UK"),                     # no skills
            ("Analyst", "  ", "2024-01-01", "MI", "UK"),                     # blank skills
            ("Engineer", "Spark", "not a date", "SE", "DE"),                 # bad date
            ("ML Engineer ", " TensorFlow\t", "2023-11-30", None, " FR ")]   # null level
    df = spark.createDataFrame(rows, "job_title string, skills_required string, date_posted string, "
                                     "experience_level string, company_location string")
    out = {r.job_title: r for r in cleaning.clean_postings(df).collect()}
    assert set(out) == {"Data Scientist", "ML Engineer"}
    assert out["Data Scientist"].skills_required == "python, sql" and out["Data Scientist"].quarter == "2024Q2"
    ml = out["ML Engineer"]
    assert ml.experience_level == "Not Specified" and ml.company_location == "fr" and ml.month == "2023-11"
    report = cleaning.unparsed_date_share(df).first()
    assert report.rows == 4 and report.unparsed == 1 and report.passed is False  # 25 % > 20 %


def test_clean_primary_sorts_no_skills(spark):
    """The skills are neither de-duplicated by sorting nor sorted for the joins."""
    jobs = spark.createDataFrame([("00000000001x", 1, "T", "2020"), ("00000000001y", 2, None, "x")], "job_id string, ordinal long, job_title string, posted_year string")
    skills = spark.createDataFrame([("E00000000001", " A ", "c", None), ("E00000000001", " A ", "c", None), ("00000000001x", "b\t", None, "l"), (None, "n", "c", "l")],
                                   "job_id string, skill string, skill_category string, skill_level string")
    jobs = jobs.withColumns({c: F.lit(None).cast("string") for c in ("experience_level", "country")})
    out = cleaning.clean_primary(skills, jobs)
    assert sorted((r.job_id or "", r.skill, r.job_match_method, r.posted_year_label) for r in out.collect()) == [
        ("", "n", "unmatched", "Not Specified"), ("00000000001x", "b", "exact", "2020"), ("00000000001y", "a", "prefix11", "Not Specified")]
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "SortMergeJoin" not in plan and plan.count("ShuffledHashJoin") == 2
