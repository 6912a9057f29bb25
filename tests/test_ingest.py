"""Refused values, order of ingest, encodings and the step log."""

import random

import pytest
from pyspark.sql import functions as F

from demandlens.operators import cleaning, steplog
from demandlens.sources import ingest

TYPES = {"id": "bigint", "n": "bigint", "small": "int", "x": "double", "at": "timestamp", "day": "date", "s": "string"}


def test_quarantine_splits_rows_by_what_converts(spark):
    rows = [("1", "2020", "3", "1.5", "2024-01-31 10:00:00", "2024-01-31", "a"),
            ("2", "2020.0", None, "", "", None, None),  # missing is not refused
            ("3", "1.5", "3000000000", "abc", "soon", "2024-02-30", "b"),
            ("x", " 7 ", "1", "1e3", "2024-01-01", "2024-01-01", "c")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in TYPES))
    clean, bad = ingest.quarantine(df, TYPES, ["s"])
    assert {c: t for c, t in clean.dtypes} == TYPES
    assert sorted(r.id for r in clean.collect()) == [1, 2]
    assert sorted((r.s, r["column"], r.raw, r.reason) for r in bad.collect()) == sorted([
        ("b", "n", "1.5", "no whole number"), ("b", "small", "3000000000", "no whole number in range"), ("b", "x", "abc", "no number"),
        ("b", "at", "soon", "no date"), ("b", "day", "2024-02-30", "no date"), ("c", "id", "x", "no whole number")])
    assert ingest.balance(df, TYPES).first() == (4, 2, 2, 6)
    assert ingest.balance(df.limit(0), TYPES).first() == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        ingest.tagged(df, {"id": "binary"})


def test_broken_lines_are_refused_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,n,s\n1,2,x\n2,3\n3,4,y,z\n4,bad,w\n")
    (tmp_path / "b.csv").write_text('id,n,s\n5,6,"quoted, with a comma"\n\n')
    df = ingest.read_csv_text(spark, str(tmp_path), ["id", "n", "s"])
    types = {"id": "bigint", "n": "bigint", "s": "string"}
    clean, bad = ingest.quarantine(df, types, ["id"])
    assert sorted(map(tuple, clean.collect())) == [(1, 2, "x"), (5, 6, "quoted, with a comma")]
    assert sorted((r.id, r["column"] or "", r.raw) for r in bad.collect()) == [(2, "", "2,3"), (3, "", "3,4,y,z"), (4, "n", "bad")]
    counts = ingest.balance(df, types).first()
    assert counts.rows == counts.clean + counts.refused == 5
    # the count does not hang on the columns that are asked for
    assert ingest.balance(df, {"id": "bigint"}).first().refused == 2


@pytest.mark.parametrize("fmt", ["parquet", "csv", "text"])
def test_ingest_order_does_not_follow_the_tasks(spark, tmp_path, fmt):
    """First and last rows are the same however the files are dealt to tasks."""
    rnd, expected, path = random.Random(4), [], str(tmp_path / "t")
    for f in range(7):
        rows = [(rnd.randrange(12), f * 1000 + k) for k in range(rnd.randrange(1, 60))]
        expected += rows
        df = spark.createDataFrame(rows, "k long, v long").coalesce(1)
        if fmt == "text":
            df = df.select(F.concat_ws(",", "k", "v").alias("value"))
        one = tmp_path / f"one{f}"
        df.write.format(fmt).save(str(one))
        (tmp_path / "t").mkdir(exist_ok=True)
        part = next(p for p in one.iterdir() if p.name.startswith("part-"))
        (tmp_path / "t" / f"part-{f:03d}.{fmt}").write_bytes(part.read_bytes())
    schema = None if fmt != "csv" else "k long, v long"
    found = []
    for size in ("128m", "100", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        try:
            df = ingest.read_ordered(spark, path, fmt, schema)
            if fmt == "text":
                cut = F.split("value", ",")
                df = df.select(cut[0].cast("long").alias("k"), cut[1].cast("long").alias("v"), "ordinal")
            numbered = ingest.row_numbers(df)
            assert [(r.k, r.v) for r in numbered.orderBy("row_number").collect()] == expected
            assert sorted(r.row_number for r in numbered.collect()) == list(range(len(expected)))
            assert [(r.k, r.v) for r in ingest.first_rows(df, 5).collect()] == expected[:5]
            first = cleaning.first_by_key(numbered.select("k", "v", "row_number"), "k", "row_number")
            last = cleaning.last_by_key(numbered, "k", "v", "row_number")
            found.append((sorted((r.k, r.v) for r in first.collect()), sorted((r.k, r.v) for r in last.collect())))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    wins = {}
    for k, v in expected:
        wins.setdefault(k, []).append(v)
    assert all(f == (sorted((k, v[0]) for k, v in wins.items()), sorted((k, v[-1]) for k, v in wins.items())) for f in found)


def test_each_file_has_its_own_encoding(spark, tmp_path):
    where = tmp_path / "mixed files"
    where.mkdir()
    (where / "latin.csv").write_bytes("id,name\n1,café\n2,plain\n".encode("latin-1"))
    (where / "utf.csv").write_bytes("id,name\n3,café\n".encode())
    (where / "mark.csv").write_bytes("id,name\n4,a�b\n".encode())  # U+FFFD itself, no damage
    got = {r.id: r.name for r in ingest.read_csv_mixed(spark, str(where), "id long, name string").collect()}
    assert got == {1: "café", 2: "plain", 3: "café", 4: "a�b"}
    assert {k: len(v) for k, v in ingest.files_by_encoding(spark, str(where)).items()} == {"utf-8": 2, "latin-1": 1}


def test_upload_from_file_to_clean_rows(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("job_id,skill,posted_year,remark\nA1, Café ,2021,x\nA2,SQL,2021.0,\nA3,,Not Specified,\n".encode("latin-1"))
    got = ingest.load_upload(spark, str(tmp_path / "u.csv"), ["job_id", "skill", "posted_year", "remark"], ["job_id", "skill", "skill_level", "posted_year"])
    assert got.columns == ["job_id", "skill", "posted_year"]
    assert sorted(map(tuple, got.collect())) == [("A1", "café", 2021), ("A2", "sql", None), ("A3", None, None)]


# --- step log ----------------------------------------------------------------

POSTINGS = "job_title string, skills_required string, date_posted string, experience_level string, company_location string"


def _postings(spark, bad=1, total=10):
    rows = [("  Data Scientist ", "Python, SQL", "not-a-date" if k < bad else f"2024-01-{k + 1:02d}", None, "IN") for k in range(total)]
    rows += [("x", None, "2024-01-01", "SE", "US"), ("x", "  ", "2024-01-01", "SE", "US"), rows[-1], rows[-1]]
    return spark.createDataFrame(rows, POSTINGS)


def test_ten_steps_are_counted_in_one_action(spark):
    run = steplog.clean_logged(_postings(spark))
    assert [s[0] for s in run.steps] == list(range(1, 11)) and len({s[1] for s in run.steps}) == 10
    assert [(s[2], s[3]) for s in run.steps] == [(14, 12), (12, 12), (12, 12), (12, 12), (12, 11), (11, 11), (11, 11), (11, 9), (9, 9), (9, 9)]
    assert all(before == prior for (_, _, _, prior, _), (_, _, before, _, _) in zip(run.steps, run.steps[1:], strict=False))
    plain = cleaning.clean_postings(_postings(spark))
    assert sorted(map(str, run.table.collect())) == sorted(map(str, plain.collect()))
    assert run.passed and run.gates[1][1] == pytest.approx(1 / 12)
    assert [r.dropped for r in run.log(spark).orderBy("step_no").collect()] == [2, 0, 0, 0, 1, 0, 0, 2, 0, 0]


def test_gate_halts_above_a_fifth_of_unparsed_dates(spark):
    with pytest.raises(steplog.CleaningHalted, match="unparsed_date_share") as halted:
        steplog.clean_logged(_postings(spark, bad=4))
    assert halted.value.run.table is None and not halted.value.run.passed
    run = steplog.clean_logged(_postings(spark, bad=4), strict=False)
    assert {g[0]: g[3] for g in run.gates} == {"rows_after_null_filter": True, "unparsed_date_share": False, "derived_columns_missing": True}
    assert steplog.clean_logged(_postings(spark, bad=4), max_share=0.5).passed


def test_gate_halts_when_no_row_has_skills(spark):
    rows = spark.createDataFrame([("a", None, "2024-01-01", "SE", "US")], POSTINGS)
    with pytest.raises(steplog.CleaningHalted, match="rows_after_null_filter"):
        steplog.clean_logged(rows)
    assert steplog.clean_logged(rows.limit(0)).passed  # nothing in, nothing lost
