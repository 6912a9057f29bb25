"""Cleaning, key repair and the joins of the cleaning path."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.functions.text import (
    NOT_SPECIFIED,
    coerce_int,
    digit_year,
    normalize_text,
    strip_text,
)
from demandlens.session import checkpointed

# Column names of the inputs.
ANALYSIS_TEXT_COLS = ("skill", "skill_category", "skill_level", "experience_level", "source")
PRIMARY_JOB_TEXT_COLS = (
    "job_title", "company_type", "industry", "country", "city", "remote_type",
    "experience_level", "employment_type", "company_size",
)
PRIMARY_SKILL_TEXT_COLS = ("skill", "skill_category", "skill_level")
NUMERIC_JOB_COLS = ("min_experience_years", "salary_min_usd", "salary_max_usd", "posted_year")


def normalize_columns(df: DataFrame, cols: Iterable[str] = ANALYSIS_TEXT_COLS) -> DataFrame:
    """Strip + lower the present subset of ``cols``; nulls kept."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: normalize_text(c) for c in present}) if present else df


def keep_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Select the columns of ``cols`` that exist, in that order."""
    return df.select(*[c for c in cols if c in df.columns])


def fill_not_specified(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Null -> 'Not Specified' on the given string columns."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(NOT_SPECIFIED)) for c in cols if c in df.columns})


def coerce_numeric(df: DataFrame, cols: Iterable[str] = NUMERIC_JOB_COLS) -> DataFrame:
    """Numeric coercion to bigint, bad values -> null."""
    return df.withColumns({c: coerce_int(F.col(c).cast("string")) for c in cols if c in df.columns})


def first_by_key(df: DataFrame, key: str | Sequence[str], ordinal: str) -> DataFrame:
    """Keep the first row per key in ``ordinal`` order.

    Written as a ``min_by`` aggregate rather than a row_number window: the
    aggregate combines map-side, so a key holding a third of all rows is reduced
    in every task before the shuffle instead of landing whole in one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in others])
    return (df.groupBy(*keys).agg(F.min_by(row, F.col(ordinal)).alias("_first"))
              .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in others]))


def last_by_key(df: DataFrame, key: str, value: str, ordinal: str, out: str | None = None) -> DataFrame:
    """(key, value of the row with the highest ordinal): "last row wins"."""
    return df.groupBy(key).agg(F.max_by(value, ordinal).alias(out or value))


def repair_job_ids(skills: DataFrame, jobs: DataFrame, ordinal: str = "ordinal",
                   prefix_len: int = 11, marker: str = "E") -> DataFrame:
    """Key repair of the skills' ``job_id`` against the jobs table.

    A skill id equal to a job id is ``exact``. A skill id that starts with
    ``marker`` is looked up by its tail in a prefix map (first ``prefix_len``
    characters of each job id -> that job id, the last row in ``ordinal``
    order wins); a hit is ``prefix11`` and replaces the id. The prefix rule is
    applied second, so it overrides an exact match. Everything else is
    ``unmatched``. Adds ``job_id_normalized`` and ``job_match_method``.

    Both lookups are one table keyed by the id a skill row would carry: the
    job id itself (exact) and ``marker`` + its prefix (prefix hit). It is
    reduced to one row per key on the jobs side, so the (large) skills side
    is shuffled for a single join instead of one per lookup.
    """
    s = skills.withColumn("job_id", strip_text(F.col("job_id").cast("string")))
    j = jobs.select(strip_text(F.col("job_id").cast("string")).alias("job_id"),
                    F.col(ordinal).alias("_ord")).filter(F.col("job_id").isNotNull())
    # both keys of a job from one read of the jobs table
    keys = F.explode(F.array(
        F.struct(F.col("job_id").alias("_key"), F.lit(True).alias("_exact")),
        F.struct(F.concat(F.lit(marker), F.substring("job_id", 1, prefix_len)).alias("_key"), F.lit(False).alias("_exact"))))
    lookup = (j.select(keys.alias("_k"), F.col("job_id").alias("_job"), "_ord").select("_k._key", "_k._exact", "_job", "_ord")
              .groupBy("_key")
              .agg(F.max("_exact").alias("_exact_hit"),
                   F.max_by(F.col("_job"), F.when(~F.col("_exact"), F.col("_ord"))).alias("_prefix_job")))
    out = s.join(lookup.hint("shuffle_hash"), s["job_id"] == lookup["_key"], "left")
    method = (F.when(F.col("_prefix_job").isNotNull(), F.lit("prefix11"))
               .when(F.col("_exact_hit"), F.lit("exact"))
               .otherwise(F.lit("unmatched")))
    return (out.withColumn("job_id_normalized", F.coalesce(F.col("_prefix_job"), F.col("job_id")))
               .withColumn("job_match_method", method)
               .drop("_key", "_exact_hit", "_prefix_job"))


def clean_primary(skills: DataFrame, jobs: DataFrame, ordinal: str = "ordinal",
                  source: str = "primary") -> DataFrame:
    """C16 primary path: key repair -> dedup -> normalise -> coerce -> left
    join -> fill -> tag. Mirrors the reference's step order, including
    de-duplication before text normalisation (so case variants survive).

    ``skills``: job_id, skill, skill_category, skill_level (+ optional extras).
    ``jobs``: job_id, ``ordinal`` and job metadata columns.
    Output: one row per de-duplicated skill row; ``posted_year`` as int
    (null when unmatched or beyond an int) plus ``posted_year_label`` text for export.
    """
    repaired = repair_job_ids(skills, jobs, ordinal)
    jobs_clean = first_by_key(
        jobs.withColumn("job_id", strip_text(F.col("job_id").cast("string"))),
        "job_id", ordinal)
    # what the repair adds follows from job_id; as keys these need no sort, as strings to be kept would
    skills_dedup = repaired.dropDuplicates(["job_id", "skill", "skill_category", "skill_level", "job_id_normalized", "job_match_method"])
    jobs_clean = normalize_columns(jobs_clean, PRIMARY_JOB_TEXT_COLS)
    skills_dedup = normalize_columns(skills_dedup, PRIMARY_SKILL_TEXT_COLS)
    jobs_clean = coerce_numeric(jobs_clean).withColumnRenamed("job_id", "job_id_job").drop(ordinal)
    # one row a key on the jobs' side: hashed by partition, the many skills need no sort
    merged = skills_dedup.join(jobs_clean.hint("shuffle_hash"), skills_dedup["job_id_normalized"] == jobs_clean["job_id_job"], "left")
    merged = (merged.withColumn("source", F.lit(source))
                    .withColumn("job_id", F.col("job_id_normalized")).drop("job_id_normalized"))
    merged = fill_not_specified(merged, ["experience_level", "country"])
    return (merged.withColumn("posted_year", F.col("posted_year").try_cast("int"))
                  .withColumn("posted_year_label",
                              F.coalesce(F.col("posted_year").cast("string"), F.lit(NOT_SPECIFIED))))


def explode_skill_list(df: DataFrame, key: str, list_col: str, sep: str = ",") -> DataFrame:
    """Split a separated list, explode, strip + lower, drop blanks,
    de-duplicate (key, skill). Null lists explode to nothing."""
    pieces = df.select(key, F.explode(F.split(F.coalesce(F.col(list_col), F.lit("")), sep)).alias("_piece"))
    return (pieces.select(key, normalize_text("_piece").alias("skill"))
                  .filter(F.col("skill") != "")
                  .dropDuplicates([key, "skill"]))


def semi_join_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Keep rows whose key is in ``keys`` (a left semi join)."""
    return df.join(keys.select(key), key, "left_semi")


def year_filter(df: DataFrame, years: Sequence[int] | None = None,
                categories: Sequence[str] | None = None,
                year_range: tuple[int, int] | None = None,
                year: str = "posted_year", category: str = "skill_category") -> DataFrame:
    """Dashboard filters; an empty or missing selection filters nothing.

    Years are chosen by their label, so rows without a year stay unless a
    selection leaves out 'Not Specified'. ``year_range`` (the slicer) is for
    numeric years only."""
    out = df
    if years:
        label = F.coalesce(F.col(year).cast("string"), F.lit(NOT_SPECIFIED))
        out = out.filter(label.isin([str(y) for y in years]))
    if categories:
        out = out.filter(F.col(category).isin(list(categories)))
    if year_range:
        out = out.filter(F.col(year).between(year_range[0], year_range[1]))
    return out


def verified_years(df: DataFrame, year: str = "posted_year") -> DataFrame:
    """The rows with a year."""
    return df.filter(F.col(year).isNotNull())


def slicer_panel(df: DataFrame, year_range: tuple[int, int], skills: Sequence[str],
                 year: str = "posted_year") -> DataFrame:
    """The trend panel (year, skill, mentions) within the slicer's range and
    the chosen skills, beside the cards (all mentions and years, which the
    slicer leaves alone). One (year, skill) aggregate feeds both."""
    counts = checkpointed(df.groupBy(F.col(year).alias("posted_year"), "skill").agg(F.count(F.lit(1)).alias("mentions")))
    panel = year_filter(counts, year_range=year_range).filter(F.col("skill").isin(list(skills)))
    return panel.select("posted_year", "skill", "mentions",
                        counts.agg(F.sum("mentions")).scalar().alias("card_mentions"),
                        counts.agg(F.countDistinct("posted_year")).scalar().alias("card_years"))


def load_clean(df: DataFrame, columns: Sequence[str], year: str = "posted_year") -> DataFrame:
    """An uploaded or stored fact table made ready for analysis:
    the columns of ``columns`` that exist, text normalised, mixed years as the
    int of an all-digit text (else null)."""
    out = normalize_columns(keep_columns(df, columns))
    return out.withColumn(year, year_of_text(year)) if year in out.columns else out


def filter_values(df: DataFrame, year: str = "posted_year_label", category: str = "skill_category") -> DataFrame:
    """Available filter values: numeric years ascending, then text years,
    and the sorted categories. Returns (kind, value, sort_group)."""
    # both lists from one pass over (year, category)
    kinds = F.explode(F.array(F.struct(F.lit("year").alias("kind"), F.col(year).cast("string").alias("value")),
                              F.struct(F.lit("category").alias("kind"), F.col(category).cast("string").alias("value"))))
    values = df.select(year, category).distinct().select(kinds.alias("v")).select("v.*").distinct()
    text_year = (F.col("kind") == "year") & ~F.coalesce(F.col("value").rlike(r"^[0-9]+$"), F.lit(False))
    return (values.filter((F.col("kind") == "year") | F.col("value").isNotNull())
            .select("kind", "value", F.when(text_year, 1).otherwise(0).alias("sort_group")))


def parse_timestamp(c: Column | str) -> Column:
    """Text -> timestamp; unparsable -> null (never raises under ANSI)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.try_to_timestamp(col.cast("string"))


def year_of_text(c: Column | str) -> Column:
    """C4: an all-digit year string -> int, else null."""
    return digit_year(c)


POSTING_TEXT_COLS = ("job_title", "skills_required", "date_posted", "experience_level", "company_location")
Step = Callable[[DataFrame], DataFrame]


def _stripped(c: str) -> Column:
    return F.regexp_replace(F.col(c), r"^\s+|\s+$", "")


def posting_steps(skills: str = "skills_required", date: str = "date_posted", title: str = "job_title",
                  level: str = "experience_level") -> list[tuple[str, Step]]:
    """The ten steps of the postings' cleaning, in the contract's order. A frame
    has no row index and counting is the log's work, so 9 and 10 change nothing."""
    def text(df: DataFrame) -> list[str]:
        return [c for c in POSTING_TEXT_COLS if c in df.columns]

    def derive(df: DataFrame) -> DataFrame:
        quarter = F.concat(F.year("posted_date").cast("string"), F.lit("Q"), F.quarter("posted_date").cast("string"))
        return df.withColumn("year", F.year("posted_date")).withColumn("month", F.date_format("posted_date", "yyyy-MM")).withColumn("quarter", quarter)

    return [
        ("drop rows without skills", lambda df: df.filter(F.col(skills).isNotNull() & (_stripped(skills) != ""))),
        ("strip text", lambda df: df.withColumns({c: _stripped(c) for c in text(df)})),
        ("lower-case text", lambda df: df.withColumns({c: F.lower(F.col(c)) for c in text(df) if c != title})),
        ("parse dates", lambda df: df.withColumn("posted_date", F.try_to_timestamp(F.col(date)).cast("date"))),
        ("drop unparsed dates", lambda df: df.filter(F.col("posted_date").isNotNull())),
        ("derive periods", derive),
        ("fill levels", lambda df: df.withColumn(level, F.coalesce(F.col(level), F.lit(NOT_SPECIFIED)))),
        ("drop duplicates", lambda df: df.dropDuplicates()),
        ("reset index", lambda df: df),
        ("final count", lambda df: df),
    ]


def clean_postings(df: DataFrame, skills: str = "skills_required", date: str = "date_posted",
                   title: str = "job_title", level: str = "experience_level") -> DataFrame:
    """C16 (contract form): drop rows without skills -> strip all text ->
    lower-case all text but the title -> parse the date -> drop unparsed
    dates -> year, 'yyyy-MM' month and 'yyyyQn' quarter -> fill a missing
    level with 'Not Specified' -> drop exact duplicates. One projection chain
    and one de-duplication shuffle; step counts by ``steplog.clean_logged``."""
    for _, step in posting_steps(skills, date, title, level):
        df = step(df)
    return df


def unparsed_date_share(df: DataFrame, date: str = "date_posted", skills: str = "skills_required",
                        max_share: float = 0.20) -> DataFrame:
    """C17: share of rows (with skills) whose date does not parse, and whether
    it is within ``max_share`` (the contract fails above 20 %)."""
    rows = df.filter(F.col(skills).isNotNull() & (F.regexp_replace(F.col(skills), r"^\s+|\s+$", "") != ""))
    bad = F.try_to_timestamp(F.regexp_replace(F.col(date), r"^\s+|\s+$", "")).isNull()
    return (rows.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(bad, 1)).alias("unparsed"))
                .withColumn("unparsed_share", F.coalesce(F.col("unparsed") / F.col("rows"), F.lit(0.0)))
                .withColumn("passed", F.col("unparsed_share") <= max_share))
