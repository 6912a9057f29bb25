"""Cleaning with a log of its steps and gates.

Each step's rows are counted by ``observe`` while the one action that writes the
cleaned table runs; no step is counted by a job of its own. The gates look at the
log afterwards: a run that fails one is removed and reported, so nothing reads a
table that lost its dates or all of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from demandlens.operators.cleaning import Step, posting_steps
from demandlens.operators.quality import MAX_UNPARSED_DATE_SHARE, nonempty
from demandlens.session import checkpointed, remove_tables, tables_folder

DERIVED = ("year", "month", "quarter")
LOG_SCHEMA = "step_no int, step string, rows_before long, rows_after long, dropped long"
GATE_SCHEMA = "check string, observed double, threshold double, passed boolean"


class CleaningHalted(ValueError):
    """A gate failed; ``run`` has the log and the gates, without a table."""

    def __init__(self, run: CleaningRun):
        self.run = run
        failed = [f"{name}: {seen:g} (allowed {limit:g})" for name, seen, limit, ok in run.gates if not ok]
        super().__init__("cleaning halted: " + "; ".join(failed))


@dataclass
class CleaningRun:
    """A cleaned table (None when a gate failed), its step rows and its gates."""

    table: DataFrame | None
    steps: list[tuple[int, str, int, int, int]]
    gates: list[tuple[str, float, float, bool]]

    @property
    def passed(self) -> bool:
        return all(g[3] for g in self.gates)

    def log(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.steps, LOG_SCHEMA)

    def report(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.gates, GATE_SCHEMA)


def run_steps(df: DataFrame, steps: Sequence[tuple[str, Step]], name: str) -> tuple[DataFrame, list[Observation]]:
    """The frame after all steps, with an observation of the rows after each (the
    first one: of the input). ``unparsed`` counts rows without a parsed date."""
    seen = []

    def observed(x: DataFrame) -> DataFrame:
        seen.append(Observation(f"{name}:{len(seen)}"))
        bad = F.col("posted_date").isNull() if "posted_date" in x.columns else F.lit(False)
        return x.observe(seen[-1], F.count(F.lit(1)).alias("rows"), F.count(F.when(bad, 1)).alias("unparsed"))

    df = observed(df)
    for _, step in steps:
        df = observed(step(df))
    return df, seen


@contextmanager
def _every_step(spark: SparkSession) -> Iterator[None]:
    """Keep steps in the running plan that an empty shuffle would cut off, and
    their counts with them."""
    key, rule = "spark.sql.adaptive.optimizer.excludedRules", "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"
    before = spark.conf.get(key, None)
    spark.conf.set(key, f"{before},{rule}" if before else rule)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _counts(seen: Sequence[Observation]) -> list[dict[str, int]]:
    """What was observed. A plan over an input that is known to be empty has no
    steps left; they count nothing."""
    out = []
    for obs in seen:
        try:
            out.append({k: int(v) for k, v in obs.get.items()})
        except Py4JJavaError:
            out.append({"rows": 0, "unparsed": 0})
    return out


def clean_logged(df: DataFrame, max_share: float = MAX_UNPARSED_DATE_SHARE, strict: bool = True) -> CleaningRun:
    """The ten steps of ``cleaning.posting_steps`` in one action, their
    counts and the gates: rows left after the null filter, share of unparsed dates,
    derived columns. A failed gate raises ``CleaningHalted`` (or, without
    ``strict``, gives a run without a table); the written table is removed."""
    spark = df.sparkSession
    steps = posting_steps()
    out, seen = run_steps(df, steps, "clean_postings")
    with tables_folder(spark) as folder, _every_step(spark):
        table = checkpointed(out)
    counts = _counts(seen)
    rows = [c["rows"] for c in counts]
    if not rows[-1] and nonempty(table):
        raise RuntimeError("the cleaned table has rows that were not counted")
    log = [(k + 1, name, rows[k], rows[k + 1], rows[k] - rows[k + 1]) for k, (name, _) in enumerate(steps)]
    parsed = next(k for k, (name, _) in enumerate(steps) if name == "parse dates") + 1
    share = counts[parsed]["unparsed"] / rows[parsed] if rows[parsed] else 0.0
    missing = [c for c in DERIVED if c not in table.columns]
    gates = [("rows_after_null_filter", float(rows[1]), 1.0, rows[1] >= 1 or rows[0] == 0),
             ("unparsed_date_share", share, max_share, share <= max_share),
             ("derived_columns_missing", float(len(missing)), 0.0, not missing)]
    run = CleaningRun(table, log, gates)
    if not run.passed:
        run.table = None
        remove_tables(spark, folder)
        if strict:
            raise CleaningHalted(run)
    return run
