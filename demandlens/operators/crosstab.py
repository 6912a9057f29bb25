"""Experience-level x skill cross-tabs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlens.functions.text import level_label, level_sort_key
from demandlens.operators.frequency import top_of_counts
from demandlens.session import checkpointed


def experience_crosstab(df: DataFrame, top_n: int = 11, level: str = "experience_level",
                        map_codes: bool = True, zero_fill: bool = True) -> DataFrame:
    """Counts and row shares of the top-n skills per level.

    Rows with a null level are dropped; level codes are mapped to labels with
    unmapped values kept. ``zero_fill`` adds the cells of top skills a level
    never mentions (count 0), as the wide cross-tab shows them. Returns
    (experience_level, skill, n, share, pct, level_order); pct per level sums
    to 100.
    """
    lvl = level_label(F.col(level)) if map_codes else F.col(level)
    # one (level, skill) aggregate, the null level kept for the top list
    cells = checkpointed(df.groupBy(lvl.alias("experience_level"), "skill").agg(F.count(F.lit(1)).alias("n")))
    top = top_of_counts(cells, top_n, "n")  # at most top_n rows
    counts = cells.filter(F.col("experience_level").isNotNull()).join(F.broadcast(top), "skill", "left_semi")
    if zero_fill:
        # every level row gets every top skill: explode the bounded list
        top_arr = top.agg(F.collect_list("skill")).scalar()
        grid = (counts.select("experience_level").distinct()
                      .select("experience_level", F.explode(top_arr).alias("skill")))
        counts = (grid.join(counts, ["experience_level", "skill"], "left")
                      .select("experience_level", "skill", F.coalesce("n", F.lit(0)).alias("n")))
    w = Window.partitionBy("experience_level")  # rows per level <= top_n
    share = F.col("n") / F.sum("n").over(w)
    return counts.select(
        "experience_level", "skill", "n",
        share.alias("share"),
        (share * 100).alias("pct"),
        level_sort_key(F.col("experience_level")).alias("level_order"),
    )


def level_champions(crosstab: DataFrame) -> DataFrame:
    """The skill with the highest share per level, ties by name."""
    return (crosstab.groupBy("experience_level")
                    .agg(F.min_by("skill", F.struct(-F.col("share"), F.col("skill"))).alias("skill"),
                         F.max("share").alias("share"),
                         F.max("pct").alias("pct")))


def crosstab_row_check(crosstab: DataFrame, tol: float = 0.1) -> DataFrame:
    """A20 check: per level, the pct total and whether it is 100 within tol."""
    return (crosstab.groupBy("experience_level")
                    .agg(F.sum("pct").alias("pct_total"))
                    .withColumn("ok", F.abs(F.col("pct_total") - 100) <= tol))


def ordered_crosstab(crosstab: DataFrame) -> DataFrame:
    """The chart feed -- only the entry / mid / senior levels that
    exist, by name or by the label of their code (other levels, 'not specified'
    included, are dropped); skills ordered by their total share over all
    levels, the dropped ones included (ties by name)."""
    kept = crosstab.filter(F.col("level_order") < 99)
    totals = (crosstab.groupBy("skill").agg(F.sum("share").alias("_total"))  # <= top_n rows
                  .withColumn("skill_order", F.row_number().over(Window.orderBy(F.desc("_total"), F.asc("skill"))))
                  .drop("_total"))
    return kept.join(F.broadcast(totals), "skill").select(
        "experience_level", "skill", "n", "share", "pct", "level_order", "skill_order")
