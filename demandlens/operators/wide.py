"""Wide forms of the long results.

A wide table has a column for each name of a bounded list, in the list's order,
whatever the data holds: names without a row are there too, names beyond the list
are left out. The list is given, or read from a top-n list of at most ``MOST``
rows; ``pivot`` with given values takes one aggregate and no look at the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.operators.trends import annual_share

#: Columns a wide table has at most.
MOST = 500


def name_list(names: DataFrame, column: str = "skill", most: int = MOST) -> list[str]:
    """The names of a bounded list in its order (by ``rank`` where it has one, else
    by name). A list of more than ``most`` names is an error, not a cut."""
    order = ["rank", column] if "rank" in names.columns else [column]
    rows = names.select(*dict.fromkeys([*order, column])).where(F.col(column).isNotNull()).distinct().orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} names for the columns of a wide table")
    return list(dict.fromkeys(r[column] for r in rows))


def wide(df: DataFrame, index: str | Sequence[str], column: str, value: str, names: Sequence, fill=None) -> DataFrame:
    """One row per ``index``, one column per name in the order of ``names``; the sum
    of a cell's values, ``fill`` where there is none."""
    if len(names) > MOST:
        raise ValueError(f"more than {MOST} names for the columns of a wide table")
    keys = [index] if isinstance(index, str) else list(index)
    if not names:
        return df.select(*keys).distinct()
    out = df.groupBy(*keys).pivot(column, list(names)).agg(F.sum(value))
    cells = [F.col(f"`{n}`") for n in map(str, names)]
    return out.select(*keys, *[(c if fill is None else F.coalesce(c, F.lit(fill))).alias(str(n)) for c, n in zip(cells, names, strict=True)])


def lift_table(rules: DataFrame, consequents: Sequence[str]) -> DataFrame:
    """M8: antecedents x consequents, the mean lift; a pair without a rule has none."""
    mean = rules.groupBy("antecedents", "consequents").agg(F.avg("lift").alias("lift"))
    return wide(mean, "antecedents", "consequents", "lift", consequents)


def cooccurrence_table(matrix: DataFrame, skills: Sequence[str]) -> DataFrame:
    """K2: the square table of the given skills, 0 where a pair was never seen."""
    kept = matrix.where(F.col("skill_a").isin(list(skills)))
    return wide(kept, "skill_a", "skill_b", "n", skills, 0)


def share_table(df: DataFrame, years: Sequence[int], year: str = "posted_year") -> DataFrame:
    """Skills x years, the share of each year's mentions, 0 where there is
    none, and the change from the first to the last year in percentage points; a
    skill without rows in either year has no change."""
    annual = annual_share(df, year).where(F.col("skill").isNotNull())
    out = wide(annual, "skill", "posted_year", "share", years)
    change = ((F.col(f"`{years[-1]}`") - F.col(f"`{years[0]}`")) * 100).alias("change_pp")
    return out.select("skill", *[F.coalesce(F.col(f"`{y}`"), F.lit(0.0)).alias(str(y)) for y in years], change)


def level_table(crosstab: DataFrame, skills: Sequence[str], value: str = "n") -> DataFrame:
    """Experience levels x skills, counts (``n``) or row shares, 0 where a
    level never mentions a skill."""
    return wide(crosstab, "experience_level", "skill", value, skills, 0 if value == "n" else 0.0)
