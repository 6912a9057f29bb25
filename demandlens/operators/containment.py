"""Names that contain one another, without all pairs (J8, G5 beyond a short list).

Two names match when they are equal or, both of three characters or more, one
stands in the other. What stands in a name has all of its 3-character grams there;
a short name is therefore filed under one of its own, the one that fewest long
names have, and meets only the long names with that gram. Each meeting is verified
with ``contains``. Equal names meet by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.functions.text import normalize_text
from demandlens.session import checkpointed

Q = 3


def clean(name: Column) -> Column:
    """A name as it is compared: stripped, lower-case."""
    return normalize_text(name)


def _grams(name: Column) -> Column:
    n = F.length(name) - (Q - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(name, i, F.lit(Q)))))


def inside(long: DataFrame, short: DataFrame) -> DataFrame:
    """(long, short): distinct pairs of clean names in which the short one, of Q
    characters or more, stands in the long one. Both frames have one column."""
    big = long.toDF("long").distinct()
    small = short.toDF("short").where(F.length("short") >= Q).distinct()
    index = checkpointed(big.select("long", F.explode(_grams(F.col("long"))).alias("gram")))
    often = index.groupBy("gram").agg(F.count(F.lit(1)).alias("k"))
    own = small.select("short", F.explode(_grams(F.col("short"))).alias("gram"))
    # a gram that no long name has rules its name out; else the rarest one files it
    rare = (own.join(often, "gram", "left").groupBy("short")
            .agg(F.min_by("gram", F.struct("k", "gram")).alias("gram"), F.min(F.col("k").isNotNull()).alias("all")).where("all").select("short", "gram"))
    return index.join(rare, "gram").where(F.contains("long", F.col("short"))).select("long", "short")


def matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left, right): distinct pairs of clean names that match. Both frames have one
    column; null and empty names match nothing but an equal name."""
    a = checkpointed(left.toDF("left").select(clean(F.col("left")).alias("left")).where(F.col("left").isNotNull()).distinct())
    b = checkpointed(right.toDF("right").select(clean(F.col("right")).alias("right")).where(F.col("right").isNotNull()).distinct())
    equal = a.join(b, F.col("left") == F.col("right"))
    forth = inside(a, b).select(F.col("long").alias("left"), F.col("short").alias("right"))
    back = inside(b, a).select(F.col("short").alias("left"), F.col("long").alias("right"))
    return equal.unionByName(forth.where("left != right")).unionByName(back.where("left != right"))


def matched_skills(profiles: DataFrame, names: DataFrame, key: str = "user_id", skills: str = "user_skills") -> DataFrame:
    """G5/J8 against a list of any length: (key, skill, name) of the user's skills
    that match a name. Distinct skills are matched once, however many users have them."""
    listed = checkpointed(profiles.select(key, F.explode(skills).alias("skill")).withColumn("_clean", clean(F.col("skill"))))
    found = matches(listed.select("_clean"), names)
    return listed.join(found, F.col("_clean") == F.col("left")).select(key, "skill", F.col("right").alias("name"))
