"""Connected components of a link table, with DataFrame operations only.

Alternating large-star and small-star steps: every step rewires links towards
the smallest neighbour, so the number of steps grows with the logarithm of a
component's size. Minima are partial aggregates, so a node holding a third of
all links is reduced in every task first; the join that follows is split by
AQE. Each step's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

MAX_STEPS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (u, v) with u > v. Large: every larger neighbour is linked to the
    smallest one; small: every smaller neighbour and the node itself are."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    out = both.join(low, "u")
    if large:
        out = out.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        out = out.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u > v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of a link; component is the smallest
    node reachable. Self-links and null ends are ignored."""
    links = checkpointed(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                         .where(f"{a} is not null and {b} is not null and {a} != {b}").distinct())

    def state(x: DataFrame):
        return x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(links)
    for _ in range(MAX_STEPS):
        if not before[0]:
            break
        links = checkpointed(_star(_star(links, True), False))
        after = state(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    # now every node points at its component's smallest
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
