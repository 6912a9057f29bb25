"""Links among the members of candidate buckets, without all pairs of a bucket.

DataFrame operations only. Each member is first verified against its bucket's
smallest member; then the pairs of a bucket that are still in different
components: those that the caller's ``rest`` can't rule out (``every_pair``
rules out none). A pair within one component can connect nothing, so the
components are those of all pairs, while a bucket of n copies costs n
verifications.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .components import components

Verify = Callable[[DataFrame], DataFrame]


def shared(rows: DataFrame) -> DataFrame:
    """Rows (sig, node, own, ...) of the buckets with two nodes or more, one of
    them ``own``, with the smallest own node as ``rep``. The counts are partial
    aggregates and the join can be split, so a hot bucket needs no single task."""
    full = (rows.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high"),
                                    F.min(F.when(F.col("own"), F.col("node"))).alias("rep"))
            .where("low < high and rep is not null").select("sig", "rep"))
    return rows.join(full, "sig")


def connect(members: DataFrame, verify: Verify, near: Callable[[Column, Column], Column],
            rest: Verify) -> DataFrame:
    """Links (a, b) that give the same components as verifying every pair of
    every bucket in which one is ``own``.

    ``members``: sig, rep, node, own and a struct ``hint``, written to a table;
    ``near(hint, hint)`` is a cheap necessary condition; ``verify`` keeps the
    true ones of distinct pairs (a, b), a < b. ``rest`` maps the members (sig,
    rep, node, own, hint, part) of buckets with several components, none of
    which is linked to the bucket's rep but by its component, to pairs (a, b)."""
    hints = members.select("node", "hint").distinct()

    def paired(heads: DataFrame, rep: str, node: str) -> DataFrame:
        x = hints.select(F.col("node").alias(rep), F.col("hint").alias("hint_rep"))
        y = hints.select(F.col("node").alias(node), F.col("hint").alias("hint_node"))
        pairs = heads.where(f"{rep} != {node}").select(rep, node).distinct()
        return (pairs.join(x, rep).join(y, node).where(near(F.col("hint_rep"), F.col("hint_node")))
                .select(F.least(rep, node).alias("a"), F.greatest(rep, node).alias("b")).distinct())

    def mixed(found: DataFrame) -> DataFrame:
        """Members, with their component, of buckets that hold more than one."""
        parts = components(found)
        out = (members.join(parts.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
               .select("sig", "rep", "node", "own", "hint", F.coalesce("component", "node").alias("part")))
        more = out.groupBy("sig").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("sig")
        return checkpointed(out.join(more, "sig", "left_semi"))

    found = checkpointed(verify(paired(members, "rep", "node")))
    left = mixed(found)
    return found.unionByName(verify(rest(left).join(hints.select(
        F.col("node").alias("a"), F.col("hint").alias("hint_a")), "a").join(hints.select(
            F.col("node").alias("b"), F.col("hint").alias("hint_b")), "b")
        .where(near(F.col("hint_a"), F.col("hint_b"))).select("a", "b").distinct()))


def every_pair(left: DataFrame) -> DataFrame:
    """The pairs of different components in a bucket, one of them ``own``."""
    p, q = left.alias("p"), left.alias("q")
    return (p.join(q, F.col("p.sig") == F.col("q.sig"))
            .where("p.own and p.part != q.part and (not q.own or p.node < q.node)")
            .select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct())
