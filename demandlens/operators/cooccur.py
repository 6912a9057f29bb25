"""Skill co-occurrence within jobs.

Pairs are formed inside each job over its *distinct* skills restricted to the
top-n list, so a job contributes at most n(n-1)/2 pairs however many rows it
has. The (job, skill) de-duplication is a partial aggregate: a job holding a
third of all rows is reduced to <= n rows in every map task before the
shuffle. The per-job array is therefore bounded by n, never by the job size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlens.operators.frequency import top_of_counts
from demandlens.session import checkpointed

MIN_PAIRS = 5  # fixed value: pairs that a usable matrix has at least

# sorted distinct skills s -> all (s[i], s[j]) with i < j
_PAIRS = ("flatten(transform(sequence(1, size(s) - 1), i -> "
          "transform(sequence(i + 1, size(s)), j -> named_struct('a', s[i - 1], 'b', s[j - 1]))))")


def job_skill_sets(df: DataFrame, top_n: int, key: str = "job_id") -> DataFrame:
    """(job, sorted distinct skills of the job among the top-n skills); only
    jobs with at least two such skills. The top-n list (by raw mentions) and
    the sets come from one (job, skill, k) aggregate, so the input is scanned
    and joined once."""
    per = job_skill_counts(df, key)
    return _sets(per, top_of_counts(per, top_n, "k"), key)


def job_skill_counts(df: DataFrame, key: str = "job_id") -> DataFrame:
    """(job, skill, k): mentions of each skill per job, a partial aggregate per
    task, written once: the one read of the input for all that follows."""
    return checkpointed(df.filter(F.col("skill").isNotNull()).groupBy(key, "skill").agg(F.count(F.lit(1)).alias("k")))


def _sets(per: DataFrame, top: DataFrame, key: str) -> DataFrame:
    return (per.join(F.broadcast(top), "skill", "left_semi")  # top: <= n rows
               .groupBy(key).agg(F.sort_array(F.collect_list("skill")).alias("s"))
               .filter(F.size("s") >= 2))


def cooccurrence_pairs(df: DataFrame, top_n: int = 11, key: str = "job_id") -> DataFrame:
    """K1: (skill_a, skill_b, co_occurrence) with skill_a < skill_b, counted
    over jobs, for the top-n skills."""
    return pair_counts(job_skill_sets(df, top_n, key))


def pair_counts(sets: DataFrame) -> DataFrame:
    """K1 of jobs' sorted skill sets ``s``, of two skills or more each."""
    pairs = sets.select(F.explode(F.expr(_PAIRS)).alias("p"))
    return (pairs.groupBy(F.col("p.a").alias("skill_a"), F.col("p.b").alias("skill_b"))
                 .agg(F.count(F.lit(1)).alias("co_occurrence")))


def cooccurrence_matrix(df: DataFrame, top_n: int = 11, key: str = "job_id") -> DataFrame:
    """K2: the symmetric n x n matrix in long form (skill_a, skill_b, n), zero
    diagonal, zero for pairs never seen together."""
    return matrix_and_pairs(df, top_n, key)[0]


def matrix_and_pairs(df: DataFrame, top_n: int = 11, key: str = "job_id") -> tuple[DataFrame, DataFrame]:
    """K2 and K1 from one read of the input."""
    per = job_skill_counts(df, key)
    top = checkpointed(top_of_counts(per, top_n, "k"))  # <= n rows
    pairs = checkpointed(pair_counts(_sets(per, top, key)))  # <= n (n - 1) / 2 rows
    both = pairs.select("skill_a", "skill_b", "co_occurrence").unionByName(
        pairs.select(F.col("skill_b").alias("skill_a"), F.col("skill_a").alias("skill_b"), "co_occurrence"))
    names = top.agg(F.collect_list("skill")).scalar()  # <= n names
    grid = (top.select(F.col("skill").alias("skill_a"))
               .select("skill_a", F.explode(names).alias("skill_b")))
    matrix = (grid.join(both, ["skill_a", "skill_b"], "left")
                  .select("skill_a", "skill_b",
                        F.when(F.col("skill_a") == F.col("skill_b"), F.lit(0))
                         .otherwise(F.coalesce("co_occurrence", F.lit(0))).cast("bigint").alias("n")))
    return matrix, pairs


def top_pairs(pairs: DataFrame, k: int = 15) -> DataFrame:
    """K3: the k pairs seen together most often, labelled 'a + b' (ties by names)."""
    order = [F.desc("co_occurrence"), F.asc("skill_a"), F.asc("skill_b")]
    return pairs.orderBy(*order).limit(k).select(
        F.row_number().over(Window.orderBy(*order)).alias("rank"),
        F.concat_ws(" + ", "skill_a", "skill_b").alias("skill_pair"), "co_occurrence")


def matrix_cards(matrix: DataFrame, pairs: DataFrame, min_pairs: int = MIN_PAIRS) -> DataFrame:
    """K3/K4: matrix size, non-zero cells, number of pair rows, the strongest
    pair (ties by names), whether the matrix is symmetric, and whether at least
    ``min_pairs`` pairs were seen."""
    mirrored = matrix.select(F.col("skill_b").alias("skill_a"), F.col("skill_a").alias("skill_b"),
                             F.col("n").alias("n_t"))
    asym = (matrix.join(mirrored, ["skill_a", "skill_b"], "full")
                  .filter(~F.col("n").eqNullSafe(F.col("n_t"))).agg(F.count(F.lit(1))).scalar())
    top = pairs.orderBy(F.desc("co_occurrence"), F.asc("skill_a"), F.asc("skill_b")).limit(1)
    return matrix.agg(
        F.countDistinct("skill_a").alias("size"),
        F.count(F.when(F.col("n") > 0, 1)).alias("nonzero_cells"),
    ).select(
        "size", "nonzero_cells",
        pairs.agg(F.count(F.lit(1))).scalar().alias("pair_rows"),
        top.select(F.concat_ws(" + ", "skill_a", "skill_b")).scalar().alias("top_pair"),
        top.select("co_occurrence").scalar().alias("top_pair_count"),
        (asym == 0).alias("symmetric"),
        (pairs.agg(F.count(F.when(F.col("co_occurrence") > 0, 1))).scalar() >= min_pairs).alias("enough_pairs"),
    )
