"""Baskets, frequent itemsets and association rules.

Baskets keep one row per job with its *distinct* items (sorted) and the list
length counting repeats; the reference's ">= 2 items" rule is applied to that
length, before de-duplication, and those baskets stay in the denominator.
The (job, item) de-duplication runs as a partial aggregate, so a hot job is
reduced per task; each basket array is bounded by the item vocabulary (top-n
items for mining), not by the job's row count.

Frequent itemsets come from MLlib ``FPGrowth`` (parallel FP-growth). Rules
are expanded from the itemsets with Spark SQL: every non-empty proper subset
of an itemset is an antecedent (bitmask over the sorted items), the rest is
the consequent, and both sides' supports are joined back from the itemsets.
This gives multi-item consequents, which FPGrowth's own rules do not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlens.session import checkpointed

# Support, lift and confidence thresholds with their fallbacks,
# and the top-n item limits.
DEFAULT_MIN_SUPPORT = 0.05
FALLBACK_MIN_SUPPORT = 0.03
DEFAULT_LIFT_THRESHOLD = 1.2
FALLBACK_LIFT_THRESHOLD = 0.90
DEFAULT_CONF_THRESHOLD = 0.50
FALLBACK_CONF_THRESHOLD = 0.38
DEFAULT_TOP_N = 30
FALLBACK_TOP_N = 15

_KEY_SEP = "\u0001"  # joins sorted items into a lookup key


def item_counts(df: DataFrame, item: str = "skill", key: str = "job_id", weight: str | None = None) -> DataFrame:
    """(job_id, item, k): mentions of each item per job, a partial aggregate
    (a hot job is reduced per task before the shuffle)."""
    return (df.filter(F.col(item).isNotNull())
              .groupBy(F.col(key).alias("job_id"), F.col(item).alias("item"))
              .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("k")))


def baskets_from_counts(per_item: DataFrame, min_len: int = 2) -> DataFrame:
    """(job_id, n_items, items) from ``item_counts``; n_items counts repeats."""
    return (per_item.groupBy("job_id")
                    .agg(F.sum("k").alias("n_items"), F.sort_array(F.collect_list("item")).alias("items"))
                    .filter(F.col("n_items") >= min_len))


def baskets(df: DataFrame, item: str = "skill", key: str = "job_id", min_len: int = 2) -> DataFrame:
    """(job_id, n_items, items) -- n_items counts repeats, items are the
    sorted distinct items; jobs with n_items < min_len are dropped."""
    return baskets_from_counts(item_counts(df, item, key), min_len)


def basket_stats(df: DataFrame, item: str = "skill", key: str = "job_id", min_len: int = 2) -> DataFrame:
    """Jobs, mean list length over all jobs, and jobs with >= min_len items."""
    per_job = (df.filter(F.col(item).isNotNull()).groupBy(key)
                 .agg(F.count(F.lit(1)).alias("n_items")))
    return per_job.agg(
        F.count(F.lit(1)).alias("jobs"),
        F.avg("n_items").alias("avg_items"),
        F.count(F.when(F.col("n_items") >= min_len, 1)).alias("baskets"),
    )


def mining_baskets(df: DataFrame, top_n: int = DEFAULT_TOP_N, item: str = "skill",
                   key: str = "job_id", min_len: int = 2, weight: str | None = None) -> DataFrame:
    """M1: keep only the top-n items by raw count, then the baskets whose
    filtered list still has >= min_len entries (repeats counted).

    The top-n list and the baskets both come from one (job, item, k)
    aggregate, which is written once, so the input is scanned and joined once."""
    per_item = checkpointed(item_counts(df, item, key, weight))
    top = (per_item.groupBy("item").agg(F.sum("k").alias("mentions"))
                   .orderBy(F.desc("mentions"), F.asc("item")).limit(top_n).select("item"))
    return baskets_from_counts(per_item.join(F.broadcast(top), "item", "left_semi"), min_len)  # top: <= n rows


def onehot(bask: DataFrame, items: list[str]) -> DataFrame:
    """M2: one boolean column per item (explicit pivot values), all-zero
    columns dropped by the caller's item list. Presentation only; mining
    works on the arrays."""
    return bask.select("job_id", *[F.array_contains("items", i).alias(i) for i in items])


def item_presence(bask: DataFrame) -> DataFrame:
    """M2/M3 audit in long form: (item, baskets containing it)."""
    return (bask.select(F.explode("items").alias("item")).groupBy("item")
                .agg(F.count(F.lit(1)).alias("baskets")))


def frequent_itemsets(bask: DataFrame, min_support: float = DEFAULT_MIN_SUPPORT,
                      fallback_support: float | None = FALLBACK_MIN_SUPPORT) -> DataFrame:
    """M4: (items sorted array, n_items, freq, support) with support >= min_support.

    If no itemset reaches ``min_support``, ``fallback_support`` is used (the
    only action here, on the small itemset result). The denominator is every
    basket passed in.
    """
    from pyspark.ml.fpm import FPGrowth

    bask = checkpointed(bask.select("items"))  # read by the count and by each run of FP-growth
    n = F.lit(bask.count())

    def mine(support: float) -> DataFrame:
        model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=1.0).fit(bask)
        found = (model.freqItemsets
                 .select(F.sort_array("items").alias("items"), F.col("freq").cast("bigint").alias("freq"))
                 .withColumn("support", F.col("freq") / n)
                 .filter(F.col("support") >= support)
                 .withColumn("n_items", F.size("items")))
        # The itemsets come from an RDD that would re-run FP-growth at every
        # use (emptiness test, both support lookups of the rules, the tier
        # test). They are few rows: checkpoint them once to the shared folder,
        # which also cuts the lineage back to the baskets.
        return checkpointed(found)

    found = mine(min_support)
    if fallback_support is not None and found.limit(1).count() == 0:
        found = mine(fallback_support)
    return found


def mined_itemsets(df: DataFrame, top_n: int = DEFAULT_TOP_N, retry_top_n: int = FALLBACK_TOP_N,
                   item: str = "skill", key: str = "job_id", weight: str | None = None) -> DataFrame:
    """M1/M4: itemsets of the top-n items; without any, of the top 15; without
    any there too, an error."""
    for n in (top_n, retry_top_n):
        found = frequent_itemsets(mining_baskets(df, n, item, key, weight=weight))
        if found.limit(1).count():
            return found
    raise RuntimeError(f"no itemset reaches a support of {FALLBACK_MIN_SUPPORT}, not with {retry_top_n} items either")


def association_rules(itemsets: DataFrame) -> DataFrame:
    """M5/M7: every rule A -> B from every itemset of size >= 2, with the
    mlxtend metric set (representativity is 1 for complete data).

    Returns antecedents / consequents as sorted ', '-joined text plus the item
    arrays, and antecedent_support, consequent_support, support, confidence,
    lift, representativity, leverage, conviction, zhangs_metric, jaccard,
    certainty, kulczynski.
    """
    sup = itemsets.select(F.array_join("items", _KEY_SEP).alias("k"), F.col("support").alias("s"))
    # the subsets of an itemset are numbered by a distributed range for each
    # size that occurs (at most the item limit), joined on the size
    spark = itemsets.sparkSession
    big = itemsets.filter(F.col("n_items") >= 2)
    sizes = [r["n_items"] for r in big.select("n_items").distinct().collect()]
    masks = spark.createDataFrame([], "mask long, n_items int")
    for k in sizes:
        masks = masks.unionByName(spark.range(1, (1 << k) - 1).select(F.col("id").alias("mask"), F.lit(k).alias("n_items")))
    split = (big.join(masks, "n_items")
                .select("support",
                        F.expr("filter(items, (x, i) -> (shiftright(mask, i) & 1) = 1)").alias("ante"),
                        F.expr("filter(items, (x, i) -> (shiftright(mask, i) & 1) = 0)").alias("cons")))
    a_sup = sup.select(F.col("k").alias("ak"), F.col("s").alias("antecedent_support"))
    c_sup = sup.select(F.col("k").alias("ck"), F.col("s").alias("consequent_support"))
    rules = (split.withColumn("ak", F.array_join("ante", _KEY_SEP))
                  .withColumn("ck", F.array_join("cons", _KEY_SEP))
                  .join(a_sup, "ak").join(c_sup, "ck"))
    return rule_metrics(rules).select(
        F.array_join("ante", ", ").alias("antecedents"),
        F.array_join("cons", ", ").alias("consequents"),
        F.col("ante").alias("antecedent_items"),
        F.col("cons").alias("consequent_items"),
        *RULE_METRICS,
    )


RULE_METRICS = ["antecedent_support", "consequent_support", "support", "confidence", "lift",
                "representativity", "leverage", "conviction", "zhangs_metric", "jaccard",
                "certainty", "kulczynski"]


def rule_metrics(df: DataFrame) -> DataFrame:
    """The metric columns of a rule from its three supports (columns
    ``antecedent_support``, ``consequent_support``, ``support``); the zero
    denominators follow mlxtend (conviction inf, zhang and certainty 0)."""
    s, a, c = F.col("support"), F.col("antecedent_support"), F.col("consequent_support")
    conf = s / a
    leverage = s - a * c
    zden = F.greatest(s * (1 - a), a * (c - s))
    return df.withColumns({
        "confidence": conf,
        "lift": conf / c,
        "representativity": F.lit(1.0),
        "leverage": leverage,
        "conviction": F.when(conf == 1, F.lit(float("inf"))).otherwise((1 - c) / (1 - conf)),
        "zhangs_metric": F.when(zden == 0, F.lit(0.0)).otherwise(leverage / zden),
        "jaccard": s / (a + c - s),
        "certainty": F.when(1 - c == 0, F.lit(0.0)).otherwise((conf - c) / (1 - c)),
        "kulczynski": (s / a + s / c) / 2,
    })


def select_rules(rules: DataFrame,
                 tier1: tuple[float, float] = (DEFAULT_LIFT_THRESHOLD, DEFAULT_CONF_THRESHOLD),
                 tier2: tuple[float, float] = (FALLBACK_LIFT_THRESHOLD, FALLBACK_CONF_THRESHOLD)) -> DataFrame:
    """M6: rules passing tier 1 (lift >= 1.2 and confidence >= 0.50) if any
    do, otherwise those passing tier 2 (lift >= 0.90 and confidence >= 0.38),
    otherwise none. Adds ``tier``. The "any tier-1 rule" test is a scalar
    subquery, so the choice stays inside one lazy plan."""
    t1 = (F.col("lift") >= tier1[0]) & (F.col("confidence") >= tier1[1])
    t2 = (F.col("lift") >= tier2[0]) & (F.col("confidence") >= tier2[1])
    any_t1 = rules.agg(F.max(t1.cast("int"))).scalar()
    use_t1 = F.coalesce(any_t1, F.lit(0)) == 1
    return (rules.filter((use_t1 & t1) | (~use_t1 & t2))
                 .withColumn("tier", F.when(use_t1, F.lit(1)).otherwise(F.lit(2))))


def rule_lift_matrix(rules: DataFrame) -> DataFrame:
    """M8: mean lift per (antecedents, consequents), long form."""
    return rules.groupBy("antecedents", "consequents").agg(F.avg("lift").alias("mean_lift"))


def top_rules(rules: DataFrame, k: int = 10, min_confidence: float | None = None) -> DataFrame:
    """The k highest-lift rules (ties by the rule text) labelled
    'A → B', optionally above a confidence threshold."""
    r = rules if min_confidence is None else rules.filter(F.col("confidence") >= min_confidence)
    order = [F.desc("lift"), F.asc("antecedents"), F.asc("consequents")]
    top = r.orderBy(*order).limit(k)
    return top.select(
        F.row_number().over(Window.orderBy(*order)).alias("rank"),
        F.concat_ws(" → ", "antecedents", "consequents").alias("label"),
        "antecedents", "consequents", "support", "confidence", "lift",
    )


def confidence_range(rules: DataFrame) -> DataFrame:
    """Number of rules and min / max confidence."""
    return rules.agg(F.count(F.lit(1)).alias("rules"),
                     F.min("confidence").alias("min_confidence"),
                     F.max("confidence").alias("max_confidence"))
