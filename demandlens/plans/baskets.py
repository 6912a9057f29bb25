"""Registered queries: co-occurrence, baskets, itemsets and rules (K, A26-A27, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlens.operators import basket, cooccur
from demandlens.plans.inputs import analysis_input, analysis_sql
from demandlens.sources.tables import mentions, mentions_sql
from demandlens.plans.registry import query

M_BRAND = analysis_sql("p_brand", [])
# Baskets keep the raw item text (rules read the items as written).
M_TYPE_RAW = mentions_sql("p_type", [])

PAIRS_SQL = f"""
WITH m AS ({M_BRAND}),
t AS (SELECT skill FROM m WHERE skill IS NOT NULL GROUP BY skill ORDER BY count(*) DESC, skill LIMIT 11),
js AS (SELECT DISTINCT job_id, skill FROM m WHERE skill IN (SELECT skill FROM t))
SELECT a.skill AS skill_a, b.skill AS skill_b, count(*) AS co_occurrence
FROM js a JOIN js b ON a.job_id = b.job_id AND a.skill < b.skill GROUP BY a.skill, b.skill"""

MATRIX_SQL = f"""
WITH m AS ({M_BRAND}),
t AS (SELECT skill FROM m WHERE skill IS NOT NULL GROUP BY skill ORDER BY count(*) DESC, skill LIMIT 11),
p AS ({PAIRS_SQL}),
g AS (SELECT x.skill AS skill_a, y.skill AS skill_b FROM t x, t y)
SELECT g.skill_a, g.skill_b,
       CAST(CASE WHEN g.skill_a = g.skill_b THEN 0 ELSE coalesce(p1.co_occurrence, p2.co_occurrence, 0) END AS BIGINT) AS n
FROM g LEFT JOIN p p1 ON p1.skill_a = g.skill_a AND p1.skill_b = g.skill_b
       LEFT JOIN p p2 ON p2.skill_a = g.skill_b AND p2.skill_b = g.skill_a"""


@query("cooccurrence_pairs", "K1 J7", PAIRS_SQL)
def q_cooccurrence_pairs(spark, sf_dir):
    return cooccur.cooccurrence_pairs(analysis_input(spark, sf_dir, "p_brand", []), top_n=11)


@query("cooccurrence_matrix", "K2", MATRIX_SQL)
def q_cooccurrence_matrix(spark, sf_dir):
    return cooccur.cooccurrence_matrix(analysis_input(spark, sf_dir, "p_brand", []), top_n=11)


@query("matrix_cards", "K3 K4", f"""
WITH mat AS ({MATRIX_SQL}), p AS ({PAIRS_SQL}),
tp AS (SELECT * FROM p ORDER BY co_occurrence DESC, skill_a, skill_b LIMIT 1)
SELECT count(DISTINCT skill_a) AS size, count(CASE WHEN n > 0 THEN 1 END) AS nonzero_cells,
       (SELECT count(*) FROM p) AS pair_rows,
       (SELECT concat_ws(' + ', skill_a, skill_b) FROM tp) AS top_pair,
       (SELECT co_occurrence FROM tp) AS top_pair_count,
       (SELECT count(*) FROM mat m1 FULL JOIN mat m2 ON m1.skill_a = m2.skill_b AND m1.skill_b = m2.skill_a
        WHERE m1.n IS DISTINCT FROM m2.n) = 0 AS symmetric,
       (SELECT count(*) FROM p WHERE co_occurrence > 0) >= 5 AS enough_pairs
FROM mat""")
def q_matrix_cards(spark, sf_dir):
    df = analysis_input(spark, sf_dir, "p_brand", [])
    return cooccur.matrix_cards(*cooccur.matrix_and_pairs(df, 11))


@query("cooccurrence_top_pairs", "K3", f"""
WITH p AS ({PAIRS_SQL})
SELECT CAST(row_number() OVER (ORDER BY co_occurrence DESC, skill_a, skill_b) AS INTEGER) AS rank,
       concat_ws(' + ', skill_a, skill_b) AS skill_pair, co_occurrence
FROM p ORDER BY co_occurrence DESC, skill_a, skill_b LIMIT 15""")
def q_cooccurrence_top_pairs(spark, sf_dir):
    return cooccur.top_pairs(cooccur.cooccurrence_pairs(analysis_input(spark, sf_dir, "p_brand", []), top_n=11))


@query("baskets", "A26", f"""
WITH m AS ({M_TYPE_RAW})
SELECT job_id, count(*) AS n_items, CAST(count(DISTINCT skill) AS INTEGER) AS n_distinct,
       array_to_string(list_sort(list(DISTINCT skill)), ', ') AS items
FROM m WHERE skill IS NOT NULL GROUP BY job_id HAVING count(*) >= 2""")
def q_baskets(spark, sf_dir):
    b = basket.baskets(mentions(spark, sf_dir, "p_type", []))
    return b.select("job_id", "n_items", F.size("items").alias("n_distinct"),
                    F.array_join("items", ", ").alias("items"))


@query("basket_stats", "A27", f"""
WITH m AS ({M_TYPE_RAW}),
j AS (SELECT job_id, count(*) AS n_items FROM m WHERE skill IS NOT NULL GROUP BY job_id)
SELECT count(*) AS jobs, avg(n_items) AS avg_items, count(CASE WHEN n_items >= 2 THEN 1 END) AS baskets FROM j""")
def q_basket_stats(spark, sf_dir):
    return basket.basket_stats(mentions(spark, sf_dir, "p_type", []))


MINING_SQL = f"""
m AS ({M_TYPE_RAW}),
t AS (SELECT skill FROM m WHERE skill IS NOT NULL GROUP BY skill ORDER BY count(*) DESC, skill LIMIT 30),
k AS (SELECT job_id, skill FROM m WHERE skill IN (SELECT skill FROM t)),
b AS (SELECT job_id, list_sort(list(DISTINCT skill)) AS items FROM k GROUP BY job_id HAVING count(*) >= 2),
nb AS (SELECT count(*) AS n FROM b),
sub AS (SELECT list_filter(items, lambda x, i: ((mask >> (i - 1)) & 1) = 1) AS s
        FROM (SELECT items, unnest(range(1, (1 << len(items)))) AS mask FROM b)),
c AS (SELECT s, count(*) AS freq FROM sub GROUP BY s),
th AS (SELECT CASE WHEN max(freq) / (SELECT n FROM nb) >= 0.05 THEN 0.05 ELSE 0.03 END AS ms FROM c),
f AS (SELECT s, freq, freq / (SELECT n FROM nb) AS support FROM c WHERE freq / (SELECT n FROM nb) >= (SELECT ms FROM th))"""


@query("item_presence", "M3", f"""
WITH {MINING_SQL}
SELECT unnest(items) AS item, count(*) AS baskets FROM b GROUP BY item""")
def q_item_presence(spark, sf_dir):
    return basket.item_presence(basket.mining_baskets(mentions(spark, sf_dir, "p_type", [])))


@query("item_presence_top", "M1", f"""
WITH m AS ({mentions_sql("p_name", [])}),
t AS (SELECT skill FROM m WHERE skill IS NOT NULL GROUP BY skill ORDER BY count(*) DESC, skill LIMIT 30),
k AS (SELECT job_id, skill FROM m WHERE skill IN (SELECT skill FROM t)),
b AS (SELECT job_id, list(DISTINCT skill) AS items FROM k GROUP BY job_id HAVING count(*) >= 2)
SELECT unnest(items) AS item, count(*) AS baskets FROM b GROUP BY item""")
def q_item_presence_top(spark, sf_dir):
    """More items than the limit of 30, so the restriction leaves some out."""
    return basket.item_presence(basket.mining_baskets(mentions(spark, sf_dir, "p_name", [])))


@query("onehot_baskets", "M2", f"""
WITH {MINING_SQL}
SELECT job_id, list_contains(items, 'ECONOMY') AS "ECONOMY", list_contains(items, 'SMALL') AS "SMALL" FROM (
  SELECT job_id, list(DISTINCT skill) AS items FROM k GROUP BY job_id HAVING count(*) >= 2)""")
def q_onehot_baskets(spark, sf_dir):
    return basket.onehot(basket.mining_baskets(mentions(spark, sf_dir, "p_type", [])), ["ECONOMY", "SMALL"])


@query("frequent_itemsets", "M4", f"""
WITH {MINING_SQL}
SELECT array_to_string(s, ', ') AS items, CAST(len(s) AS INTEGER) AS n_items, freq, support FROM f""")
def q_frequent_itemsets(spark, sf_dir):
    its = basket.mined_itemsets(mentions(spark, sf_dir, "p_type", []))
    return its.select(F.array_join("items", ", ").alias("items"), "n_items", "freq", "support")


RULES_SQL = f"""
WITH {MINING_SQL},
r AS (SELECT s, support, unnest(range(1, (1 << len(s)) - 1)) AS mask FROM f WHERE len(s) >= 2),
x AS (SELECT support,
             list_filter(s, lambda x, i: ((mask >> (i - 1)) & 1) = 1) AS ante,
             list_filter(s, lambda x, i: ((mask >> (i - 1)) & 1) = 0) AS cons FROM r),
j AS (SELECT x.*, fa.support AS a, fc.support AS c FROM x
      JOIN f fa ON array_to_string(fa.s, chr(1)) = array_to_string(x.ante, chr(1))
      JOIN f fc ON array_to_string(fc.s, chr(1)) = array_to_string(x.cons, chr(1))),
rr AS (SELECT array_to_string(ante, ', ') AS antecedents, array_to_string(cons, ', ') AS consequents,
              a AS antecedent_support, c AS consequent_support, support,
              support / a AS confidence, support / a / c AS lift, 1.0::DOUBLE AS representativity,
              support - a * c AS leverage,
              CASE WHEN support / a = 1 THEN 'inf'::DOUBLE ELSE (1 - c) / (1 - support / a) END AS conviction,
              CASE WHEN greatest(support * (1 - a), a * (c - support)) = 0 THEN 0.0
                   ELSE (support - a * c) / greatest(support * (1 - a), a * (c - support)) END AS zhangs_metric,
              support / (a + c - support) AS jaccard,
              CASE WHEN 1 - c = 0 THEN 0.0 ELSE (support / a - c) / (1 - c) END AS certainty,
              (support / a + support / c) / 2 AS kulczynski FROM j),
t1 AS (SELECT coalesce(max(CASE WHEN lift >= 1.2 AND confidence >= 0.5 THEN 1 ELSE 0 END), 0) AS any1 FROM rr),
sel AS (SELECT rr.*, CASE WHEN (SELECT any1 FROM t1) = 1 THEN 1 ELSE 2 END AS tier FROM rr
        WHERE ((SELECT any1 FROM t1) = 1 AND lift >= 1.2 AND confidence >= 0.5)
           OR ((SELECT any1 FROM t1) = 0 AND lift >= 0.9 AND confidence >= 0.38))"""


def _rules(spark, sf_dir):
    return basket.select_rules(basket.association_rules(basket.mined_itemsets(mentions(spark, sf_dir, "p_type", []))))


@query("association_rules", "M6 M7", RULES_SQL + " SELECT * FROM sel")
def q_association_rules(spark, sf_dir):
    return _rules(spark, sf_dir).drop("antecedent_items", "consequent_items")


@query("all_rules", "M5", RULES_SQL + " SELECT * FROM rr")
def q_all_rules(spark, sf_dir):
    """Every rule of every itemset, several items on either side included."""
    its = basket.mined_itemsets(mentions(spark, sf_dir, "p_type", []))
    return basket.association_rules(its).drop("antecedent_items", "consequent_items")


@query("rule_lift_matrix", "M8", RULES_SQL + """
SELECT antecedents, consequents, avg(lift) AS mean_lift FROM sel GROUP BY antecedents, consequents""")
def q_rule_lift_matrix(spark, sf_dir):
    return basket.rule_lift_matrix(_rules(spark, sf_dir))


@query("top_rules", "M9", RULES_SQL + """
SELECT CAST(row_number() OVER (ORDER BY lift DESC, antecedents, consequents) AS INTEGER) AS rank,
       concat_ws(' → ', antecedents, consequents) AS label, antecedents, consequents, support, confidence, lift
FROM sel ORDER BY lift DESC, antecedents, consequents LIMIT 10""")
def q_top_rules(spark, sf_dir):
    return basket.top_rules(_rules(spark, sf_dir), k=10)


@query("rules_above_confidence", "M10", RULES_SQL + """
SELECT CAST(row_number() OVER (ORDER BY lift DESC, antecedents, consequents) AS INTEGER) AS rank,
       concat_ws(' → ', antecedents, consequents) AS label, antecedents, consequents, support, confidence, lift
FROM rr WHERE confidence >= 0.4 ORDER BY lift DESC, antecedents, consequents LIMIT 10""")
def q_rules_above_confidence(spark, sf_dir):
    its = basket.mined_itemsets(mentions(spark, sf_dir, "p_type", []))
    return basket.top_rules(basket.association_rules(its), k=10, min_confidence=0.4)


@query("confidence_range", "M10", RULES_SQL + """
SELECT count(*) AS rules, min(confidence) AS min_confidence, max(confidence) AS max_confidence FROM sel""")
def q_confidence_range(spark, sf_dir):
    return basket.confidence_range(_rules(spark, sf_dir))
