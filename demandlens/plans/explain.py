"""Plan review: print a registered query's formatted physical plan and a
summary of its shuffles, broadcasts, sort-merge joins and pushed filters.

Usage: python -m demandlens.plans.explain [sf_dir] name [name ...]
"""

from __future__ import annotations

import re
import sys


def plan_summary(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition",
                                   plan)),
        "round_robin": plan.count("RoundRobinPartitioning"),
        "broadcasts": plan.count("BroadcastExchange"),
        "sort_merge_joins": plan.count("SortMergeJoin"),
        "scans": plan.count("FileScan parquet"),
        "pushed_filters": len(re.findall(r"PushedFilters: \[[^\]]+\]", plan)),
        "python_udfs": plan.count("BatchEvalPython") + plan.count("ArrowEvalPython"),
    }


def main(argv) -> None:
    from demandlens import plans
    from demandlens.session import build_session
    sf_dir = argv[0] if argv and "/" in argv[0] else "/root/testdata/sf0.1"
    names = [a for a in argv if "/" not in a] or list(plans.REGISTRY)
    spark = build_session()
    for name in names:
        df = plans.REGISTRY[name].build(spark, sf_dir)
        print(f"===== {name}")
        df.explain("formatted")
        print(name, plan_summary(df), flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
