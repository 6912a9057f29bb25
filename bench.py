"""Benchmark: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (the whole plan runs,
nothing is collected to the driver) after one warm-up query. Prints one JSON
line: {"metric", "value" (sum of query seconds), "unit", "queries", "sf", ...}.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default all), BENCH_REPEAT (default 1; the median
is reported when > 1).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "1")))
    os.environ["BENCH_CPUS"] = cpus

    from demandlens import plans
    from demandlens.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bench-"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(plans.REGISTRY)

    def run(name: str) -> float:
        t0 = time.perf_counter()
        plans.REGISTRY[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run("annual_share")  # warm-up: JVM, codegen, file listing caches

    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        try:
            times[name] = round(statistics.median(run(name) for _ in range(repeat)), 3)
        except Exception as exc:  # keep benchmarking the rest
            errors[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
        "n_queries": len(times),
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
