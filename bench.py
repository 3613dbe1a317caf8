"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query is executed in full with the ``noop`` sink (no driver collect).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from areascope.plans import catalog as C  # noqa: E402
from areascope.session import get_session  # noqa: E402

HEADLINE = [
    "build_master", "merge_feeds", "cleaning_report", "numeric_profile", "key_duplicates", "missing_dates",
    "build_features", "analyze_trends", "scale_features", "rank_pct", "state_report", "monthly_summary",
    "district_summary", "growth_class", "pct_change",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    spark = get_session(f"local[{cpus}]", app="areascope-bench", shuffle_partitions=int(cpus) * 2,
                        conf={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    times = {}
    run(C.QUERIES["state_report"](spark, "/root/testdata/sf0.001"))  # JVM warm-up, not timed
    for name in HEADLINE:
        t0 = time.time()
        run(C.QUERIES[name](spark, sf_dir))
        times[name] = round(time.time() - t0, 3)
    # Whole model run (features, k = 3..8 x 10 seeds, silhouettes, forest,
    # ranks, trends, insights), then the five result tables from its checkpoint.
    t0 = time.time()
    result = C.model_result(spark, sf_dir)
    times["model_run"] = round(time.time() - t0, 3)
    t0 = time.time()
    for df in result.tables().values():
        run(df)
    times["model_outputs"] = round(time.time() - t0, 3)
    rows = C.model_result(spark, sf_dir).result.count()
    baseline = {"whole_model_run": 13139.5, "feature_stage": 157.0, "choose_k": 6325.5,
                "isolation_forest": 12.2, "trend_stage": 7.3, "insight_stage": 12.1}
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None, "master_rows": rows,
                      "best_k": result.best_k, "model_stages": result.stage_seconds,
                      "baseline_sec": baseline}))


if __name__ == "__main__":
    main()
