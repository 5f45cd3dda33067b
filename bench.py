"""Time the headline queries and print one JSON line.

BENCH_SF_DIR selects the data (default sf0.1), BENCH_CPUS the local cores. Every query is run to
the end into Spark's ``noop`` sink; the reported time is the better of two runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridlapse.session import local_session  # noqa: E402
from workload.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "pdu_training_table",
    "pdu_training_table_exact",
    "usage_rollup",
    "flex_windows",
    "task_trace",
    "task_states",
    "flex_windows_from_trace",
    "join_flex_features",
    "rank_pdu_candidates",
    "build_features",
    "chronological_split",
    "sequence_windows",
    "fit_standardizer",
    "regression_metrics",
    "ensemble_mean",
    "sequence_regressor",
    "fit_and_score",
)
ONCE = {"fit_and_score", "sequence_regressor"}


def timed(spark, query, directory: str) -> float:
    start = time.perf_counter()
    query(spark, directory).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cores, 8, "bench", **{"spark.driver.memory": "12g"})
    spark.read.parquet(f"{directory}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in wanted:
        rounds = 1 if name in ONCE else 2
        seconds[name] = round(min(timed(spark, QUERIES[name], directory) for _ in range(rounds)), 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(directory.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
                "cpus": int(cores) if cores.isdigit() else cores,
            }
        )
    )


if __name__ == "__main__":
    main()
