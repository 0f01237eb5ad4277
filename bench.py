"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Every
query is run whole, to its last row, RUNS times after one warm-up; the best time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from liftgrid.session import build_session  # noqa: E402
from workload.queries import all_queries  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3
HEADLINE = [
    "clean_events", "cleaning_report", "user_features", "user_features_orders",
    "favorite_category", "assign_users", "insert_if_absent", "srm_check", "conversion_rate",
    "all_metrics", "all_metrics_orders", "segment_metrics", "daily_conversion", "z_test",
    "z_test_orders", "welch_t_test_orders", "novelty", "corrections_bh", "power_analysis",
    "mde_curve", "prob_treatment_better", "expected_loss", "ipw_conversion", "ipw_t_test",
    "covariate_balance", "rank_auc", "propensity_scores", "ipw_end_to_end", "decision_view",
    "analyze",
]


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{CPUS}]",
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            run(queries[name](spark, SF_DIR))
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:]), 3)
    scale = Path(SF_DIR).name.removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
