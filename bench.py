"""Time the headline queries on ``$BENCH_SF_DIR`` and print one JSON line.

Every query runs twice into the no-op sink; the second, warm run is reported. ``BENCH_QUERIES`` (comma
separated, or ``all``) replaces the default selection.
"""

from __future__ import annotations

import json
import os
import sys
import time

from streamgrid.plans.catalog import QUERIES
from streamgrid.session import build_session

HEADLINE = [
    "grid_fill", "grid_fill_by_user", "grid_fill_bounded", "grid_status_counts", "late_reslot", "vfr_thin",
    "common_origin", "missing_slots", "asof_latest", "relative_drift", "counted_pts", "drift_plan",
    "applied_correction", "gap_segments", "reblock", "interleave", "failure_streaks", "latency_summary",
    "latency_histogram", "snapshot_rates", "occupancy", "loss_rollup", "threshold_breaches", "verdict",
    "dashboard", "conservation", "ranked_candidates", "rule_violations",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "streamgrid-bench",
        master=f"local[{cpus}]",
        conf={
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_warm_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
