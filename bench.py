"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pedalgrid.plans import QUERIES
from pedalgrid.session import discard, local_session

HEADLINE = [
    "coverage_curve",
    "nearest_distance",
    "point_in_polygon",
    "overlay_area",
    "areal_interpolation",
    "components",
    "tolerance_sweep",
    "key_polygon_distance",
    "projection_length",
    "zone_mart",
    "commune_mart",
    "scope_kpi",
    "mode_reconstruct",
    "crosstab_share",
    "distance_bands",
    "weighted_median",
    "travel_times",
    "nse_gradient_within",
    "equity_gap",
    "class_breaks",
    "rank_correlation",
    "key_resolution",
    "clean_text_key",
    "declared_vs_measured",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, 8)
    spark.sparkContext.setLogLevel("ERROR")
    # start the executors and code generation before the clock runs
    QUERIES["type_breakdown"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    discard(spark)
    spark.stop()


if __name__ == "__main__":
    main()
