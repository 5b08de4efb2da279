"""Headline queries on the test tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "topk_unusual", "scan_summary", "expected_move", "trend_contextual", "label_trades", "features", "path_outcome", "dedup_12h",
    "fit_cell_quantiles", "ks_two_sample", "feature_distribution", "walkforward_predict", "sweep",
)


def main() -> None:
    from flowlens.plans.queries import QUERIES
    from flowlens.session import get_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", int(cpus), "bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not measured
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("/sf", 1)[-1]}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
