"""Headline-query timings.

Runs the flagship and a spread of relational, feature, statistics and metric
queries on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line:
{"metric": ..., "value": total seconds, "unit": "sec", "queries": {...}, "sf": ...}

Each query is fully materialised with the ``noop`` sink: all rows are computed
on the executors and nothing is collected to the driver.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from touchline.plans import registry  # noqa: E402
from touchline.session import get_session  # noqa: E402

HEADLINE = [
    "fitted_groupby_then_mean", "pass_geometry", "derive_features", "groupby_then_median",
    "groupby_then_rank", "combine", "transductive_features", "describe_numeric", "mutual_info_binned",
    "stratified_folds", "roc_auc", "roc_curve", "classification_metrics", "calibration_curve",
    "metric_by_experiment", "generalisation_error", "avg_position_lineup", "possession_points",
    "kde_grid", "gmm_pdf_grid", "stage1_scores", "candidate_features", "inference_frame", "fold_assignment", "gbt_fit_predict",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    registry.load_all()
    names = [n for n in HEADLINE if n in registry.QUERIES]
    # warm-up: JVM, codegen and file listing
    registry.QUERIES["scan_passes"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        df = registry.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_seconds_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
