"""Headline queries, timed to completion on one folder; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortlens.plans.queries import REGISTRY  # noqa: E402
from cohortlens.session import local_session  # noqa: E402

HEADLINE = [
    "discretize", "clip_percentile", "filter_gradient", "filter_wavelet", "first_order_features", "shape3d",
    "glcm_features", "glrlm_features", "glszm_features", "ngtdm_features", "gldm_features", "regrid_origin",
    "preprocess", "stratified_split", "f_scores", "chi2_scores", "mi_scores", "mrmr_select", "correlation_matrix",
    "run_selection", "knn_predict", "gaussian_nb", "roc_curve", "auc", "metrics_report", "decision_curve",
    "lasso_select", "glszm_cut",
]
WARM_RUNS = int(os.environ.get("BENCH_RUNS", "1"))


def timed(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    timed(spark, "discretize", folder)
    seconds = {n: round(statistics.median(timed(spark, n, folder) for _ in range(WARM_RUNS)), 3) for n in HEADLINE}
    line = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
