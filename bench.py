"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.plans.catalog import queries  # noqa: E402
from millrace.session import build_session  # noqa: E402

HEADLINE = [
    "impute_mean", "coef_variation", "corr_matrix", "box_stats", "group_mode", "majority_hamming",
    "contiguous_folds", "positional_split", "class_report", "auc", "clean_posts", "word_freq", "idf", "tf_idf",
    "chisq_words", "select_top", "doc_freq_substring", "attach_labels", "moving_avg_posts", "forward_return",
    "lag_windows", "acf", "adf_test", "arch_forecast", "garch_fit", "arma_order", "lag_forecast", "kalman_smooth",
    "knn_join", "knn_regress", "smote", "silhouette_squared", "kmeans", "ridge", "lasso", "pcr", "logistic",
    "gaussian_nb", "rf_clf", "boost_reg", "pixels", "palette",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cores=cores, spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    todo = queries()
    spark.read.parquet(f"{folder}/lineitem.parquet").count()  # start-up is not a query
    times = {}
    for name in names:
        start = time.perf_counter()
        todo[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(os.path.basename(folder.rstrip("/")).replace("sf", "") or 0)}))


if __name__ == "__main__":
    main()
