"""Times the headline queries and prints one JSON line.

Each query is planned and run in full, its result discarded by the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from quillsift.plans.catalog import QUERIES
from quillsift.session import build_session

HEADLINE = [
    "preprocess_dataset", "statistical_features", "readability_features", "linguistic_features",
    "perplexity_features", "extract_all_features", "class_feature_means", "dedup_exact", "cleaning_funnel",
    "build_dataset", "stratified_folds", "multi_seed_split", "chunk_pages", "tfidf_vocabulary", "tfidf_weights",
    "svd_explained_variance", "feature_histogram", "feature_boxplot", "roc_curve", "model_comparison", "train_lr",
    "cross_validate", "cross_validate_models", "tune_lr", "train_rf", "seed_suite", "model_suite", "detection_report", "stability_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": os.environ.get("BENCH_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="bench-"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
