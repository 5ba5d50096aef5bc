"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Every query is written to Spark's no-op sink, so all rows and columns are
computed. ``queries`` holds the best of two warm runs, ``cold`` the first run.
"""

from __future__ import annotations

import json
import os
import time

from lakewarden.plans import registry
from lakewarden.session import local_session

HEADLINE = (
    "contrast_scores", "contrast_max_chunk", "fold_contrast", "vector_topk", "token_windows", "node_language_summary", "language_distribution", "dedup_keep_best", "mask_emails", "split_stratified", "folds_stratified",
    "update_join_merge", "verdict_parse", "prompt_render", "threshold_at_recall", "confusion_metrics", "average_precision", "threshold_sweep", "flagged_by_conversation", "top_matches",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()
    known, cold, warm = registry.queries(), {}, {}

    def run(name: str) -> float:
        began = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    for name in HEADLINE:
        cold[name] = run(name)
        warm[name] = min(run(name), run(name))
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "sf": os.path.basename(folder.rstrip("/")), "cpus": cpus,
        "contrast_vectors_per_sec": round(vectors / warm["contrast_scores"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
