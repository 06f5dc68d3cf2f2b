"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docketry.plans import all_queries  # noqa: E402
from docketry.session import local_session  # noqa: E402

HEADLINE = [
    "rank_positions",
    "precision_recall_at_k",
    "f1_at_k",
    "score_cut_sweep",
    "macro_cut_sweep",
    "rank_cut_sweep",
    "two_step_score_score",
    "two_step_rank_rank",
    "roc_auc",
    "ndcg_at_k",
    "bow",
    "tfidf",
    "stem_vocabulary",
    "cosine_rank",
    "sparse_cosine_rank",
    "bm25_rank",
    "clean_text",
    "summarize",
    "oversample",
    "smote",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    sink(queries["rank_positions"](spark, sf_dir))  # start the JVM's compilers
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        sink(queries[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
