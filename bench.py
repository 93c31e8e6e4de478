"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ragspark import build_session  # noqa: E402
from ragspark.queries import QUERIES  # noqa: E402

HEADLINE = [
    "answer_contexts", "embed_chunks", "chunk_documents", "chunk_small_windows", "vector_knn_all", "vector_knn_grid",
    "vector_topk", "window_weighted_mean", "wordpiece_windows", "basic_pretokens", "id_windows", "incremental_ingest",
    "resume_points", "catalog_diff", "history_budget", "user_prompt", "bind_citations", "stream_fold_answer",
    "web_normalise", "transfer_plan", "transfer_reduce", "pause_fence", "progress_steps", "debounce",
    "dedup_consecutive", "speech_runs", "vad_segments", "latest_wins", "ocr_overlay", "persona_upsert",
    "embed_windows", "stored_search",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        # the first run compiles the plan's code and starts Python workers; the second is the measurement
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
