"""Times the headline queries: one JSON line on standard output.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES
(names, comma separated) and BENCH_REPEAT (default 2, the best run counts).
"""

from __future__ import annotations

import json
import os
import sys
import time

from gatelight.catalog import load
from gatelight.session import local_session

HEADLINE = [
    "s3_change_detection", "a1_folder_match", "v1_chunk_text", "v5_sparse_vector", "x1_generation_switch", "x7_access_propagation",
    "r1_dense_top_k", "r2_sparse_top_k", "r6_hybrid_retrieve", "h5_resolved_sources", "m7_percentile", "m13_question_evaluation",
    "n15_question_score", "n21_compare", "s9_merged_range_fill", "st2_settle_debounce", "st3_login_lockout",
    "n2_nugget_validation", "n24_worst_questions", "m18_rerank_on_off", "m19_dataset_checks", "x1_staged_generation",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = local_session("gatelight-bench", cpus, shuffle_partitions=int(cpus))
    queries = load()
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(repeat):
            started = time.perf_counter()
            # The whole result is produced, none of it is kept.
            queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - started
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
