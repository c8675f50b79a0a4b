"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the local cores.  Each query runs once to warm up and is then timed; the
time covers the whole result, written to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "hybrid_search",
    "search_terms",
    "search_reference",
    "dual_retrieval",
    "nearest_pool_in_blocks",
    "clean_text",
    "document_hash",
    "chunk_cascade",
    "numbered_chunks",
    "recursive_windows",
    "batch_outcomes",
    "ingested_chunks",
    "chunk_store",
    "crawl_documents",
    "faq_chunks",
    "main_text",
    "builtin_main_text",
    "chosen_pages",
    "readiness_status",
    "replayed_runs",
    "grounded_evidence",
    "toggled_todos",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE

    from clauseflow.plans.catalog import QUERIES
    from clauseflow.session import build_session

    spark = build_session(
        "bench", master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(2 * int(cpus)),
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall-clock",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
