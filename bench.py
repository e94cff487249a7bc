"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 1, median after
one warm-up run), BENCH_QUERIES (comma list, default the headline set).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "board_ranked", "board_next_k", "board_urgency", "board_filtered", "saved_filter_matches", "facets_all", "upcoming_counts",
    "calendar_month", "calendar_preview", "province_resolved", "countdown_parts", "deadline_texts",
    "snapshot_diff", "review_queue", "row_fingerprint", "table_digest", "snapshot_hashes", "row_violations", "order_violations",
    "identity_resolution", "import_row_violations", "fact_groups", "repeated_documents", "privacy_findings", "private_texts",
    "benchmark_leaks", "url_normalize", "json_leaves", "school_tiers", "deadline_changes",
    "import_candidate", "stored_snapshot_gate", "alias_coverage", "publication_order", "short_marker_leaks",
)


def main() -> None:
    from checks import registry
    from tidemark.session import local_session

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name] or list(HEADLINE)
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="tidemark-bench")
    spark.sparkContext.setLogLevel("OFF")
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            begin = time.perf_counter()
            # The noop sink computes every column of every row and keeps nothing.
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begin)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({
        "metric": "total_median_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus, "runs": runs, "spark": spark.version,
    }))


if __name__ == "__main__":
    main()
