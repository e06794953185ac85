"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 1, after one warm-up).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from shelfmark.session import RECOMMENDED
from suite import registered

HEADLINE = [
    "genre_distribution", "library_stats", "tracks_to_albums", "album_totals", "registry_merge", "store_upsert_tracks",
    "compilation_counters", "normalize_values", "normalize_list", "consistency_statistics", "best_match",
    "tiered_search", "aggregate_votes", "duplicate_pairs", "duplicate_groups", "artist_profiles", "all_suggestions",
    "best_suggestions", "genre_issues", "quality_scores", "processing_candidates", "job_summary", "trailing_rate",
    "changed_fields", "album_status", "browse_page", "stream_job_progress", "full_quality_run", "match_library",
    "reverted_versions", "suggestion_report",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus))
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered()
    wanted = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    times: dict[str, float] = {}
    for name in wanted:
        fn = queries[name][0]

        def once() -> float:
            start = time.perf_counter()
            fn(spark, sf).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - start
        once()
        times[name] = round(statistics.median(once() for _ in range(runs)), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
