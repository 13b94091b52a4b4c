"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   folder of the sample tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default: all)
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from pubweave.plans.queries import all_queries

HEADLINES = [
    "classify_papers",
    "keyword_scores",
    "tag_share",
    "top_words",
    "top_words_html",
    "top_words_by_tag",
    "clean_text",
    "staged_publications",
    "corpus_filter",
    "search_regex",
    "load_all_filters",
    "load_limit",
    "papers_by_day",
    "papers_by_weekday",
    "top_authors",
    "newest_per_key",
    "upsert_merge",
    "upsert_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pubweave-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        # Plans are built call by call; recording every call site doubles that.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    chosen = sys.argv[1:] or HEADLINES

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    # The first run of a query compiles its code; the better of two later ones counts.
    times = {}
    for name in chosen:
        run(name)
        times[name] = round(min(run(name), run(name)), 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
