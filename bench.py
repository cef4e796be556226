"""Time the headline queries and print one JSON line.

Each query runs once to warm up and then three times into a sink that takes every row; the median
counts. Building the plan is part of the time.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from rosterline.catalog import QUERIES
from rosterline.session import build_session

HEADLINE = (
    "norm_url", "norm_name", "normalize_records", "numeric_coerce", "classify_keywords", "classify_counts",
    "filter_all", "search_columns", "fill_blanks", "merge_sources", "first_rows", "fill_back", "remaining_work",
    "merge_exact_documents", "merge_exact_key", "merge_fuzzy", "merge_domain", "deduplicate",
    "completeness", "detail_json", "finish_directory", "state_table", "overview", "value_counts_top",
    "token_counts", "coverage", "per_capita", "contacts_from_text", "site_details", "enrich_from_pages",
    "enrich_from_results", "financial_documents", "strategy_report", "directory_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("OFF")
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
