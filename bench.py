"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of threads.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from tabscope.plans.catalog import catalog

HEADLINES = [
    "group_sum",
    "kpi_cards",
    "value_counts",
    "chart_histogram",
    "outlier_values",
    "quantiles",
    "histogram_fd",
    "profile",
    "duplicate_rows",
    "duplicate_rows_many_copies",
    "delete_duplicate_row_by_text",
    "distinct_per_column",
    "impute_by_mode",
    "map_join",
    "latest_per_key",
    "page_slice",
    "html_tables",
    "quality_counts",
    "profile_documents",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tabscope-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    made, seconds = catalog(), {}
    for name in sys.argv[1:] or HEADLINES:
        times = []
        for _ in range(runs + 1):  # the first run warms up
            start = time.perf_counter()
            made[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
