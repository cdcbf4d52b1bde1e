"""Time the registered queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, and ``BENCH_QUERIES``
(a comma-separated list) limits the run to some queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from workload.queries import QUERIES

# One query per job a user runs, and the costliest single operators.
HEADLINE = [
    "endpoint_impact", "endpoint_consumer_counts", "endpoint_unindexed", "topic_impact",
    "orphans_published_only", "orphans_subscribed_only", "service_status", "path_norm_match",
    "resolve_routes", "fe_wrapper_calls", "fe_consumers_dedup", "py_node_counts",
    "py_event_schemas", "route_full_paths", "publish_schema", "client_calls",
    "client_singleton_calls", "extract_summary", "contract_documents", "save_load_roundtrip",
    "validate_contracts", "contract_drift",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine outside the timing
    times = {}
    for name in chosen.split(",") if chosen else HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "total_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
