"""Headline queries on local cores: ``BENCH_SF_DIR=/path BENCH_CPUS=4 python bench.py`` prints one JSON line.

Every query is written to the no-op sink, so all rows and columns are computed.  Each query runs once
unmeasured to warm the JVM, then ``BENCH_RUNS`` times (default 1) with the median reported.  The given event table is
one row group, which one task would read; the fixture holds the same rows in a file per core, as a table of any size
has.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

HEADLINES = (
    "rate_limit_severity_counts",
    "prj04_alert_records",
    "sig01_sqli_signature",
    "sig03_request_classifier",
    "agg01_entity_windows",
    "agg03_window_deltas",
    "agg16_ten_features",
    "agg17_frequency_profile",
    "agg18_endpoint_distribution",
    "agg23_severity_counts",
    "agg34_sessions",
    "win01_login_brute_force",
    "win02_rate_limit",
    "win03_flood_or_classify",
    "win04_error_rate_spike",
    "win05_multi_window",
    "win07_behavioural_fingerprint",
    "win08_dynamic_threshold",
    "win10_temporal_confirmation",
    "win11_alert_suppression",
    "win13_incidents",
    "fus05_adaptive_hybrid",
    "fus11_weight_grid",
    "jn01_intel_enrichment",
    "gr03_simple_undirected",
    "gr06_neighbour_sampling",
    "st03_drift_report",
    "st10_discrimination_report",
    "evl03_roc_summary",
    "evl17_comparison",
    "ml02_anomaly_scores",
)


def fixture(spark, folder: str, files: int) -> str:
    """The tables of ``folder``, with the events in several files."""
    own = tempfile.mkdtemp(prefix="bench-")
    for name in os.listdir(folder):
        if name != "events.parquet":
            os.symlink(os.path.join(os.path.abspath(folder), name), os.path.join(own, name))
    spark.read.parquet(f"{folder}/events.parquet").repartition(files).write.parquet(f"{own}/events.parquet")
    return own


def main() -> None:
    from pyspark.sql import SparkSession

    from tracewarden.plans import all_queries

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    picked = sys.argv[1:] or HEADLINES
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tracewarden-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-checkpoints-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    name_of_sf = os.path.basename(folder.rstrip("/"))
    folder = fixture(spark, folder, int(cpus))
    events = spark.read.parquet(f"{folder}/events.parquet").count()
    seconds = {}
    for name in picked:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": name_of_sf,
                "events": events,
                "events_per_second": {n: round(events / s) for n, s in seconds.items() if s > 0},
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
