"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; one JSON line.

Every query runs to a sink that reads all columns; the time is the best of the
measured runs after one warm-up run, planning included.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from workload.queries import queries  # noqa: E402

HEADLINE = (
    "scan_tools",
    "scan_report",
    "filter_catalog",
    "policy_decide",
    "enforce_catalog",
    "scan_responses",
    "redact_responses",
    "verdict_dedup",
    "metrics_table",
    "trusted_source",
    "session_validity",
    "correlate_replies",
    "rate_scans_per_min",
    "stream_scan_catalog",
)
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def timed(run) -> tuple[float, float]:
    """Seconds in all, and seconds until the plan is ready (work that a query does while it is
    built counts as planning)."""
    start = time.perf_counter()
    df = run()
    df._jdf.queryExecution().executedPlan()
    planned = time.perf_counter() - start
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start, planned


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    seconds, planning = {}, {}
    for name in names:
        def run(name=name):
            return registered[name](spark, sf_dir)

        timed(run)
        best = min(timed(run) for _ in range(RUNS))
        seconds[name], planning[name] = round(best[0], 3), round(best[1], 3)
    size = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
        "count(*) AS docs", "sum(octet_length(text)) / 1e6 AS mb"
    ).first()
    result = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float((re.search(r"sf([0-9.]+)", sf_dir) or [0, "0"])[1]),
    }
    if "scan_tools" in seconds:
        running = max(seconds["scan_tools"] - planning["scan_tools"], 1e-3)
        result["scan_tools_rows_per_sec"] = round(size["docs"] / seconds["scan_tools"])
        result["scan_tools_mb_per_sec_running"] = round(size["mb"] / running, 2)
    result["planning"] = planning
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
