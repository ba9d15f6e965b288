"""Append-only audit log: JSON lines, partitioned by UTC day.

A server may list any number of tools, so an entry is not one nested document:
``reports/`` holds one line per scanned server and ``results/`` one line per
tool, tied together by ``scan_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toolwarden import rules as R
from toolwarden import schemas
from toolwarden.operators.scoring import scan_report

REPORTS, RESULTS = "reports", "results"


def audit_results(scanned: DataFrame) -> DataFrame:
    """Audit lines of the scanned tools (``scan_id``, ``timestamp`` in the input)."""
    return scanned.select(
        "scan_id",
        "timestamp",
        "server_name",
        "tool_name",
        "risk_score",
        "risk_level",
        "blocked",
        "detections",
        F.to_date("timestamp").alias("date"),
    )


def audit_reports(
    scanned: DataFrame,
    warn_threshold: int | Column = R.WARN_THRESHOLD,
    identity: Column | None = None,
) -> DataFrame:
    """Audit lines of the scans.  The identity belongs to a scan, so any of its rows has it;
    it is absent from a line without one."""
    keys = ("scan_id", "timestamp", "server_name")
    report = scan_report(scanned, warn_threshold, keys)
    if identity is not None:
        # A map cannot be compared; its entries can, and are the same in all rows of a scan.
        entries = F.array_sort(F.map_entries(identity))
        of = scanned.groupBy(*keys).agg(F.max(entries).alias("_entries"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
        of = of.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_entries")
        report = report.join(of, same, "left").drop(*[f"_of_{k}" for k in keys])
        report = report.withColumn(
            "gateway_identity", F.when(F.size("_entries") > 0, F.map_from_entries("_entries"))
        ).drop("_entries")
    return report.withColumn("date", F.to_date("timestamp"))


def append_audit(lines: DataFrame, path: str) -> None:
    """Append JSON lines to the day folders.  Null fields are left out."""
    lines.write.mode("append").partitionBy("date").json(path)


def log_scan(scanned: DataFrame, path: str, identity: Column | None = None) -> None:
    """Append reports and results of a scan."""
    append_audit(audit_results(scanned), f"{path}/{RESULTS}")
    append_audit(audit_reports(scanned, identity=identity), f"{path}/{REPORTS}")


def read_audit(spark: SparkSession, path: str, kind: str = REPORTS) -> DataFrame:
    """Read the log back; a filter on ``date`` prunes day folders."""
    schema = schemas.AUDIT_REPORT if kind == REPORTS else schemas.AUDIT_RESULT
    return spark.read.schema(schema).json(f"{path}/{kind}")


def audit_history(results: DataFrame, reports: DataFrame) -> DataFrame:
    """Counters recomputed from the log, per day."""
    totals = reports.groupBy("date").agg(
        F.count("*").alias("total_scans"),
        F.sum("total_tools").alias("total_tools_scanned"),
        F.sum("tools_blocked").alias("total_tools_blocked"),
    )
    found = results.groupBy("date").agg(F.sum(F.size("detections")).alias("detections"))
    return totals.join(found, "date", "left")
