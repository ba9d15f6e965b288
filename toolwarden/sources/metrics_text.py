"""Metric table as exposition text (``name{label="value"} number``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HELP = {
    "scans_total": ("counter", "Catalog scans"),
    "tools_scanned_total": ("counter", "Tools scanned"),
    "tools_blocked_total": ("counter", "Tools blocked"),
    "tools_warned_total": ("counter", "Tools with a warning"),
    "tools_safe_total": ("counter", "Safe tools"),
    "detections_total": ("counter", "Detections by detector"),
    "response_findings_total": ("counter", "Response findings by type"),
    "risk_score_bucket": ("gauge", "Risk scores up to a bound"),
    "scan_duration_seconds_avg": ("gauge", "Average of the latest scan durations"),
    "scan_duration_seconds_max": ("gauge", "Maximum of the latest scan durations"),
    "scan_duration_seconds_count": ("gauge", "Number of the latest scan durations"),
    "kill_switch_enabled": ("gauge", "Whether the kill switch is on"),
    "kill_switch_activations_total": ("counter", "Writes that switched the kill switch on"),
    "policy_overrides_total": ("counter", "Policy decisions to block or allow"),
    "semantic_scans_total": ("counter", "Semantic scans"),
    "semantic_detections_total": ("counter", "Malicious verdicts"),
    "semantic_cache_hits_total": ("counter", "Verdicts served from the store"),
}


#: Times are written with six digits, whole ones too.
SECONDS = ("scan_duration_seconds_avg", "scan_duration_seconds_max")


def _escaped(label: Column) -> Column:
    """A label value as the text format wants it: it cannot end its line or its quotes."""
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        label = F.replace(label, F.lit(raw), F.lit(shown))
    return label


def metric_lines(metrics: DataFrame, prefix: str = "toolwarden_") -> DataFrame:
    """Lines in order: per metric HELP, TYPE, then the samples by label.

    ``prefix`` goes before every name; set it to the one your dashboards use.
    Columns: ``name``, ``part`` (0 help, 1 type, 2 sample), ``sample``, ``line``.
    """
    value = F.col("value")
    seconds = F.col("name").isin(*SECONDS)
    whole = (value == F.floor(value)) & ~seconds
    number = F.when(whole, value.cast("bigint").cast("string")).otherwise(
        F.format_string("%.6f", value)
    )
    pairs = F.transform(
        F.array_sort(F.map_entries("labels")),
        lambda e: F.concat(e.key, F.lit('="'), _escaped(e.value), F.lit('"')),
    )
    labels = F.when(
        F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    ).otherwise(F.lit(""))
    name = F.concat(F.lit(prefix), F.col("name"))
    samples = metrics.select(
        "name", labels.alias("sample"), F.concat(name, labels, F.lit(" "), number).alias("line")
    )
    # The first sample of a name brings its HELP and TYPE, so the metrics are computed once.
    first = F.row_number().over(Window.partitionBy("name").orderBy("sample", "line")) == 1
    described = metrics.sparkSession.createDataFrame(
        [
            (n, f"# HELP {prefix}{n} {text}", f"# TYPE {prefix}{n} {kind}")
            for n, (kind, text) in HELP.items()
        ],
        "name STRING, _help STRING, _type STRING",
    )

    def part(number: int, sample: Column, line: Column) -> Column:
        return F.struct(F.lit(number).alias("part"), sample.alias("sample"), line.alias("line"))

    own = F.array(part(2, F.col("sample"), F.col("line")))
    head = F.array(part(0, F.lit(""), F.col("_help")), part(1, F.lit(""), F.col("_type")))
    return (
        samples.withColumn("_first", first)
        .join(F.broadcast(described), "name", "left")
        .select("name", F.inline(F.when(F.col("_first") & F.col("_help").isNotNull(), F.concat(head, own)).otherwise(own)))
    )


def write_metrics(metrics: DataFrame, path: str, prefix: str = "toolwarden_") -> None:
    """Write the exposition text; its size is the number of metrics."""
    lines = metric_lines(metrics, prefix).orderBy("name", "part", "sample")
    lines.select("line").coalesce(1).write.mode("overwrite").text(path)
