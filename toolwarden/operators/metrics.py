"""Counters, histograms, rates and the metric table.

All of them are aggregates with partial aggregation; the metric table explodes
each scanned row into the metrics it counts for, so one pass over the scan
yields every counter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolwarden import rules as R

BUCKETS = ("0_25", "26_50", "51_75", "76_100")


def detections_by_pattern(scanned: DataFrame) -> DataFrame:
    """Matched detections per detector."""
    return (
        scanned.select(F.explode("detections.pattern_name").alias("pattern_name"))
        .groupBy("pattern_name")
        .agg(F.count("*").alias("detections"))
    )


def findings_by_type(scanned: DataFrame) -> DataFrame:
    """Findings per type."""
    return (
        scanned.select(F.explode("findings.finding_type").alias("finding_type"))
        .groupBy("finding_type")
        .agg(F.count("*").alias("findings"))
    )


def response_totals(scanned: DataFrame) -> DataFrame:
    return scanned.agg(
        F.count("*").alias("total_scans"),
        F.coalesce(F.sum(F.size("findings")), F.lit(0)).alias("total_findings"),
    )


def scan_totals(reports: DataFrame, policy_blocked: str | None = None) -> DataFrame:
    """Totals over scan reports; policy-blocked tools count as scanned and blocked."""
    extra = F.col(policy_blocked) if policy_blocked else F.lit(0)

    def total(column: Column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))

    return reports.agg(
        F.count("*").alias("scans"),
        total(F.col("total_tools") + extra).alias("tools_scanned"),
        total(F.col("tools_blocked") + extra).alias("tools_blocked"),
        total(F.col("tools_warned")).alias("tools_warned"),
        total(F.col("tools_safe")).alias("tools_safe"),
    )


def score_bucket(score: Column) -> Column:
    bucket = F.lit(BUCKETS[-1])
    for bound, name in reversed(list(zip(R.SCORE_BUCKETS[:-1], BUCKETS[:-1]))):
        bucket = F.when(score <= bound, name).otherwise(bucket)
    return bucket


def risk_histogram(scanned: DataFrame) -> DataFrame:
    """Tools per score bucket, empty buckets included; one aggregation."""
    score = F.col("risk_score")
    counts = scanned.agg(
        *[F.count_if(score_bucket(score) == name).alias(name) for name in BUCKETS]
    )
    rows = F.array(
        *[F.struct(F.lit(n).alias("bucket"), F.col(n).alias("tools")) for n in BUCKETS]
    )
    return counts.select(F.inline(rows))


def risk_cumulative(histogram: DataFrame) -> DataFrame:
    """Cumulative counts by upper bound, up to ``+Inf``."""
    order = F.when(F.lit(False), F.lit(0))
    bound = F.lit("100")
    for i, name in enumerate(BUCKETS):
        order = order.when(F.col("bucket") == name, i)
        bound = F.when(F.col("bucket") == name, str(R.SCORE_BUCKETS[i])).otherwise(bound)
    running = Window.orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounded = (
        histogram.withColumn("_i", order)
        .withColumn("le", bound)
        .withColumn("cumulative_tools", F.sum("tools").over(running))
        .select("le", "cumulative_tools")
    )
    total = histogram.agg(F.sum("tools").alias("cumulative_tools")).select(
        F.lit("+Inf").alias("le"), "cumulative_tools"
    )
    return bounded.unionByName(total)


def latest_durations(
    durations: DataFrame, samples: int = R.DURATION_SAMPLES, tie: str = "request_id"
) -> DataFrame:
    """Average, maximum and number of the latest scan durations in seconds."""
    latest = durations.orderBy(F.desc("ts"), F.desc(tie)).limit(samples)
    return latest.agg(
        F.avg("duration_seconds").alias("avg_seconds"),
        F.max("duration_seconds").alias("max_seconds"),
        F.count("*").alias("samples"),
    )


def duration_states(durations: DataFrame) -> DataFrame:
    """Dashboard state of the durations in milliseconds."""

    def state(value: Column, warn: int, bad: int) -> Column:
        return F.when(value >= bad, "red").when(value >= warn, "yellow").otherwise("green")

    avg_ms, max_ms = F.col("avg_seconds") * 1000, F.col("max_seconds") * 1000
    return latest_durations(durations).select(
        avg_ms.alias("avg_ms"),
        state(avg_ms, 100, 500).alias("avg_state"),
        max_ms.alias("max_ms"),
        state(max_ms, 200, 1000).alias("max_state"),
    )


def kill_switch_counters(controls: DataFrame, tie: str) -> DataFrame:
    """Current state and number of writes that switched it on."""
    return controls.agg(
        F.coalesce(F.max_by("enabled", F.struct("ts", tie)), F.lit(False)).alias("enabled"),
        F.count_if("enabled").alias("activations"),
    )


def rates_per_minute(scans: DataFrame, step_seconds: int = 5) -> DataFrame:
    """Scans and blocked tools of the trailing minute, per scrape time.

    Rows are counted per step first; only the counts are handed on to the
    scrapes of the following minute."""
    step = step_seconds * 1_000_000
    slot = F.floor(F.unix_micros("ts") / step)
    counts = scans.where("ts IS NOT NULL").groupBy(slot.alias("_slot")).agg(
        F.count("*").alias("_n"), F.coalesce(F.sum("tools_blocked"), F.lit(0)).alias("_blocked")
    )
    ends = F.sequence(F.col("_slot") + 1, F.col("_slot") + 60 // step_seconds)
    return (
        counts.select(F.explode(ends).alias("_end"), "_n", "_blocked")
        .groupBy("_end")
        .agg(F.sum("_n").alias("scans_per_min"), F.sum("_blocked").alias("blocked_per_min"))
        .select(F.timestamp_micros(F.col("_end") * step).alias("scrape_ts"), "scans_per_min", "blocked_per_min")
    )


def _item(name: str, label: Column | None = None, key: str = "") -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        F.lit(key).alias("label_key"),
        (label if label is not None else F.lit("")).alias("label"),
    )


def _labels() -> Column:
    """Label map of a counted row; empty without a label."""
    return F.when(
        F.col("label_key") != "", F.create_map(F.col("label_key"), F.col("label"))
    ).otherwise(F.create_map().cast("map<string,string>"))


_BOUNDS = (*[str(b) for b in R.SCORE_BUCKETS], "+Inf")


def scan_metric_counts(scanned: DataFrame, warn_threshold: int = R.WARN_THRESHOLD) -> DataFrame:
    """Counters of the catalog scan as (name, label_key, label, value), the
    cumulative score buckets among them; one pass over the scan."""
    blocked, score = F.col("blocked"), F.col("risk_score")
    bounds = F.array(
        *[F.when(score <= b, str(b)) for b in R.SCORE_BUCKETS[:-1]],
        *[F.lit(b) for b in _BOUNDS[-2:]],
    )
    items = F.concat(
        F.array(_item("tools_scanned_total"), _item(_PER_SERVER, F.col("server_name"))),
        F.when(blocked, F.array(_item("tools_blocked_total"))).otherwise(F.array()),
        F.when(~blocked & (score >= warn_threshold), F.array(_item("tools_warned_total"))).otherwise(
            F.array()
        ),
        F.when(score < warn_threshold, F.array(_item("tools_safe_total"))).otherwise(F.array()),
        F.transform(F.array_compact(bounds), lambda le: _item("risk_score_bucket", le, "le")),
        F.transform(
            "detections.pattern_name", lambda p: _item("detections_total", p, "pattern")
        ),
    )
    return (
        scanned.select(F.inline(items))
        .groupBy("name", "label_key", "label")
        .agg(F.count("*").alias("value"))
    )


def scan_metrics(scanned: DataFrame, warn_threshold: int = R.WARN_THRESHOLD) -> DataFrame:
    """The catalog counters as ``(name, labels, value)``, with zeros."""
    zeros = scanned.sparkSession.createDataFrame(
        [(name, "", "") for name in _COUNTERS] + [("risk_score_bucket", "le", b) for b in _BOUNDS],
        "name STRING, label_key STRING, label STRING",
    ).withColumn("value", F.lit(0).cast("bigint"))
    # One row per server becomes one scan.
    scan = F.col("name") == _PER_SERVER
    counts = scan_metric_counts(scanned, warn_threshold).select(
        F.when(scan, "scans_total").otherwise(F.col("name")).alias("name"),
        "label_key",
        F.when(scan, "").otherwise(F.col("label")).alias("label"),
        F.when(scan, F.lit(1).cast("bigint")).otherwise(F.col("value")).alias("value"),
    )
    return (
        counts.unionByName(zeros)
        .groupBy("name", "label_key", "label")
        .agg(F.sum("value").cast("double").alias("value"))
        .select("name", _labels().alias("labels"), "value")
    )


_PER_SERVER = "server"
_COUNTERS = (
    "scans_total",
    "tools_scanned_total",
    "tools_blocked_total",
    "tools_warned_total",
    "tools_safe_total",
)


def metrics_table(
    scanned: DataFrame,
    responses: DataFrame,
    controls: DataFrame,
    control_tie: str,
    decided: DataFrame,
    served: DataFrame,
    durations: DataFrame,
) -> DataFrame:
    """All metrics as ``(name, labels, value)``; counters without events are 0."""
    empty_labels = F.create_map().cast("map<string,string>")

    def rows(one_row: DataFrame, **columns: str) -> DataFrame:
        items = F.array(
            *[
                F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("value"))
                for name, c in columns.items()
            ]
        )
        return one_row.select(F.inline(items)).select("name", empty_labels.alias("labels"), "value")

    findings = findings_by_type(responses).select(
        F.lit("response_findings_total").alias("name"),
        F.create_map(F.lit("type"), F.col("finding_type")).alias("labels"),
        F.col("findings").cast("double").alias("value"),
    )
    switch = rows(
        kill_switch_counters(controls, control_tie).withColumn("enabled", F.col("enabled").cast("int")),
        kill_switch_enabled="enabled",
        kill_switch_activations_total="activations",
    )
    overrides = rows(
        decided.agg(F.count_if(F.col("policy.action") != "default").alias("n")),
        policy_overrides_total="n",
    )
    semantic = rows(
        served.agg(
            F.count("*").alias("a"), F.count_if("malicious").alias("b"), F.count_if("cached").alias("c")
        ),
        semantic_scans_total="a",
        semantic_detections_total="b",
        semantic_cache_hits_total="c",
    )
    timing = rows(
        latest_durations(durations).where("samples > 0"),
        scan_duration_seconds_avg="avg_seconds",
        scan_duration_seconds_max="max_seconds",
        scan_duration_seconds_count="samples",
    )
    table = scan_metrics(scanned)
    for part in (findings, timing, switch, overrides, semantic):
        table = table.unionByName(part)
    return table


def _equals(value: str) -> Callable[[Column], Column]:
    return lambda x: x == F.lit(value)


def overall_stats(
    scanned: DataFrame, responses: DataFrame, controls: DataFrame, control_tie: str
) -> DataFrame:
    """Totals, detections, response totals and switch state in one row.

    Each input is reduced to one row in one pass; then the rows are put side by
    side."""

    def counts_map(counts: dict[str, Column]) -> Column:
        pairs = [p for name, n in sorted(counts.items()) for p in (F.lit(name), n)]
        return F.map_filter(F.create_map(*pairs), lambda k, n: n > 0)

    patterns = {
        name: F.count_if(F.array_contains("detections.pattern_name", name))
        for name in (*R.DETECTOR_SEVERITY, R.SEMANTIC)
    }
    types = {
        t: F.coalesce(
            F.sum(F.size(F.filter("findings.finding_type", _equals(t)))), F.lit(0)
        )
        for t in (
            *(f.finding_type for f in (*R.SECRETS, *R.PERSONAL_DATA, *R.DATA_LEAKS)),
            R.JSON_DUMP,
        )
    }
    totals = scanned.agg(
        F.countDistinct("server_name").alias("total_scans"),
        F.count("*").alias("total_tools_scanned"),
        F.count_if("blocked").alias("total_tools_blocked"),
        counts_map(patterns).alias("detections_by_pattern"),
    )
    answers = responses.agg(
        F.count("*").alias("responses_scanned"),
        F.coalesce(F.sum(F.size("findings")), F.lit(0)).alias("response_findings"),
        counts_map(types).alias("findings_by_type"),
    )
    switch = kill_switch_counters(controls, control_tie).select(
        F.col("enabled").alias("kill_switch_enabled")
    )
    one = totals.withColumn("_k", F.lit(1))
    for part in (answers, switch):
        one = one.join(part.withColumn("_k", F.lit(1)), "_k")
    return one.drop("_k")
