"""Risk score, level, block decision, catalog scan, report and filter."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolwarden import rules as R
from toolwarden.operators.detectors import with_detections
from toolwarden.plans.skew import anti_join_keys, fits_broadcast
from toolwarden.plans.workspace import written


def risk_score(severities: Column) -> Column:
    """Score of an array of matched severities: the highest counts fully, the
    i-th next one by 0.3/i; truncated, at most 100."""
    ordered = F.sort_array(severities, asc=False)
    weighted = F.transform(
        ordered,
        lambda s, i: F.when(i == 0, s.cast("double")).otherwise(s * (F.lit(R.SCORE_DECAY) / i)),
    )
    total = F.aggregate(weighted, F.lit(0.0), lambda a, b: a + b)
    return F.least(total.cast("int"), F.lit(R.MAX_SCORE))


def risk_level(score: Column) -> Column:
    level = F.lit("safe")
    for floor, name in reversed(R.SCORE_LEVELS):
        level = F.when(score >= floor, name).otherwise(level)
    return level


def scan_status(score: Column, blocked: Column) -> Column:
    """Report status; the warning mark is fixed, whatever the thresholds."""
    return (
        F.when(blocked, "BLOCKED").when(score >= R.WARN_THRESHOLD, "WARNING").otherwise("SAFE")
    )


def score_detections(
    detected: DataFrame, block_threshold: int | Column = R.BLOCK_THRESHOLD
) -> DataFrame:
    """Turn ``detections`` of all detectors into score, level and decision; only
    matched detections stay in the output."""
    threshold = block_threshold if isinstance(block_threshold, Column) else F.lit(block_threshold)
    return (
        detected.withColumn("detections", F.filter("detections", lambda d: d.matched))
        .withColumn("risk_score", risk_score(F.col("detections.severity")))
        .withColumn("risk_level", risk_level(F.col("risk_score")))
        .withColumn("blocked", F.col("risk_score") >= threshold)
    )


def scan_tools(
    tools: DataFrame,
    enabled: Iterable[str] | None = None,
    block_threshold: int | Column = R.BLOCK_THRESHOLD,
    **kwargs,
) -> DataFrame:
    """Scan every tool of a catalog.  Narrow: the input partitioning is kept."""
    return score_detections(with_detections(tools, enabled, **kwargs), block_threshold)


def scan_report(
    scanned: DataFrame,
    warn_threshold: int | Column = R.WARN_THRESHOLD,
    by: tuple[str, ...] = ("server_name",),
) -> DataFrame:
    """Counts per server.  Partial aggregation leaves one row per server and
    task to shuffle, so a server that holds most tools is no hot spot."""
    warn = warn_threshold if isinstance(warn_threshold, Column) else F.lit(warn_threshold)
    score, blocked = F.col("risk_score"), F.col("blocked")
    return scanned.groupBy(*by).agg(
        F.count("*").alias("total_tools"),
        F.count_if(blocked).alias("tools_blocked"),
        F.count_if(~blocked & (score >= warn)).alias("tools_warned"),
        F.count_if(score < warn).alias("tools_safe"),
        F.coalesce(F.max(score), F.lit(0)).alias("max_risk_score"),
    )


LISTING = ("server_name",)


def blocked_names(scanned: DataFrame, by: Sequence[str] = LISTING) -> DataFrame:
    """Names that fall in each listing (``by``)."""
    return scanned.where("blocked").select(*by, "tool_name").distinct()


def prepared_names(names: DataFrame, write: bool) -> tuple[DataFrame, bool]:
    """The names, written if wanted, and whether they were measured as small."""
    if not write:
        return names, False
    table = written(names, "blocked-names")
    return table, fits_broadcast(table, [c for c, t in table.dtypes if t == "string"])


def filter_catalog(
    tools: DataFrame,
    scanned: DataFrame,
    strict_names: bool = False,
    write_names: bool = False,
    by: Sequence[str] = LISTING,
) -> DataFrame:
    """Tools that stay: all whose name is not blocked in their listing, so that
    duplicates of a blocked name fall together.  ``by`` names the columns that
    tell listings apart: by default the server, and with the message id or scan
    id added each message by itself, as when messages are filtered one by one.

    The texts are scanned once, on the side that yields the few blocked names.
    A tool without a name is treated as ``unknown`` and removed with it; with
    ``strict_names`` raw names are compared and such a tool stays.
    ``write_names`` runs the scan now and writes the blocked names
    to the shared folder; while they are few they are broadcast, and no text is
    shuffled.
    """
    name = F.col("tool_name") if strict_names else F.coalesce("tool_name", F.lit("unknown"))
    names, small = prepared_names(blocked_names(scanned, by), write_names)
    return anti_join_keys(
        tools.withColumn("_name", name),
        names.withColumnRenamed("tool_name", "_name"),
        [*by, "_name"],
        small=small,
    ).drop("_name")


def scan_gate(scanned: DataFrame, flag: str = "blocked", by: str = "server_name") -> DataFrame:
    """Gate value per group: 1 if anything was flagged, else 0."""
    return scanned.groupBy(by).agg(
        F.coalesce(F.max(F.col(flag).cast("int")), F.lit(0)).alias("exit_code")
    )


def exposure_diff(
    tools: DataFrame, scanned: DataFrame, by: Sequence[str] = LISTING
) -> DataFrame:
    """Tools per listing before and after filtering, and how many are hidden."""
    before = tools.groupBy(*by).agg(F.count("*").alias("direct_tools"))
    after = filter_catalog(tools, scanned, by=by).groupBy(*by).agg(
        F.count("*").alias("protected_tools")
    )
    return before.join(after, list(by), "left").select(
        *by,
        "direct_tools",
        F.coalesce("protected_tools", F.lit(0).cast("bigint")).alias("protected_tools"),
        (F.col("direct_tools") - F.coalesce("protected_tools", F.lit(0))).alias("hidden_tools"),
    )


def severity_rank(scanned: DataFrame) -> DataFrame:
    """Rank the matched detections of each tool by severity, ties in registry
    order.  The detections of a tool are in its row, so nothing is shuffled."""
    keys = [
        c
        for c in scanned.columns
        if c not in ("description", "detections", "risk_score", "risk_level", "blocked")
    ]
    ranked = F.array_sort(
        F.transform(
            "detections",
            lambda d, i: F.struct((-d.severity).alias("o"), i.alias("i"), d.alias("d")),
        )
    )
    return scanned.select(*keys, F.posexplode(ranked).alias("_pos", "_r")).select(
        *keys,
        (F.col("_pos") + 1).alias("severity_rank"),
        F.col("_r.d.pattern_name").alias("pattern_name"),
        F.col("_r.d.severity").alias("severity"),
    )
