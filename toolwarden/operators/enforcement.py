"""Policy and scan together: which tools reach the agent, and why not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolwarden import rules as R
from toolwarden.operators.detectors import enabled_detectors
from toolwarden.operators.policy import decide, with_server_thresholds
from toolwarden.operators.scoring import LISTING, blocked_names, prepared_names, scan_tools
from toolwarden.plans.skew import lookup_join
from toolwarden.plans.workspace import written
from toolwarden.sources.policy_config import Policy


def judge_catalog(
    tools: DataFrame,
    policy: Policy,
    server_thresholds: bool = True,
    enabled: list[str] | None = None,
    evidence: bool = True,
) -> DataFrame:
    """Policy decision first, then the scan of everything policy did not block.

    Every tool keeps one row: ``policy``, and for scanned tools the score,
    detections and ``blocked``.  Policy-blocked tools are not scanned (their
    text is not looked at) and have no score.  Allow-listed tools are scanned.
    """
    judged = decide(tools, policy, use_score=False)
    judged = judged.withColumn("policy_blocked", F.col("policy.action") == "block")
    judged = with_server_thresholds(judged, policy)
    text = F.col("description")
    to_scan = judged.withColumn("_text", text).withColumn(
        "description", F.when(F.col("policy_blocked"), F.lit("")).otherwise(text)
    )
    threshold = F.col("block_threshold") if server_thresholds else R.BLOCK_THRESHOLD
    names = None if enabled is None else enabled_detectors(enabled, policy.required_patterns)
    scanned = scan_tools(to_scan, names, threshold, evidence=evidence)
    not_scanned = F.col("policy_blocked")
    return (
        scanned.withColumn("description", F.col("_text"))
        .withColumn("risk_score", F.when(~not_scanned, F.col("risk_score")))
        .withColumn("risk_level", F.when(~not_scanned, F.col("risk_level")))
        .withColumn("blocked", F.col("blocked") & ~not_scanned)
        .drop("_text")
    )


def enforce_catalog(
    tools: DataFrame,
    policy: Policy,
    server_thresholds: bool = True,
    write_names: bool = False,
    by: Sequence[str] = LISTING,
) -> DataFrame:
    """Tools that are delivered: not blocked by policy, and either their name is
    not blocked by the scan or the policy allows them (``readded``).
    ``write_names`` and ``by`` act as in ``filter_catalog``."""
    offered = decide(tools, policy, use_score=False).where(F.col("policy.action") != "block")
    offered = offered.withColumn("tool_name", F.coalesce("tool_name", F.lit("unknown")))
    scanned = judge_catalog(tools, policy, server_thresholds, evidence=False)
    names, small = prepared_names(blocked_names(scanned, by), write_names)
    hits = names.withColumn("_hit", F.lit(True))
    allowed = F.col("policy.action") == "allow"
    hit = F.coalesce("_hit", F.lit(False))
    return (
        lookup_join(offered, hits, [*by, "tool_name"], small=small)
        .where(~hit | allowed)
        .withColumn("readded", hit & allowed)
        .drop("_hit")
    )


def enforcement_summary(
    judged: DataFrame, server_thresholds: bool = True, by: tuple[str, ...] = ("server_name",)
) -> DataFrame:
    """Counts per server, for servers of which something was blocked."""
    scanned = ~F.col("policy_blocked")
    warn = F.col("warn_threshold") if server_thresholds else F.lit(R.WARN_THRESHOLD)
    score = F.col("risk_score")
    return (
        judged.groupBy(*by)
        .agg(
            F.count_if(F.col("blocked") | F.col("policy_blocked")).alias("tools_blocked"),
            F.count_if(F.col("policy_blocked")).alias("policy_blocked"),
            F.count_if(scanned & ~F.col("blocked") & (score >= warn)).alias("tools_warned"),
            F.coalesce(F.max(score), F.lit(0)).alias("max_risk_score"),
        )
        .where("tools_blocked > 0")
    )


def blocked_tools(judged: DataFrame) -> DataFrame:
    """Blocked tools with the reason, one row each (a server may have any number)."""
    return judged.where(F.col("blocked") | F.col("policy_blocked")).select(
        "server_name",
        "tool_name",
        F.when(F.col("policy_blocked"), "policy").otherwise("scan").alias("blocked_by"),
        F.when(F.col("policy_blocked"), F.col("policy.reason"))
        .otherwise(F.concat(F.lit("risk score "), F.col("risk_score").cast("string")))
        .alias("reason"),
    )


def policy_overrides(decided: DataFrame) -> DataFrame:
    """Number of block and allow decisions of the policy."""
    return decided.agg(F.count_if(F.col("policy.action") != "default").alias("policy_overrides"))


#: A part of a time bucket holds at most so many moments with a write; one with more is cut into so many parts.
PARTS = 256
#: Where a row without a time stands: before all writes.
_NEVER = -(1 << 62)


def _widths(bucket_seconds: int) -> list[int]:
    """Microseconds of a time bucket and of its parts, level by level; the last have ``PARTS`` moments."""
    parts, width = [], PARTS
    while width < bucket_seconds * 1_000_000:
        parts.insert(0, width)
        width *= PARTS
    return [bucket_seconds * 1_000_000, *parts]


def _start(at: str | Column, widths: list[int], level: int) -> Column:
    """Where the part of a level begins that a moment lies in."""
    at = F.col(at) if isinstance(at, str) else at
    since = F.pmod(at, F.lit(widths[0]))
    return at - (F.pmod(since, F.lit(widths[level])) if level else since)


def _places(df: DataFrame, widths: list[int]) -> DataFrame:
    """``df`` with ``_level, _part`` for the parts of all levels around ``_at``, a row each."""
    levels = [F.struct(F.lit(n).alias("_level"), _start("_at", widths, n).alias("_part")) for n in range(len(widths))]
    return df.select("*", F.inline(F.array(*levels)))


def _carried(*by: str, order: str = "_part") -> Column:
    """The last known state of the earlier rows."""
    earlier = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last("enabled", ignorenulls=True).over(earlier)


def _parts(at: DataFrame, writes: DataFrame, widths: list[int]) -> tuple[DataFrame, list[int]]:
    """``_level, _part, _before``: time cut so that no part has more than ``PARTS`` writes, around all
    moments ``at`` and all writes, with the state that each part starts with; and the widths in use.

    A state is carried among the parts of one part, which are ``PARTS`` at most, and among the
    buckets, which are as many as hours.  Levels are written one by one, as far as parts have to be cut."""
    counted = _places(writes, widths).groupBy("_level", "_part")
    counted = written(counted.agg(F.count("*").alias("n"), F.max_by("enabled", "_at").alias("enabled")), "switch_counts")
    # Buckets are carried within a thousand, and the thousands after each other.
    far = widths[0] * 1024
    marks = at.select(_start("_at", widths, 0).alias("_part"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("boolean").alias("enabled"))
    buckets = marks.unionByName(counted.where("_level = 0").drop("_level")).groupBy("_part")
    buckets = buckets.agg(F.max("n").alias("n"), F.max("enabled").alias("enabled"))
    buckets = buckets.withColumn("_far", F.col("_part") - F.pmod("_part", F.lit(far)))
    buckets = written(buckets, "switch_buckets")
    last = F.max_by("enabled", F.when(F.col("enabled").isNotNull(), F.col("_part")))
    ends = buckets.groupBy("_far").agg(last.alias("enabled")).select("_far", _carried(order="_far").alias("_of_far"))
    known = buckets.join(ends, "_far").select("_part", "n", F.coalesce(_carried("_far"), "_of_far").alias("_before"))
    found = None
    for level, width in enumerate(widths):
        known = written(known, "switch_parts")
        to_cut = known.where(F.col("n") > PARTS)
        deepest = level + 1 == len(widths) or to_cut.isEmpty()
        done = known if deepest else known.where(F.col("n") <= PARTS)
        done = done.select(F.lit(level).alias("_level"), "_part", "_before")
        found = done if found is None else found.unionByName(done)
        if deepest:
            return found, widths[: level + 1]
        step = F.sequence(F.lit(0).cast("long"), F.lit(width - 1), F.lit(widths[level + 1]))
        cut = to_cut.select(F.col("_part").alias("_of"), "_before", F.explode(step).alias("_step"))
        inner = counted.where(F.col("_level") == level + 1).drop("_level")
        cut = cut.withColumn("_part", F.col("_of") + F.col("_step")).join(inner, "_part", "left")
        known = cut.select("_part", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(_carried("_of"), "_before").alias("_before"))


def switch_intervals(at: DataFrame, controls: DataFrame, bucket_seconds: int) -> tuple[DataFrame, list[int]]:
    """``_level, _part, _from, _until, _state``: what the switch shows from a moment (``_at`` in
    microseconds) up to the next, cut at the borders of the parts of time; a part has few of them.
    Of the writes of one moment one that switches on counts; a state that is NULL is off.
    The second result are the widths of the levels in use."""
    writes = (
        controls.where("ts IS NOT NULL")
        .groupBy(F.unix_micros("ts").alias("_at"))
        .agg(F.coalesce(F.max("enabled"), F.lit(False)).alias("enabled"))
    )
    writes = written(writes, "switch_writes")
    parts, widths = _parts(at, writes, _widths(bucket_seconds))
    opening = parts.select("_level", "_part", F.col("_part").alias("_from"), F.lit(0).alias("_order"), F.col("_before").alias("_state"))
    placed = _places(writes, widths).join(parts, ["_level", "_part"])
    placed = placed.select("_level", "_part", F.col("_at").alias("_from"), F.lit(1).alias("_order"), F.col("enabled").alias("_state"))
    within = Window.partitionBy("_level", "_part").orderBy("_from", "_order")
    intervals = opening.unionByName(placed).select(
        "_level", "_part", "_from", F.lead("_from").over(within).alias("_until"), F.coalesce("_state", F.lit(False)).alias("_state")
    )
    return intervals, widths


def switch_state(
    rows: DataFrame, controls: DataFrame, ts: str = "ts", bucket_seconds: int = 3600
) -> DataFrame:
    """State of the kill switch when each row happened: the last control write
    (``ts``, ``enabled``) up to its moment, off without one.

    Time is cut into parts with few writes each, smaller where writes are dense.
    A row meets the intervals of its part by an equality, so an hour or a moment
    may hold any share of the rows and of the writes; no row holds a list of
    writes."""
    kept = rows.columns
    moment = F.coalesce(F.unix_micros(F.col(ts)), F.lit(_NEVER))
    intervals, widths = switch_intervals(rows.select(moment.alias("_at")), controls, bucket_seconds)
    # Each row lies in one part of one level, and there in one interval.
    # A write at the very moment of a row takes effect for it.
    inside = (F.col("_at") >= F.col("_from")) & (F.col("_until").isNull() | (F.col("_at") < F.col("_until")))
    placed = _places(rows.withColumn("_at", moment), widths).withColumnsRenamed({"_level": "_l", "_part": "_p"})
    same = (F.col("_l") == F.col("_level")) & (F.col("_p") == F.col("_part"))
    return placed.join(intervals, same & inside).select(*kept, F.col("_state").alias("kill_switch"))


def kill_switch_filter(rows: DataFrame, enabled: bool | Column) -> DataFrame:
    """Catalog rows that pass the switch: none while it is on."""
    return rows.where(~(enabled if isinstance(enabled, Column) else F.lit(enabled)))
