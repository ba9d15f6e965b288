"""Markdown report per server, as ordered lines.

A report grows with its server, so it is never one string: every line is a row
with its place, and the sink writes the lines range-partitioned.  The files of
a server, read in name order, are its report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolwarden import rules as R
from toolwarden.operators.scoring import scan_report, scan_status

#: What to do about each kind of finding.
ADVICE = {
    "Prompt Injection": "Reword texts that address the agent; a description says what its tool does.",
    "Data Exfiltration": "Name the hosts that may receive data, and drop links that carry any.",
    "Cross-Tool Manipulation": "Leave the choice of tools to the agent; strike orders to call others.",
    "Invisible Characters": "Publish plain text without characters that nobody can see.",
    "Obfuscated Payloads": "Write encoded passages out, or leave them away.",
    "Description Anomalies": "Shorten the text; comments and empty blocks do not belong in it.",
    "Dangerous Commands": "Keep commands and names of secrets out of the text.",
    "SSRF / Internal Access": "Point to public addresses only.",
    R.SEMANTIC: "Have a person read the text that the scorer objected to.",
}
NO_ADVICE = "Nothing."


def _number(column: str) -> Column:
    return F.col(column).cast("string")


def _placed(section: int, order: Column, lines: Column) -> Column:
    """Lines of one section as structs that carry their place; a line break
    inside a name or a sample is written as ``\\n``."""
    one_line = F.transform(
        lines,
        lambda line: F.replace(
            F.replace(line, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")
        ),
    )
    return F.transform(
        one_line,
        lambda line, i: F.struct(
            F.lit(section).alias("section"),
            order.cast("bigint").alias("tool_order"),
            i.alias("line_pos"),
            line.alias("line"),
        ),
    )


def markdown_lines(scanned: DataFrame, order: str, warn_threshold: int = R.WARN_THRESHOLD) -> DataFrame:
    """Report lines with their place: server, section, tool order, line.

    The scan is read twice (totals and lines); hand in a written scan result
    rather than a running scan."""
    report = scan_report(scanned, warn_threshold)
    # Sets of detector names: as many as there are combinations, however many tools a server has.
    kinds = scanned.groupBy("server_name").agg(
        F.array_distinct(F.flatten(F.collect_set("detections.pattern_name"))).alias("_kinds")
    )
    report = report.join(kinds, "server_name")
    none = F.lit(-1)
    counts = F.concat(
        F.lit("Worst score "), _number("max_risk_score"), F.lit(f" of {R.MAX_SCORE}. "), _number("total_tools"),
        F.lit(" tools: "), _number("tools_blocked"), F.lit(" withheld, "), _number("tools_warned"),
        F.lit(" to look at, "), _number("tools_safe"), F.lit(" without concern."),
    )
    head = F.array(F.concat(F.lit("# Tools of "), F.col("server_name")), F.lit(""), counts, F.lit(""))
    findings_head = F.array(F.lit(""), F.lit("## Evidence"), F.lit(""))
    advice = F.array_compact(
        F.array(
            *[F.when(F.array_contains("_kinds", k), F.lit(f"- {k}: {text}")) for k, text in ADVICE.items()]
        )
    )
    advice = F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit(NO_ADVICE)))
    tail = F.concat(F.array(F.lit(""), F.lit("## To do"), F.lit("")), advice)

    names = F.array_join("detections.pattern_name", ", ")
    row = F.concat(
        F.lit("- "), F.col("tool_name"), F.lit(": "), _number("risk_score"), F.lit(" ("), F.col("risk_level"),
        F.lit(", "), F.lower(scan_status(F.col("risk_score"), F.col("blocked"))), F.lit(")"),
        F.when(F.size("detections") > 0, F.concat(F.lit(", "), names)).otherwise(""),
    )
    tool_head = F.array(F.col("tool_name"))
    bullets = F.transform(
        "detections",
        lambda d: F.concat(
            F.lit("  - "), d.pattern_name, F.lit(", "), d.severity.cast("string"), F.lit(": "), d.evidence
        ),
    )
    details = F.concat(tool_head, bullets)
    per_server = F.concat(
        _placed(0, none, head), _placed(2, none, findings_head), _placed(4, none, tail)
    )
    per_tool = F.concat(
        _placed(1, F.col(order), F.array(row)),
        F.when(F.size("detections") > 0, _placed(3, F.col(order), details)).otherwise(
            F.array().cast("array<struct<section:int,tool_order:bigint,line_pos:int,line:string>>")
        ),
    )
    return report.select("server_name", F.inline(per_server)).unionByName(
        scanned.select("server_name", F.inline(per_tool))
    )


_PLACE = ("server_name", "section", "tool_order", "line_pos")


def write_markdown(lines: DataFrame, path: str, tasks: int | None = None) -> None:
    """Write the reports below ``server_name=…/``; a large one spans files."""
    spread = (
        lines.repartitionByRange(tasks, *_PLACE) if tasks else lines.repartitionByRange(*_PLACE)
    )
    spread.sortWithinPartitions(*_PLACE).select("server_name", "line").write.mode(
        "overwrite"
    ).partitionBy("server_name").text(path)
