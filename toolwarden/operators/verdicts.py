"""Semantic verdicts as a table keyed by the scanned text.

A scorer is any function from an iterator of pandas batches (``cache_key``,
``tool_name``, ``description``) to batches of (``cache_key``, ``reply``); it
runs once per distinct text that has no stored verdict.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolwarden import rules as R
from toolwarden import schemas
from toolwarden.operators.detectors import detection, normalise_tools
from toolwarden.plans.skew import anti_join_keys, lookup_join

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def verdict_key() -> Column:
    """SHA-256 of ``name:description``."""
    return F.sha2(
        F.concat(
            F.coalesce("tool_name", F.lit("unknown")),
            F.lit(":"),
            F.coalesce("description", F.lit("")),
        ),
        256,
    )


def with_key(tools: DataFrame) -> DataFrame:
    return tools.withColumn("cache_key", verdict_key())


def distinct_texts(tools: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Each (name, description) once, without those that have a stored verdict.
    Copies are combined before the shuffle."""
    texts = with_key(normalise_tools(tools))
    if stored is not None:  # before texts move
        texts = anti_join_keys(texts, stored.select("cache_key").distinct(), ["cache_key"])
    return texts.groupBy("cache_key").agg(
        F.first("tool_name").alias("tool_name"), F.first("description").alias("description")
    )


def with_cached_flag(
    tools: DataFrame, order: str, stored: DataFrame | None = None
) -> DataFrame:
    """Mark the rows that are served from the store: their text has a stored
    verdict, or came before (in ``order``).  Texts stay out of the shuffles."""
    keep = [c for c in tools.columns if c != "description"]
    slim = with_key(tools).select(*keep, "cache_key")
    first = slim.groupBy("cache_key").agg(F.min(order).alias("_first"))
    if stored is not None:
        known = stored.select("cache_key", F.lit(True).alias("_known")).distinct()
        first = first.join(known, "cache_key", "left")
    else:
        first = first.withColumn("_known", F.lit(False))
    return (
        lookup_join(slim, first, ["cache_key"])
        .withColumn("cached", F.coalesce("_known", F.lit(False)) | (F.col(order) > F.col("_first")))
        .drop("_first", "_known")
    )


def score_texts(texts: DataFrame, scorer: Scorer, tasks: int | None = None) -> DataFrame:
    """Replies of the scorer (``cache_key``, ``reply``; NULL when it failed).
    ``tasks`` bounds how many calls run at once."""
    spread = texts.repartition(tasks, "cache_key") if tasks else texts
    return spread.select("cache_key", "tool_name", "description").mapInPandas(
        scorer, "cache_key STRING, reply STRING"
    )


def unfenced(reply: Column) -> Column:
    """Reply without the lines of a surrounding code fence."""
    text = F.regexp_replace(reply, r"(?U)\A\s+|\s+\z", "")
    lines = F.filter(
        F.split(text, "\n"),
        lambda line: ~F.startswith(F.ltrim(line, F.lit(" \t\r")), F.lit("```")),
    )
    return F.when(F.startswith(text, F.lit("```")), F.trim(F.array_join(lines, "\n"))).otherwise(text)


def parse_replies(replies: DataFrame) -> DataFrame:
    """Verdict fields of the replies, with defaults for absent ones.

    A reply that is no JSON object yields a verdict that is not malicious and
    ``parsed = false`` (not to be stored); a NULL reply yields NULLs.  Fields are
    read loosely: numbers may have a fraction (cut off) or stand in quotes, one
    category may stand without a list, and a field that cannot be read takes its
    default without discarding the others.
    """
    body = F.trim(unfenced(F.col("reply")))
    looks_whole = F.startswith(body, F.lit("{")) & F.endswith(body, F.lit("}"))
    fields = F.from_json(body, schemas.VERDICT_REPLY + ", _corrupt STRING",
                         {"columnNameOfCorruptRecord": "_corrupt"})
    answered = F.col("reply").isNotNull()
    parsed = answered & looks_whole & F.col("_v").isNotNull() & F.col("_v._corrupt").isNull()

    def default(read: Column, value: Column) -> Column:
        return F.when(answered, F.coalesce(F.when(F.col("parsed"), read), value))

    def number(field: str) -> Column:
        value = F.expr(f"try_cast(_v.{field} AS DOUBLE)")
        return F.when(~F.isnan(value), F.expr(f"try_cast(try_cast(_v.{field} AS DOUBLE) AS INT)"))

    said = F.lower(F.trim(F.col("_v.malicious")))
    # Anything but an empty, zero or false value speaks for malice.
    malicious = F.when(said.isNotNull(), ~said.isin("false", "0", "0.0", "", "null", "[]", "{}"))
    listed = F.from_json(F.col("_v.categories"), "array<string>")
    categories = F.when(F.startswith(F.ltrim("_v.categories"), F.lit("[")), listed).otherwise(
        F.when(F.col("_v.categories").isNotNull(), F.array("_v.categories"))
    )

    return (
        replies.withColumn("_v", fields)
        .withColumn("parsed", F.when(answered, F.coalesce(parsed, F.lit(False))))
        .withColumns(
            {
                "malicious": default(malicious, F.lit(False)),
                "confidence": default(number("confidence"), F.lit(0)),
                "severity": default(number("severity"), F.lit(0)),
                "categories": default(categories, F.array().cast("array<string>")),
                "reasoning": default(
                    F.col("_v.reasoning"),
                    F.when(F.col("parsed"), F.lit("")).otherwise(F.lit("reply could not be parsed")),
                ),
            }
        )
        .drop("_v")
    )


def apply_confidence(verdicts: DataFrame, threshold: int = R.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Verdicts below the threshold are not malicious; the severity is left as is."""
    return verdicts.withColumn("malicious", F.col("malicious") & (F.col("confidence") >= threshold))


def retain(verdicts: DataFrame, capacity: int = R.VERDICT_CAPACITY) -> DataFrame:
    """The ``capacity`` verdicts that were stored last (first in, first out)."""
    return verdicts.orderBy(F.desc("first_seen"), F.desc("cache_key")).limit(capacity)


def semantic_detection() -> Column:
    """Detection of the joined verdict columns."""
    malicious = F.coalesce("malicious", F.lit(False))
    unavailable = F.col("malicious").isNull()
    categories = F.when(F.size("categories") > 0, F.array_join("categories", ", ")).otherwise(
        F.lit("unknown")
    )
    evidence = F.concat(
        F.lit("confidence="),
        F.col("confidence").cast("string"),
        F.lit("%, categories=["),
        categories,
        F.lit("]: "),
        F.col("reasoning"),
    )
    found = detection(R.SEMANTIC, malicious, F.when(malicious, F.col("severity")).otherwise(0), evidence)
    return found.withField(
        "evidence", F.when(unavailable, F.lit("no verdict")).otherwise(found["evidence"])
    )


VERDICT_FIELDS = ("malicious", "confidence", "severity", "categories", "reasoning")


def join_verdicts(
    tools: DataFrame, verdicts: DataFrame
) -> DataFrame:
    """Add the verdict columns; NULL where there is no verdict.  Of several verdicts of
    a key the latest counts (by ``first_seen`` if there is one)."""
    latest = F.col("first_seen") if "first_seen" in verdicts.columns else F.lit(0)
    fields = F.struct(*VERDICT_FIELDS)
    one = verdicts.groupBy("cache_key").agg(F.max_by(fields, F.struct(latest, F.xxhash64(fields))).alias("_v"))
    return lookup_join(tools, one.select("cache_key", "_v.*"), ["cache_key"])


def with_semantic(
    detected: DataFrame, verdicts: DataFrame
) -> DataFrame:
    """Append the semantic detection to ``detections``.  The text is reduced to
    its key before the join, so it is not shuffled."""
    keyed = with_key(detected).drop("description")
    return (
        join_verdicts(keyed, verdicts)
        .withColumn("detections", F.concat("detections", F.array(semantic_detection())))
        .drop(*VERDICT_FIELDS)
    )


def combined_verdict(scanned: DataFrame) -> DataFrame:
    """Malicious by verdict or blocked by the rules, and which of the two.
    Needs ``malicious``, ``reasoning``, ``blocked`` and ``risk_score``."""
    semantic = F.coalesce("malicious", F.lit(False))
    blocked = F.col("blocked")
    score = F.col("risk_score").cast("string")
    return scanned.withColumn("combined_malicious", semantic | blocked).withColumn(
        "combined_reason",
        F.when(semantic & blocked, F.concat(F.lit("semantic and rules, score "), score))
        .when(semantic, F.concat(F.lit("semantic: "), F.col("reasoning")))
        .when(blocked, F.concat(F.lit("rules, score "), score))
        .otherwise(F.lit("clean")),
    )


def semantic_counters(served: DataFrame) -> DataFrame:
    """Scans, malicious verdicts and cache hits."""
    return served.agg(
        F.count("*").alias("semantic_scans"),
        F.count_if("malicious").alias("semantic_detections"),
        F.count_if("cached").alias("cache_hits"),
    )
