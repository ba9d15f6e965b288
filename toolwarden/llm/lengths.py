"""Exact token counts: a histogram of encoded lengths and its suffix sums.

Every document is encoded whole; lengths are counted, combined before the
shuffle, so a length that a third of all documents has costs nothing.  Suffix
sums over the histogram answer, for every context limit, how many documents
reach it, the tokens that remain if all are cut to it, and the share of
documents that fit.  The sums run in ranges of ``RANGE`` lengths, then over the
ranges, so no task holds the whole histogram.

Defined results: a NULL or empty text has length 0; repeated rows are counted
as often as they occur; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import appended

RANGE = 1024
#: Code points encoded at a time.
AT_ONCE = 1 << 20


def encoded_lengths(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``n_tokens`` of every text under a byte-level vocabulary."""

    def compute(batch: pa.RecordBatch) -> list:
        encoder = tokens.byte_bpe(path)
        return [[len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column("body").to_pylist()]]

    held = docs.select(F.col(f"`{text}`").alias("body"))
    return appended(held, T.StructType().add("n_tokens", T.LongType()), compute).select("n_tokens")


def histogram(lengths: DataFrame) -> DataFrame:
    """One row per length that occurs, as a context limit: ``n_tokens``, ``n_docs``, documents and
    tokens of at least that length, ``truncated_tokens`` (all documents cut to it), ``n_fit``
    (documents not longer), ``fit_share``."""
    counts = lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    rows = counts.withColumn("slot", F.floor(F.col("n_tokens") / RANGE)).withColumn(
        "tokens", F.col("n_tokens") * F.col("n_docs")
    )
    slots = rows.groupBy("slot").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)  # one row per slot
    everything = Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    slots = slots.select(
        "slot",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("d").over(everything).alias("all_docs"),
        F.sum("t").over(everything).alias("all_tokens"),
    )
    down = Window.partitionBy("slot").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.join(slots, "slot").select(
        "n_tokens", "n_docs", "tokens", "all_docs", "all_tokens",
        (F.sum("n_docs").over(down) + F.col("d_after")).alias("docs_at_least"),
        (F.sum("tokens").over(down) + F.col("t_after")).alias("tokens_at_least"),
    )
    fit = F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")
    return sums.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_tokens"),
        fit.alias("n_fit"),
        (fit / F.col("all_docs")).alias("fit_share"),
    )


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """``share, n_tokens``: the smallest length that at least this share of the documents fits."""
    ends = [F.min(F.when(F.col("fit_share") >= s, F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)]
    pairs = F.array(*[F.struct(F.lit(s).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(shares)])
    return hist.agg(*ends).select(F.inline(pairs))


def totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """``limit, truncated_tokens, n_fit`` for any context limits."""
    size = F.col("n_tokens")
    sums = [
        c
        for i, limit in enumerate(limits)
        for c in (
            F.sum(F.least(size, F.lit(limit)) * F.col("n_docs")).alias(f"t{i}"),
            F.sum(F.when(size <= limit, F.col("n_docs")).otherwise(0)).alias(f"f{i}"),
        )
    ]
    pairs = [
        F.struct(F.lit(x).cast("bigint").alias("limit"), F.coalesce(f"t{i}", F.lit(0)).alias("truncated_tokens"), F.coalesce(f"f{i}", F.lit(0)).alias("n_fit"))
        for i, x in enumerate(limits)
    ]
    return hist.agg(*sums).select(F.inline(F.array(*pairs)))
