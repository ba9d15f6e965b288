"""Rates of cumulative counters from their scraped samples.

The rate at a time is the increase over the window before it, a second: what consecutive
samples of a series grew by (a fall is a restart from zero, so the later value counts whole),
carried on to the ends of the window as far as samples are missing there: by what is missing if
that is less than 1.1 times the average distance of samples, else by half that distance, and at
the beginning never beyond the time at which the counter was zero.  A window with fewer than two
samples has no rate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolwarden.plans.asof import latest_before

#: Distances of samples by which a window's end may be missed and still count as covered.
COVERED = 1.1


def counter_rates(
    samples: DataFrame, series: list[str], row_id: str, window_seconds: int = 60, step_seconds: int = 5,
    ts: str = "ts", value: str = "value",
) -> DataFrame:
    """``series…, at, rate`` (a second) at every multiple of the step whose window, behind ``at`` minus
    the window up to ``at``, holds two samples of a series.

    The sample before each is carried over time buckets, not sorted per series; samples are added
    up per series and step before windows are put together from steps, so a series with a third
    of all samples is no single task.  Rows without time or value count for nothing; samples of
    one time are ordered by ``row_id``."""
    if window_seconds % step_seconds:
        raise ValueError("the window must be a multiple of the step")
    step = step_seconds * 1_000_000
    order = F.struct(F.col(ts), F.col(row_id))
    given = samples.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).select(
        *series, F.col(ts).alias("ts"), F.col(row_id).alias("row"), F.col(value).cast("double").alias("v")
    )
    before = latest_before(given, series, F.struct("ts", "row"), F.col("v"), "ts", max(window_seconds, 60), "was")
    grown = F.when(F.col("was").isNull(), 0.0).when(F.col("v") >= F.col("was"), F.col("v") - F.col("was")).otherwise(F.col("v"))
    us = F.unix_micros("ts")
    slots = (
        before.withColumn("slot", F.ceil(us / step))
        .groupBy(*series, "slot")
        .agg(
            F.count("*").alias("n"), F.sum(grown).alias("grown"), F.max(us).alias("last"),
            F.min(F.struct(us.alias("t"), F.col("row"), F.col("v"), grown.alias("g"))).alias("first"),
        )
    )
    windows = (
        slots.withColumn("end", F.explode(F.sequence(F.col("slot"), F.col("slot") + window_seconds // step_seconds - 1)))
        .groupBy(*series, "end")
        .agg(F.sum("n").alias("n"), F.sum("grown").alias("grown"), F.max("last").alias("last"), F.min("first").alias("first"))
        .where((F.col("n") > 1) & (F.col("last") > F.col("first.t")))
    )
    seconds = lambda c: c / 1_000_000
    end = F.col("end") * step
    covered = seconds(F.col("last") - F.col("first.t"))
    apart = covered / (F.col("n") - 1)
    # What the first sample grew by lies before the window.
    increase = F.col("grown") - F.col("first.g")
    measured = windows.select(
        *series, F.timestamp_micros(end).alias("at"), increase.alias("increase"), covered.alias("covered"), apart.alias("apart"),
        seconds(F.col("first.t") - end + window_seconds * 1_000_000).alias("head"), seconds(end - F.col("last")).alias("tail"),
        F.col("first.v").alias("from"),
    )
    missing = lambda c: F.when(F.col(c) < COVERED * F.col("apart"), F.col(c)).otherwise(F.col("apart") / 2)
    to_zero = F.when((F.col("increase") > 0) & (F.col("from") >= 0), F.col("covered") * F.col("from") / F.col("increase"))
    whole = F.col("covered") + F.least(missing("head"), F.coalesce(to_zero, missing("head"))) + missing("tail")
    return measured.select(*series, "at", (F.col("increase") * whole / F.col("covered") / window_seconds).alias("rate"))
