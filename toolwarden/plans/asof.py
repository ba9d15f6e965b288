"""As-of state: the latest value written before each row.

A window per key would sort all rows of a hot key in one task.  Rows are cut
into time buckets instead: each bucket's last value is aggregated (one row per
key and bucket), carried forward over the buckets, and joined back, so the
row-level window works on one key *and* bucket at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_before(
    df: DataFrame,
    keys: list[str],
    order: Column,
    value: Column,
    ts: str,
    bucket_seconds: int,
    column: str,
) -> DataFrame:
    """Add ``column``: the last non-NULL ``value`` of the rows of the same key
    that come strictly before in ``order`` (which starts with the time)."""
    bucket = F.floor(F.unix_micros(F.col(ts)) / (bucket_seconds * 1_000_000))
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value).withColumn("_order", order)
    last_of_bucket = rows.groupBy(*keys, "_bucket").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_order"))).alias("_last")
    )
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = last_of_bucket.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys],
        F.col("_bucket").alias("_of_bucket"),
        F.last("_last", ignorenulls=True).over(before).alias("_carried"),
    )
    # NULL is a key like any other.
    same = F.col("_bucket") == F.col("_of_bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    within = Window.partitionBy(*keys, "_bucket").orderBy("_order").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        rows.join(carried, same, "left")
        .withColumn(
            column, F.coalesce(F.last("_value", ignorenulls=True).over(within), F.col("_carried"))
        )
        .drop("_bucket", "_value", "_order", "_carried", "_of_bucket", *[f"_of_{k}" for k in keys])
    )
