"""Joins to tables that have one row per key.

A key may hold a third of the left rows.  A right side that is known or measured
to be small is broadcast, and the left side is not shuffled at all.  Otherwise
both sides are shuffled by nothing but the join's own exchanges, so adaptive
execution splits the partition of a hot key by its measured size and copies the
right rows of that partition only; no side is copied ahead of need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side of known size may be broadcast (short rows only).
BROADCAST_ROWS = 100_000
#: Bytes of text up to which a written table may be broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024


def fits_broadcast(table: DataFrame, columns: list[str]) -> bool:
    """Measure a written table: are its rows and texts few enough to broadcast?"""
    text = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))
    row = table.agg(F.count("*").alias("n"), F.sum(text.cast("bigint")).alias("size")).first()
    return row["n"] <= BROADCAST_ROWS and (row["size"] or 0) <= BROADCAST_BYTES


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "left",
    right_rows: int | None = None,
    small: bool = False,
) -> DataFrame:
    """Join to a table that has one row per key.

    ``right_rows`` is the known row count of the right side, if there is one;
    ``small`` says that :func:`fits_broadcast` measured it."""
    if small or (right_rows is not None and right_rows <= BROADCAST_ROWS):
        right = F.broadcast(right)
    return left.join(right, keys, how)


def anti_join_keys(left: DataFrame, keys_frame: DataFrame, keys: list[str], small: bool = False) -> DataFrame:
    """Left rows whose key is not listed."""
    return lookup_join(left, keys_frame, keys, "left_anti", small=small)
