"""Evaluate expensive columns exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(
    df: DataFrame, columns: dict[str, Column], drop: tuple[str, ...] = ()
) -> DataFrame:
    """Add columns that later filters and projections refer to but never copy.

    A filter on a projected column is pushed below the projection by copying
    the column's expression, which for the detectors would mean matching every
    text again.  The output of a one-element generator is not copied.
    """
    kept = [c for c in df.columns if c not in columns and c not in drop]
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))
