"""Consecutive numbering without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.ranks import SLICES, running_totals


def numbered(df: DataFrame, key: str, slices: int | None = None) -> DataFrame:
    """``(key, _n)``: 1-based position of each distinct numeric key."""
    kind = df.schema[key].dataType
    rows = running_totals(df, [], key, slices=slices or SLICES)
    return rows.select(rows[key].cast(kind).alias(key), rows["cumulative"].cast("bigint").alias("_n"))
