"""Rows dealt over tasks by their number: a file may hold all of its rows in one row group, which one task reads."""

from __future__ import annotations

from pyspark.sql import DataFrame


def parts_of(df: DataFrame, rows: int) -> int:
    """How many partitions of about ``rows`` rows the frame makes."""
    return max(1, -(-df.count() // rows))


def spread(df: DataFrame, rows: int) -> DataFrame:
    """The frame in partitions of about ``rows`` rows, dealt in turn, so that work that multiplies or
    transforms rows is shared, and bounded in a task, however the file was written."""
    return df.repartition(parts_of(df, rows))
