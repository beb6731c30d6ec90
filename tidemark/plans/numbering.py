"""Consecutive numbers without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def number_rows(df: DataFrame, order: Sequence[str], into: str, start: int | Column = 1) -> DataFrame:
    """Number rows ``start, start+1, ...`` in the order of ``order`` (a unique key).

    Rows are range-partitioned and sorted once; partition and place of a row are taken then and
    written with it. The offsets come from one count per partition.
    """
    ranged = cut_lineage(
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    # the id holds the partition above 33 bits of the row's place in it
    ranged = ranged.withColumn("_pid", F.shiftright("_row", 33)).withColumn(
        "_local", F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)))
    # one row per partition of the range exchange: the size of this frame is the partition count
    offsets = ranged.groupBy("_pid").count()
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("_pid", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    first = start if isinstance(start, Column) else F.lit(start)
    return (
        ranged.join(F.broadcast(offsets), "_pid")
        .withColumn(into, (first + F.col("_before") + F.col("_local")).cast("long"))
        .drop("_row", "_pid", "_local", "_before")
    )
