"""Small frames that may be broadcast. Skewed joins are left to AQE, which splits the larger side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SMALL_ROWS = 100_000


def small_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A frame from a configuration list; its length is known, so it may be broadcast."""
    frame = spark.createDataFrame(list(rows), schema)
    return F.broadcast(frame) if len(rows) <= MAX_SMALL_ROWS else frame
