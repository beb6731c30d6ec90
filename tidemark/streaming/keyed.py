"""A keyed table for streams: rows in key buckets, of which a batch reads and writes only those it touches.

Every batch writes the whole new contents of its buckets below a folder of its own. The state
before a batch is the newest committed version of each bucket, so a batch that is repeated after a failure
reads what it read before and replaces what it wrote.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.streaming.consume import BATCH, committed_batches

BUCKET = "bucket"


class KeyedTable:
    """``schema`` is a DDL string with the string column ``key``. Choose ``buckets`` once, so that a
    bucket fits in a task; their number cannot change later."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self.last_read: list[int] = []

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, *keys: DataFrame) -> list[int]:
        """The buckets of the keys (frames of one column): at most as many as there are buckets."""
        every = reduce(DataFrame.union, [k.toDF(self.key) for k in keys]).filter(F.col(self.key).isNotNull())
        return sorted(r[0] for r in every.select(self.bucket_of(F.col(self.key))).distinct().collect())

    def _versions(self, before: int | None) -> dict[int, tuple[int, str]]:
        """Per bucket the newest committed version below ``before`` and its path."""
        hadoop, found = self.spark._jvm.org.apache.hadoop.fs, {}
        for batch, place in sorted(committed_batches(self.spark, self.path).items()):
            if before is None or batch < before:
                root = hadoop.Path(place)
                for part in root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root):
                    name = part.getPath().getName()
                    if name.startswith(f"{BUCKET}="):
                        found[int(name.split("=")[1])] = (batch, part.getPath().toString())
        return found

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The state before a batch (all of it: the state now), of all or of some buckets."""
        versions = self._versions(before)
        self.last_read = sorted(b for b in versions if buckets is None or b in buckets)
        if not self.last_read:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[versions[b][1] for b in self.last_read])
        return rows.filter(F.col(self.key).isNotNull())

    def write(self, rows: DataFrame, buckets: list[int], batch_id: int) -> None:
        """Replace the contents of these buckets by ``rows``. A row without key marks each bucket, so that
        one that has become empty hides its older versions."""
        marks = self.spark.createDataFrame([(b,) for b in buckets], f"{BUCKET} int")
        held = rows.withColumn(BUCKET, self.bucket_of(F.col(self.key))).unionByName(marks, allowMissingColumns=True)
        held.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{BATCH}={batch_id}")

    def load(self, rows: DataFrame) -> None:
        """The state before the first batch."""
        self.write(rows, list(range(self.buckets)), -1)

    def replace(self, rows: DataFrame, gone: DataFrame, batch_id: int) -> None:
        """Take the keys of ``gone`` (one column) and of ``rows`` out of the state before the batch and put
        ``rows`` in."""
        buckets = self.touched(gone, rows.select(self.key))
        if buckets:
            kept = self.read(batch_id, buckets).join(gone.toDF(self.key).union(rows.select(self.key)), self.key, "left_anti")
            self.write(kept.unionByName(rows), buckets, batch_id)

    def vacuum(self, before: int) -> None:
        """Delete versions that neither the state before ``before`` nor a later one needs: call it with a
        batch that is committed in the stream's checkpoint, when no reader of an older state is left."""
        needed = {path for _, path in self._versions(before).values()}
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for batch, place in committed_batches(self.spark, self.path).items():
            if batch < before:
                root = hadoop.Path(place)
                files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
                for part in files.listStatus(root):
                    if part.getPath().getName().startswith(f"{BUCKET}=") and part.getPath().toString() not in needed:
                        files.delete(part.getPath(), True)
