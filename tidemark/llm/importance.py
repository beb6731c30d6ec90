"""Importance resampling: the ratio of hashed n-gram models of target and raw text, sampled without
replacement by Gumbel top-k.

A target document is weighed by a target model without it, so that it counts like a new text of its
kind; how many rows are drawn follows from these weights. A document's weight is the log ratio of its probability under the two bag-of-n-grams models (words
and word pairs, hashed into ``FEATURES`` buckets). Adding independent Gumbel noise to the weights and
taking the k highest draws k documents in proportion to their weights. The k-th highest key is found
by counting keys in 2**12 ranges a pass, so no task and no driver sees all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import broadcast_object, column, slices, texts, utf8, words
from tidemark.session import cut_lineage

FEATURES = 1 << 14
STEP = 12


class Memory(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 17:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def buckets(raw: bytes, memory: Memory) -> np.ndarray:
    """The bucket of each word and of each pair of neighbours."""
    found = words(raw)
    h = np.fromiter(map(memory.__getitem__, found), np.uint64, len(found))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]
    pairs ^= pairs >> np.uint64(29)
    return (np.concatenate((h, pairs)) % np.uint64(FEATURES)).astype(np.int64)


def _counts(docs: DataFrame) -> DataFrame:
    """(``bucket``, ``raw``, ``target``): n-grams of all documents and of the target ones. A task sends
    one row for each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, raw, target = Memory(), np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
        for part in slices(batches):
            for text, good in zip(utf8(part.column("text")), part.column("good").to_pylist()):
                own = np.bincount(buckets(text, memory), minlength=FEATURES)
                raw += own
                if good:
                    target += own
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    counted = docs.mapInArrow(run, "bucket long, raw long, target long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


class Ratio:
    """log(target / raw) of each bucket, add-one smoothed; ``FEATURES`` numbers of each."""

    def __init__(self, counts: DataFrame):
        raw, self.target = np.ones(FEATURES), np.ones(FEATURES)
        for row in counts.collect():
            raw[row.bucket] += row.raw
            self.target[row.bucket] += row.target
        self.raw = np.log(raw / raw.sum())
        self.log = np.log(self.target / self.target.sum()) - self.raw

    def weight(self, found: np.ndarray, good: bool) -> float:
        """The log ratio of a text's n-grams; a ``good`` text is taken out of the target model."""
        if not good or not len(found):
            return float(self.log[found].sum())
        own, count = np.unique(found, return_counts=True)
        left = np.log((self.target[own] - count) / (self.target.sum() - len(found)))
        return float((count * (left - self.raw[own])).sum())


def _weights(docs: DataFrame, ratio: Ratio) -> DataFrame:
    sent = broadcast_object(docs.sparkSession, ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memory = sent(), Memory()
        for part in slices(batches):
            found = [buckets(t, memory) for t in utf8(part.column("text"))]
            good = part.column("good")
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("version"), good,
                 pa.array(map(own.weight, found, good.to_pylist()), pa.float64()),
                 pa.array([len(b) for b in found], pa.int64())], ["doc_id", "version", "in_target", "log_weight", "n_grams"])

    return docs.mapInArrow(run, "doc_id long, version long, in_target boolean, log_weight double, n_grams long")


def gumbel(seed: int, *key: str) -> Column:
    """Gumbel noise that follows from the row's key, so a task that runs again draws the same."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11)
    uniform = (bits.cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def _ordered(value: Column) -> Column:
    """A long in the order of a double: micro-units, which is also what ties are judged by."""
    return F.round(value * 1e6).cast("long")


def top_k(frame: DataFrame, key: str, k: int) -> DataFrame:
    """Add ``selected``: whether the long ``key`` is among the ``k`` highest. Rows that tie with the
    k-th are all selected. ``frame`` is read once a pass: write it first."""
    least, most, total = frame.agg(F.min(key), F.max(key), F.count(key)).first()
    if k <= 0 or not total:
        return frame.withColumn("selected", F.lit(False))
    if k >= total:
        return frame.withColumn("selected", F.col(key).isNotNull())
    low, high, wanted = least, most, k
    while low < high:
        width = max(1, -(-(high - low + 1) >> STEP))
        counted = frame.filter(F.col(key).between(low, high)).groupBy(
            F.floor((F.col(key) - low) / width).cast("long").alias("cell")).count().collect()
        for cell, count in sorted(counted, reverse=True):
            if count >= wanted:
                low, high = low + cell * width, min(high, low + (cell + 1) * width - 1)
                break
            wanted -= count
    return frame.withColumn("selected", F.coalesce(F.col(key) >= low, F.lit(False)))


def resample(docs: DataFrame, target: DataFrame, k: int | None = None, reach: float = 0.98, seed: int = 7,
             target_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", target_id_col: str = "doc_id") -> DataFrame:
    """(``doc_id``, ``version``, ``in_target``, ``log_weight``, ``n_grams``, ``key``, ``selected``) of every row.

    ``target`` names documents of the target text by id; at most ``target_rows`` of them, those with
    the smallest hash, make the target model (that bounds what is broadcast). All documents make the
    raw model. ``k`` documents are drawn, or as many as have a key that ``reach`` of the target rows
    come up to, however many others there are. Null text is empty and has weight 0; a row with a null
    id is raw text only; equal rows draw the same noise, so they are selected together, as all ties
    with the k-th key are. Without target rows smoothing decides, and ``reach`` of all rows are drawn.
    """
    good = target.select(column(target_id_col).cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows).withColumn("good", F.lit(True))
    # written, so that both passes know the same target and the planner its size
    good = cut_lineage(good)
    marked = texts(docs, id_col, text_col).withColumn("version", F.xxhash64("text"))
    told = marked.join(F.broadcast(good), "doc_id", "left").select("doc_id", "version", "text", F.coalesce("good", F.lit(False)).alias("good"))
    ratio = Ratio(_counts(told.select("text", "good")))
    weighed = cut_lineage(_weights(told, ratio).withColumn(
        "key", _ordered(F.col("log_weight") + gumbel(seed, "doc_id", "version"))))
    if k is None:
        least = weighed.filter("in_target").agg(F.percentile_approx("key", 1 - reach, 100_000)).first()[0]
        k = weighed.filter(F.col("key") >= least).count() if least is not None else int(weighed.count() * reach)
    return top_k(weighed, "key", k)
