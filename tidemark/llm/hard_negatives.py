"""Hard-negative mining by a vertical scan of the vectors.

The vectors become blocks of columns (a row per block: one stretch of numbers per dimension, the rows
in the order of their label), written as a table. For an anchor a task reads the dimensions of a
block in the order of the anchor's descending magnitude. After every few dimensions the least and
the most that the remaining ones can add, from the least and greatest number of each dimension in the
block, bound every score; rows that can reach no wanted place leave the candidates, and what stays to
the end has its exact score. The first scan finds each anchor's positives, the second one the
negatives in the windows that the positives' scores open.

Anchors go out in groups of at most about ``GROUP``, so what is broadcast is bounded; every group meets
all blocks. A task keeps its best few per anchor, which is all that is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.base import broadcast_object, column
from tidemark.session import cut_lineage

BLOCK_ROWS = 8192
BLOCK_NUMBERS = 1 << 20
GROUP = 4096
STEP = 8
SCALE = 256
# numbers beyond are cut to it, so that 64-bit sums hold 512 products of them
MOST = 1 << 27
BLOCKS = "ids array<long>, labels array<long>, dims int, numbers binary"


def whole_rows(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, sizes, numbers one row after another) of the rows that take part."""
    vectors = batch.column("vector")
    valid = np.ones(batch.num_rows, bool)
    for c in ("id", "label", "vector"):
        valid &= batch.column(c).is_valid().to_numpy(zero_copy_only=False)
    kept = batch.filter(pa.array(valid))
    vectors = kept.column("vector")
    flat = vectors.flatten()
    sizes = np.diff(vectors.offsets.to_numpy()).astype(np.int64)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a null becomes a NaN
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    ends = np.cumsum(sizes)
    good = bad[ends] == bad[ends - sizes]
    whole = np.zeros(len(values), np.int64)
    finite = np.isfinite(values)
    whole[finite] = np.clip(np.floor(scale * values[finite]), -MOST, MOST).astype(np.int64)
    ids, labels = (kept.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[good] for c in ("id", "label"))
    return ids, labels, sizes[good], whole[np.repeat(good, sizes)]


def _write_blocks(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    rows = numbers = 0

    def block() -> pa.RecordBatch:
        ids, labels, sizes, flat = (np.concatenate(x) for x in zip(*held))
        dims = int(sizes.max()) if len(sizes) else 0
        table = np.zeros((len(ids), dims), np.int64)  # what a shorter row lacks is 0
        table[np.arange(dims) < sizes[:, None]] = flat
        order = np.lexsort((ids, labels))
        kind = np.int16 if not flat.size or np.abs(flat).max() < 1 << 15 else np.int32
        columns = np.ascontiguousarray(table[order].T.astype(kind))
        one = pa.array([0, len(ids)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(one, pa.array(ids[order])), pa.ListArray.from_arrays(one, pa.array(labels[order])),
             pa.array([dims], pa.int32()), pa.array([columns.tobytes()], pa.binary())],
            ["ids", "labels", "dims", "numbers"])

    for batch in batches:
        found = whole_rows(batch, scale)
        if not len(found[0]):
            continue
        held.append(found)
        rows, numbers = rows + len(found[0]), numbers + len(found[3])
        if rows >= BLOCK_ROWS or numbers >= BLOCK_NUMBERS:
            yield block()
            held, rows, numbers = [], 0, 0
    if held:
        yield block()


class Block:
    def __init__(self, ids: np.ndarray, labels: np.ndarray, dims: int, numbers: bytes):
        self.ids, self.labels, self.n, self.dims = ids, labels, len(ids), dims
        width = len(numbers) // max(1, self.n * dims)
        columns = np.frombuffer(numbers, np.int16 if width == 2 else np.int32).reshape(dims, self.n)
        # sums of products below 2**53 are exact in doubles, which are faster than 64-bit integers
        self.most = int(np.abs(columns.astype(np.int64)).max()) if columns.size else 0
        self.columns = columns.astype(np.float64 if self.most < 1 << 20 else np.int64)
        self.low, self.high = columns.min(axis=1).astype(np.int64), columns.max(axis=1).astype(np.int64)
        self.exact = self.columns.dtype == np.int64

    def of_label(self, label: int) -> tuple[int, int]:
        return tuple(np.searchsorted(self.labels, [label, label + 1]).tolist())

    def scan(self, anchor: np.ndarray, alive: np.ndarray, wanted) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of the candidates that stay. ``alive`` are the rows to begin with;
        ``wanted(low, high)`` tells which rows, by the bounds of their scores, can still be in a result."""
        a = np.zeros(self.dims, np.int64)
        own = min(self.dims, len(anchor))
        a[:own] = anchor[:own]
        if not self.exact and self.most * int(np.abs(a).sum()) >= 1 << 53:
            self.columns, self.exact = self.columns.astype(np.int64), True
        order = np.argsort(-np.abs(a), kind="stable")[:np.count_nonzero(a)]
        ends = a[order] * self.low[order], a[order] * self.high[order]
        # what the dimensions from each place of the order on can add at least and at most
        least, greatest = (np.concatenate((np.cumsum(x[::-1])[::-1], [0])) for x in (np.minimum(*ends), np.maximum(*ends)))
        first, count = (int(alive[0]), len(alive)) if len(alive) else (0, 0)
        straight = count and int(alive[-1]) - first + 1 == count  # one stretch needs no list of rows
        sums = np.zeros(count, self.columns.dtype)
        for at, d in enumerate(order.tolist()):
            column_ = self.columns[d]
            sums += (column_[first:first + count] if straight else column_[alive]) * a[d]
            if (at + 1) % STEP == 0 or at + 1 == len(order):
                keep = wanted(sums + least[at + 1], sums + greatest[at + 1])
                left = int(np.count_nonzero(keep))
                # a list of rows pays once it is much shorter
                if left < len(sums) * (0.5 if straight else 0.8) or at + 1 == len(order):
                    alive, sums, straight = alive[keep], sums[keep], False
                if not left:
                    break
        return alive, sums.astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, labels = (batch.column(c)[i].values.to_numpy() for c in ("ids", "labels"))
            yield Block(ids, labels, batch.column("dims")[i].as_py(), batch.column("numbers")[i].as_py())


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def _found(best: list[tuple[np.ndarray, np.ndarray]], names: list[tuple[int, ...]], keys: list[str]) -> Iterator[pa.RecordBatch]:
    counts = [len(s) for _, s in best]
    if sum(counts):
        named = np.repeat(np.array(names, np.int64), counts, axis=0)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(np.ascontiguousarray(named[:, c])) for c in range(len(keys))],
             pa.array(np.concatenate([i for i, _ in best])), pa.array(np.concatenate([s for _, s in best]))],
            [*keys, "id", "score"])


def _positives(batches, anchors: list[tuple[int, int, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """The first ``k`` other rows of each anchor's label."""
    none = np.empty(0, np.int64)
    best = [(none, none)] * len(anchors)
    for block in _blocks(batches):
        for n, (vec, label, vector) in enumerate(anchors):
            a, b = block.of_label(label)
            if a == b:
                continue
            ids, scores = best[n]
            bar = scores[-1] if len(scores) == k else -np.inf
            alive = a + np.flatnonzero(block.ids[a:b] != vec)
            rows, found = block.scan(vector, alive, lambda low, high: high >= max(bar, _kth(low, k)))
            if len(rows):
                best[n] = _best(np.concatenate((ids, block.ids[rows])), np.concatenate((scores, found)), k)
    yield from _found(best, [(n,) for n in range(len(anchors))], ["anchor"])


def _negatives(batches, anchors: list[tuple[int, np.ndarray, list[tuple[int, int, int]]]], k: int) -> Iterator[pa.RecordBatch]:
    """The first ``k`` rows of other labels with a score in each of an anchor's windows
    (place, least, most)."""
    none = np.empty(0, np.int64)
    names = [(n, w[0]) for n, (_, _, windows) in enumerate(anchors) for w in windows]
    best = {name: (none, none) for name in names}
    for block in _blocks(batches):
        for n, (label, vector, windows) in enumerate(anchors):
            open_ = []
            for place, least, most in windows:
                scores = best[n, place][1]
                open_.append((place, max(least, int(scores[-1])) if len(scores) == k else least, most))
            a, b = block.of_label(label)
            alive = np.concatenate((np.arange(a), np.arange(b, block.n))) if a < b else np.arange(block.n)
            if not open_ or not len(alive):
                continue

            def wanted(low, high):
                keep = np.zeros(len(low), bool)
                for _, least, most in open_:
                    keep |= (high >= least) & (low <= most)
                return keep

            rows, found = block.scan(vector, alive, wanted)
            for place, least, most in open_:
                own = (found >= least) & (found <= most)
                if own.any():
                    ids, scores = best[n, place]
                    best[n, place] = _best(np.concatenate((ids, block.ids[rows[own]])), np.concatenate((scores, found[own])), k)
    yield from _found([best[name] for name in names], names, ["anchor", "place"])


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    Each component x is floor(scale * x); a score is the inner product with the anchor, the higher the
    better, ties by the smaller id. An anchor is a row for which ``anchors`` (a column of ``vectors``)
    holds; its positives are the first ``positives`` rows of its label with another id, and the negatives of
    a positive the first ``negatives`` rows of other labels whose score is ``least`` to ``most`` per cent of
    the positive's. A row with a null id, label, vector or component, or one that is not finite, takes
    no part. Components that a shorter vector lacks are 0, those beyond 2**27 in size count as
    2**27. Rows that repeat an id are rows of their own; an anchor that is there twice with label and vector
    counts once. An empty table, or one without an anchor, gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    plain = vectors.select(
        column(id_col).cast("long").alias("id"), column(label_col).cast("long").alias("label"), column(vector_col).alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("is_anchor"))

    def write(batches):
        return _write_blocks(batches, scale)

    def pick(batches):
        for batch in batches:
            ids, labels, sizes, flat = whole_rows(batch, scale)
            edges = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(labels), pa.ListArray.from_arrays(edges, pa.array(flat))], ["id", "label", "vector"])

    blocks = cut_lineage(plain.select("id", "label", "vector").mapInArrow(write, BLOCKS))
    asked = plain.filter("is_anchor").select("id", "label", "vector")
    asked = cut_lineage(asked.mapInArrow(pick, "id long, label long, vector array<long>").distinct())
    groups = max(1, -(-asked.count() // GROUP))
    group = F.pmod(F.xxhash64("id", "label", "vector"), F.lit(groups))
    out = None
    for g in range(groups):
        rows = asked.filter(group == g).orderBy("label", "id", "vector").collect()
        listed = [(r.id, r.label, np.array(r.vector, np.int64)) for r in rows]
        sent = broadcast_object(spark, listed)

        def find(batches, sent=sent):
            return _positives(batches, sent(), positives)

        near = _first(blocks.mapInArrow(find, "anchor long, id long, score long"), ["anchor"], positives).collect()
        windows: list[list[tuple[int, int, int]]] = [[] for _ in listed]
        for r in near:
            # least * p <= 100 * n <= most * p in whole numbers; below 0 there is no such n
            low, high = -(-least * r["score"] // 100), most * r["score"] // 100
            if low <= high:
                windows[r["anchor"]].append((r["rank"], low, high))
        sent = broadcast_object(spark, [(label, vector, w) for (_, label, vector), w in zip(listed, windows)])

        def search(batches, sent=sent):
            return _negatives(batches, sent(), negatives)

        found = _first(blocks.mapInArrow(search, "anchor long, place long, id long, score long"), ["anchor", "place"], negatives)
        # a group's anchors and their positives: a bounded number of rows
        named = spark.createDataFrame(
            [(r["anchor"], r["rank"], listed[r["anchor"]][0], r["id"], r["score"]) for r in near],
            "anchor long, place long, anchor_id long, positive_id long, positive_score long")
        found = found.join(F.broadcast(named), ["anchor", "place"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = found if out is None else out.union(found)
    return out


# the same rows by plain SQL: every anchor against all rows
ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id AS id, a.label = v.label AS same, list_dot_product(a.e, v.e)::BIGINT AS score
  FROM v a JOIN v ON a.vec_id % 50 = 0 AND (a.label <> v.label OR a.vec_id <> v.vec_id)),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3
"""
