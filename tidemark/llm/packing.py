"""Conflict-constrained best-fit packing of documents into training sequences.

Pieces are dealt to shards by a hash of their identity and row, so a source with a third of all rows, or
one row repeated as often, is in every shard alike. A shard packs its pieces longest first: the open bins are kept in the order of
their residual, each with a bitmap of the sources and one of the duplicate clusters it holds, and
the search goes on from the first bin that is large enough until it meets the tightest one without
a conflict.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import column, runs
from tidemark.session import cut_lineage

BLOCK = 128


class Bins:
    """Open bins in the order (residual, number), in blocks that carry the AND of their bitmaps:
    a block whose bins all hold the wanted bit is passed over at once."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.blocks: list[list[tuple[int, int]]] = []
        self.common: list[int] = []
        self.tops: list[tuple[int, int]] = []
        self.bitmap: list[int] = []
        self.used: list[int] = []

    def _refresh(self, k: int) -> None:
        if not self.blocks[k]:
            del self.blocks[k], self.common[k], self.tops[k]
        elif len(self.blocks[k]) > 2 * BLOCK:
            half = self.blocks[k][BLOCK:]
            del self.blocks[k][BLOCK:]
            self.blocks.insert(k + 1, half)
            self.common.insert(k + 1, 0)
            self.tops.insert(k + 1, half[-1])
            self._refresh(k)
            self._refresh(k + 1)
        else:
            self.common[k] = reduce(and_, (self.bitmap[b] for _, b in self.blocks[k]))
            self.tops[k] = self.blocks[k][-1]

    def _insert(self, residual: int, number: int) -> None:
        entry = (residual, number)
        if not self.blocks:
            self.blocks, self.common, self.tops = [[entry]], [self.bitmap[number]], [entry]
            return
        k = min(bisect_left(self.tops, entry), len(self.tops) - 1)
        insort(self.blocks[k], entry)
        self._refresh(k)

    def place(self, size: int, bits: int) -> tuple[int, int]:
        """(bin, offset) of the tightest bin that has ``size`` free and none of ``bits``; a new bin
        if there is none. Equal residuals: the bin opened first."""
        floor = (size, -1)
        for k in range(bisect_left(self.tops, floor), len(self.blocks)):
            if self.common[k] & bits:
                continue
            block = self.blocks[k]
            for at in range(bisect_left(block, floor), len(block)):
                residual, number = block[at]
                if not self.bitmap[number] & bits:
                    del block[at]
                    self.bitmap[number] |= bits
                    offset, self.used[number] = self.used[number], self.used[number] + size
                    self._refresh(k)
                    if residual > size:
                        self._insert(residual - size, number)
                    return number, offset
        number = len(self.used)
        self.used.append(size)
        self.bitmap.append(bits)
        if size < self.capacity:
            self._insert(self.capacity - size, number)
        return number, 0


def pack(pieces: Iterable[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each (size, source, cluster), in the given order (longest first).

    A bin holds no source twice and no cluster twice; None conflicts with nothing. Only values that
    occur twice need a bit. A size of 0 takes no room and still counts for conflicts.
    """
    pieces = list(pieces)
    number: dict[tuple, int] = {}
    bitmaps = [0] * len(pieces)
    for field in (1, 2):
        seen = Counter(p[field] for p in pieces if p[field] is not None)
        for i, p in enumerate(pieces):
            if p[field] is not None and seen[p[field]] > 1:
                bitmaps[i] |= 1 << number.setdefault((field, p[field]), len(number))
    bins = Bins(capacity)
    return [bins.place(p[0], bits) for p, bits in zip(pieces, bitmaps)]


def pack_documents(docs: DataFrame, capacity: int = 2048, shard_pieces: int = 16384, id_col: str = "doc_id",
                   text_col: str = "text", source_col: str = "source", cluster_col: str | None = None,
                   length_col: str | None = None) -> DataFrame:
    """Pieces with their places: ``doc_id``, ``version`` (a hash of the text, which tells rows that
    repeat a doc_id apart), ``piece``, ``n_tokens``, ``source``, ``cluster``, ``bin_id``, ``bin_offset``.

    A document's length is ``length_col``, or its number of words plus an end token. A longer
    document than ``capacity`` is cut into full pieces, which are bins of their own, and a rest.
    Without ``cluster_col`` documents with the same words form a cluster. Null source or cluster
    conflicts with nothing, null text is empty (only an end token), null doc_id is kept. Bins are
    numbered ``shard * 2**32 + bin``. A shard holds about ``shard_pieces`` pieces: their number
    follows the number of rows.
    """
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]++"), "")
    own = F.xxhash64(F.lower(F.array_join(words, " "))) if cluster_col is None else F.xxhash64(column(cluster_col))
    size = F.size(words) + 1 if length_col is None else F.greatest(F.coalesce(column(length_col), F.lit(0)), F.lit(0))
    known = F.lit(True) if cluster_col is None else column(cluster_col).isNotNull()
    base = docs.select(
        column(id_col).cast("long").alias("doc_id"),
        column(source_col).cast("string").alias("source"),
        F.when(known, own).alias("cluster"),
        size.cast("long").alias("size"),
        F.xxhash64(text).alias("version"),
        F.monotonically_increasing_id().alias("_row"),
    )
    base = cut_lineage(base)  # written, so that a row keeps its number
    pieces = base.select(
        "*", F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)))).alias("piece", "_k")
    ).drop("_k")
    pieces = pieces.withColumn("n_tokens", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece") * capacity))
    total = base.agg(F.sum(F.greatest(F.ceil(F.col("size") / capacity), F.lit(1)))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "shard"):
            placed = pack(zip(*[part.column(c).to_pylist() for c in ("n_tokens", "source", "cluster")]), capacity)
            ids = np.array([p[0] for p in placed], np.int64) + (part.column("shard")[0].as_py() << 32)
            out = part.drop_columns(["shard"]).combine_chunks()
            out = out.append_column("bin_id", pa.array(ids))
            out = out.append_column("bin_offset", pa.array([p[1] for p in placed], pa.int64()))
            yield from out.to_batches()

    dealt = (
        pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "version", "piece", "_row"), F.lit(shards)))
        .repartition("shard").sortWithinPartitions("shard", F.desc("n_tokens"), "doc_id", "piece", "version")
        .select("doc_id", "version", "piece", "n_tokens", "source", "cluster", "shard")
    )
    return dealt.mapInArrow(
        run, "doc_id long, version long, piece int, n_tokens long, source string, cluster long, bin_id long, bin_offset long")
