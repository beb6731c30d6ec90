"""Token ids in patched frame-of-reference blocks.

A segment holds the ids of consecutive documents. Its payload is little-endian:

    magic "PFR1", block size u32, ids u64, blocks u64
    block minimum      u32 per block
    block width        u8 per block: bits that hold one of ``PERCENTILES`` of the block's differences
    packed starts      u64 per block + 1: byte offsets in the packed area
    exception starts   u64 per block + 1: indexes in the exception lists
    exception places   u8 per exception: place in its block
    exception values   u32 per exception: the whole difference to the minimum
    packed area        the low bits of every difference, high bit first

Any range of ids can be decoded from the starts of its blocks alone. A folder of segments is a
Parquet table (``part``, ``segment``, ``n_tokens``, ``doc_ids``, ``lengths``, ``payload``), so Spark's
committer makes the write whole or void, and ``start`` tables need no payload.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.base import gathered, slices, texts
from tidemark.llm.word_ids import WordIds

MAGIC = b"PFR1"
BLOCK = 128
PERCENTILES = (0.75, 0.9, 0.97, 1.0)
EXCEPTION_BITS = 40
SEGMENT_TOKENS = 1 << 19
SLICE = 1 << 23
SCHEMA = "part int, segment int, n_tokens long, doc_ids array<long>, lengths array<long>, payload binary"


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit length of each number."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)


def _beyond(rest: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Which differences do not fit the width of their block."""
    return rest > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]


def _widths(rest: np.ndarray) -> np.ndarray:
    """Per block the width of the percentile that makes it smallest, with its exceptions."""
    best = cost = None
    ordered = np.sort(rest, axis=1)
    for p in PERCENTILES:
        width = _bits(ordered[:, max(0, int(np.ceil(BLOCK * p)) - 1)])
        beyond = _beyond(rest, width).sum(axis=1)
        now = width.astype(np.int64) * BLOCK + EXCEPTION_BITS * beyond
        best = width if best is None else np.where(now < cost, width, best)
        cost = now if cost is None else np.minimum(now, cost)
    return best.astype(np.uint8)


def encode(ids: np.ndarray) -> bytes:
    """The payload of unsigned 32-bit ids."""
    ids = np.asarray(ids, np.uint32)
    blocks = -(-len(ids) // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    if blocks:
        padded[len(ids):] = ids[-1]
    padded = padded.reshape(blocks, BLOCK)
    low = padded.min(axis=1) if blocks else np.empty(0, np.uint32)
    rest = padded - low[:, None]
    width = _widths(rest) if blocks else np.empty(0, np.uint8)
    outlier = _beyond(rest, width)
    block_of, place = np.nonzero(outlier)
    exceptions = np.concatenate(([0], np.cumsum(outlier.sum(axis=1)))).astype("<u8")
    starts = np.concatenate(([0], np.cumsum(width.astype(np.uint64) * (BLOCK // 8)))).astype("<u8")
    packed = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        lane = 16 if w <= 16 else 32
        low_part = np.where(outlier[own], 0, rest[own]).astype(f">u{lane // 8}")
        bits = np.unpackbits(low_part.view(np.uint8).reshape(len(own), BLOCK, lane // 8), axis=2)
        body = np.packbits(bits[:, :, lane - w:].reshape(len(own), -1), axis=1)
        packed[starts[own].astype(np.int64)[:, None] + np.arange(body.shape[1])] = body
    return b"".join([
        MAGIC, struct.pack("<IQQ", BLOCK, len(ids), blocks), low.astype("<u4").tobytes(), width.tobytes(),
        starts.tobytes(), exceptions.tobytes(), place.astype(np.uint8).tobytes(),
        rest[block_of, place].astype("<u4").tobytes(), packed.tobytes()])


class Segment:
    """Random access to a payload: ``ids(a, b)`` decodes only the blocks that hold the range."""

    def __init__(self, payload: bytes):
        if bytes(payload[:4]) != MAGIC:
            raise ValueError("not a token segment")
        self.block, self.n, blocks = struct.unpack_from("<IQQ", payload, 4)
        at = 24
        fields = []
        for kind, count in (("<u4", blocks), ("u1", blocks), ("<u8", blocks + 1), ("<u8", blocks + 1)):
            fields.append(np.frombuffer(payload, kind, count, at))
            at += fields[-1].nbytes
        self.low, self.width, self.starts, self.exceptions = fields
        count = int(self.exceptions[-1])
        self.places = np.frombuffer(payload, "u1", count, at)
        self.values = np.frombuffer(payload, "<u4", count, at + count)
        self.packed = np.frombuffer(payload, np.uint8, offset=at + 5 * count)

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        b = self.n if b is None else min(b, self.n)
        if a >= b:
            return np.empty(0, np.uint32)
        first, last = a // self.block, -(-b // self.block)
        width = self.width[first:last]
        out = np.zeros((last - first, self.block), np.uint32)
        for w in np.unique(width[width > 0]).tolist():
            own = np.flatnonzero(width == w)
            size = w * self.block // 8
            body = self.packed[self.starts[first + own].astype(np.int64)[:, None] + np.arange(size)]
            lane = 16 if w <= 16 else 32
            bits = np.zeros((len(own), self.block, lane), np.uint8)
            bits[:, :, lane - w:] = np.unpackbits(body, axis=1).reshape(len(own), self.block, w)
            out[own] = np.packbits(bits, axis=2).view(f">u{lane // 8}").reshape(len(own), self.block)
        begin, end = int(self.exceptions[first]), int(self.exceptions[last])
        block_of = np.repeat(np.arange(last - first), np.diff(self.exceptions[first:last + 1].astype(np.int64)))
        out[block_of, self.places[begin:end]] = self.values[begin:end]
        out += self.low[first:last, None]
        return out.reshape(-1)[a - first * self.block:b - first * self.block]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts, each followed by ``end_id``, in ascending order of the id column.

    Null text is empty; null ids come first; rows that repeat an id follow each other in the order of
    a hash of their text, so that one id with very many rows still spreads over tasks. Equal rows are
    written as often as they occur; an empty table makes a folder without segments. ``tokenizer`` is a
    path every executor can open.
    """
    place = ["doc_id", "mark"]
    ordered = texts(docs, id_col, text_col).withColumn("mark", F.xxhash64("text")).repartitionByRange(*place)
    ordered = ordered.sortWithinPartitions(*place, "text").drop("mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder, part, number = WordIds.of_worker(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # doc ids, lengths, ids
        total = 0

        def segment() -> pa.RecordBatch:
            lengths = np.concatenate([h[1] for h in held])
            payload = encode(np.concatenate([h[2] for h in held]))
            doc_ids = pa.concat_arrays([h[0] for h in held])
            whole = pa.array([0, len(lengths)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([total], pa.int64()),
                 pa.ListArray.from_arrays(whole, doc_ids), pa.ListArray.from_arrays(whole, pa.array(lengths)),
                 pa.array([payload], pa.binary())],
                ["part", "segment", "n_tokens", "doc_ids", "lengths", "payload"])

        for piece in slices(gathered(batches, least=SLICE), most=SLICE):
            ids, edges = encoder(piece.column("text"))
            ids = np.insert(ids, edges[1:], end_id)
            ends = edges[1:] + np.arange(1, len(edges))
            lengths, at = np.diff(ends, prepend=0), 0
            while at < len(ends):
                begin = int(ends[at] - lengths[at])
                # up to the document with which the segment is full
                to = min(int(np.searchsorted(ends, begin + SEGMENT_TOKENS - total)) + 1, len(ends))
                held.append((piece.column("doc_id").slice(at, to - at), lengths[at:to], ids[begin:ends[to - 1]]))
                total, at = total + int(ends[to - 1]) - begin, to
                if total >= SEGMENT_TOKENS:
                    yield segment()
                    held, total, number = [], 0, number + 1
        if held:
            yield segment()

    ordered.mapInArrow(run, SCHEMA).write.option("compression", "uncompressed").parquet(path)


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """(``part``, ``segment``, ``start``): the ids before each segment. Only counts are read; the one
    window over all parts has a row per part."""
    counts = spark.read.schema(SCHEMA).parquet(path).select("part", "segment", "n_tokens")
    parts = counts.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    own = counts.withColumn("own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return own.join(parts, "part").select("part", "segment", (F.col("own") + F.col("before")).alias("start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the payloads: ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = Segment(batch.column("payload")[row].as_buffer()).ids().astype("<u4", copy=False)
                lengths = batch.column("lengths")[row].values.to_numpy()
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n:e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                count = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(count, batch.column("part")[row].as_py(), np.int32)),
                     pa.array(np.full(count, batch.column("segment")[row].as_py(), np.int32)),
                     batch.column("doc_ids")[row].values, pa.array(ends - lengths), pa.array(lengths),
                     pa.array(crc, pa.int64())],
                    ["part", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(SCHEMA).parquet(path).select("part", "segment", "doc_ids", "lengths", "payload")
    found = rows.mapInArrow(run, "part int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return found.join(segment_starts(spark, path), ["part", "segment"]).select(
        "doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """(``position``, ``id``) of the ids ``first`` to ``last`` - 1: segments outside are not decoded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload").to_pylist()):
                segment = Segment(payload)
                a = max(0, first - start)
                ids = segment.ids(a, min(segment.n, last - start))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(ids), dtype=np.int64) + start + a), pa.array(ids.astype(np.int64))], ["position", "id"])

    starts = segment_starts(spark, path).filter((F.col("start") < last))
    rows = spark.read.schema(SCHEMA).parquet(path).join(starts, ["part", "segment"])
    rows = rows.filter(F.col("start") + F.col("n_tokens") > first).select("start", "payload")
    return rows.mapInArrow(run, "position long, id long")
