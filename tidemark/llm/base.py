"""What the operators share: safe column access, row keys, bounded slices of Arrow batches, words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import tidemark

# tasks get the functions of this package with the task, so executors need no copy of it
cloudpickle.register_pickle_by_value(tidemark)

SLICE_BYTES = 1 << 20


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (null: empty), whatever else the frame holds."""
    return docs.select(
        column(id_col).cast("long").alias("doc_id"),
        F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"),
    )


def rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (all columns as one struct, so no name can clash), ``doc_id`` and ``text``."""
    return docs.select(
        F.struct(*[column(c) for c in docs.columns]).alias("row"),
        column(id_col).cast("long").alias("doc_id"),
        F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"),
    )


def unpack(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns that ``rows`` packed."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in like.columns])


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``most`` bytes of text, or one longer row.

    Python objects made from a slice then stay within a small multiple of that.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes.astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def utf8(col: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column, null as empty."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case: both bytes methods are ASCII only."""
    return raw.lower().split()


def crc_remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(modulus))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """A table for each run of equal values of the integer column ``key``; holds one run at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), batch.num_rows]
        if held and held[-1].column(key)[-1].as_py() != values[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts, cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def broadcast_object(spark, value):
    """A function that gives ``value`` in a task; its classes travel with it."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(sent.value)


def gathered(batches: Iterator[pa.RecordBatch], text: str = "text", least: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold ``least`` bytes of text, for work that shares words within one."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text).nbytes
        if size >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


LIKELY_BITS = 1 << 23


def likely(df: DataFrame, key: Column, wanted: DataFrame, flag: str | None = None) -> DataFrame:
    """The rows of ``df`` whose ``key`` (a long) may be in ``wanted`` (one long column), and few others; with
    ``flag`` all rows, with that boolean column.

    ``wanted`` becomes a bit map of ``LIKELY_BITS`` bits, so what is broadcast is at most 131,072 rows of two
    numbers, whatever the size of either side: with very many keys more rows pass, none is lost. Use it
    before a join that decides exactly, to shuffle less.
    """
    def place(k: Column) -> Column:
        return F.pmod(F.xxhash64(k), F.lit(LIKELY_BITS))

    at = place(F.col(wanted.columns[0]))
    bits = wanted.select(F.shiftright(at, 6).cast("int").alias("_word"), F.expr("1L").alias("_one"), at.bitwiseAND(F.lit(63)).cast("int").alias("_bit"))
    bits = bits.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(_one, _bit)")).alias("_bits"))
    own = place(key)
    marked = df.withColumns({"_word": F.shiftright(own, 6).cast("int"), "_bit": own.bitwiseAND(F.lit(63)).cast("int")})
    marked = marked.join(F.broadcast(bits), "_word", "left" if flag else "inner")
    hit = F.coalesce(F.expr("getbit(_bits, _bit)") == 1, F.lit(False))
    out = marked.withColumn(flag, hit) if flag else marked.filter(hit)
    return out.drop("_word", "_bit", "_bits")
