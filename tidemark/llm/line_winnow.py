"""Line dedup by winnowing over line hashes.

Physical lines end anywhere, so a line here is ``LINE`` consecutive words from any word on. In each
window of lines that covers ``min_words`` words the smallest line hash (of equals the last) is selected: two
documents that share a run of that many words share a window, and so its fingerprint, for certain.

A selected line stands for all windows whose minimum it is; together they are one stretch of words.
Positions with the same fingerprint are joined. Equal stretches form a class, of which all but the first
in the order of doc_id repeat it whole: long matches extend from stretch to stretch that way. Where
a fingerprint has several classes, a match ends inside a stretch, and the first of each class is
extended word by word: its windows are compared one by one. The union of the repeated windows of a document
is the union of its repeated runs, exactly, and no pair of documents is ever formed.

Texts only move for documents in which something repeats: a bit map of bounded size tells most of the
others apart before a join does so exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import likely, rows, slices
from tidemark.session import cut_lineage

LINE = 8
SLICE = 1 << 22
PLACE_BITS = 30
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
PLACES = "doc_id long, version long, place int, left int, right int, fp long, cls long"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of some texts in a row, with a hash of any stretch of them."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(texts)
        flat, edges = split.flatten(), split.offsets.to_numpy().astype(np.int64)
        found = flat.dictionary_encode()
        distinct = found.dictionary.to_numpy(zero_copy_only=False)
        real = np.fromiter(map(bool, distinct), bool, len(distinct))  # white space at an end leaves an empty word
        hashes = pd.util.hash_array(distinct, categorize=False) if len(distinct) else np.empty(0, np.uint64)
        codes = found.indices.to_numpy()
        kept = real[codes] if len(codes) else np.empty(0, bool)
        self.edges = np.concatenate(([0], np.cumsum(kept)))[edges - edges[0]]
        own = hashes[codes[kept]]
        self.n = len(own)
        self.text_of = np.repeat(np.arange(len(texts)), np.diff(self.edges))
        powers = np.full(self.n + 1, BASE, np.uint64)
        self.back = np.full(self.n + 1, INVERSE, np.uint64)
        powers[0] = self.back[0] = 1
        powers, self.back = np.cumprod(powers), np.cumprod(self.back)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own * powers[:-1])))

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words from ``start`` to before ``end``, the same wherever they stand."""
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start])


def _minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive numbers."""
    done = 1
    while 2 * done <= width:
        keys = np.minimum(keys[:-done], keys[done:])
        done *= 2
    return np.minimum(keys[:len(keys) - (width - done)], keys[width - done:]) if done < width else keys


def selected(words: Words, min_words: int) -> tuple[np.ndarray, ...]:
    """(text, place, left, right, fingerprint, class) of the selected lines.

    ``place`` counts words in the text. The windows that the line stands for begin ``left`` to ``right`` words
    before it; the class is the hash of all their words and of where the line stands in them.
    """
    line = min(LINE, min_words)
    width = min_words - line + 1
    starts = np.arange(words.n - min_words + 1) if words.n >= min_words else np.empty(0, np.int64)
    if not len(starts):
        return (np.empty(0, np.int64),) * 6
    lines = words.stretch(np.arange(words.n - line + 1), np.arange(line, words.n + 1))
    # the last place of equal hashes wins: it has the smaller complement
    low = np.uint64((1 << PLACE_BITS) - 1)
    keys = (lines & ~low) | (low - np.arange(len(lines), dtype=np.uint64))
    least = (low - (_minima(keys, width) & low)).astype(np.int64)
    inside = words.text_of[starts] == words.text_of[starts + min_words - 1]
    starts, least = starts[inside], least[inside]
    if not len(starts):
        return (np.empty(0, np.int64),) * 6
    begin = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (words.text_of[starts[1:]] != words.text_of[starts[:-1]]))))
    end = np.concatenate((begin[1:], [len(starts)])) - 1
    at, first, last = least[begin], starts[begin], starts[end]
    text = words.text_of[first]
    left, right = at - first, at - last
    cls = _mixed(words.stretch(first, last + min_words) + (left * 64 + right).astype(np.uint64) * np.uint64(BASE))
    return text, at - words.edges[text], left, right, lines[at].view(np.int64), cls.view(np.int64)


def _places(docs: DataFrame, min_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=SLICE):
            text, place, left, right, fp, cls = selected(Words(part.column("text")), min_words)
            keys = [part.column(c).take(pa.array(text, pa.int64())) for c in ("doc_id", "version")]
            small = [pa.array(x.astype(np.int32)) for x in (place, left, right)]
            yield pa.RecordBatch.from_arrays(keys + small + [pa.array(fp), pa.array(cls)],
                                             ["doc_id", "version", "place", "left", "right", "fp", "cls"])

    return docs.select("doc_id", "version", "text").mapInArrow(run, PLACES)


def _windows(docs: DataFrame, min_words: int) -> DataFrame:
    """(``content``, ``doc_id``, ``version``, ``start``) of the windows of the lines in ``open``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=SLICE):
            words = Words(part.column("text"))
            listed = part.column("open")
            held = listed.flatten()
            of = np.repeat(np.arange(part.num_rows), np.diff(listed.offsets.to_numpy()))
            place, left, right = (held.field(c).to_numpy().astype(np.int64) for c in ("place", "left", "right"))
            sizes = left - right + 1
            of, first = np.repeat(of, sizes), np.repeat(place - left, sizes)
            start = first + np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            absolute = words.edges[of] + start
            content = words.stretch(absolute, absolute + min_words).view(np.int64)
            keys = [part.column(c).take(pa.array(of)) for c in ("doc_id", "version")]
            yield pa.RecordBatch.from_arrays([pa.array(content), *keys, pa.array(start.astype(np.int32))], ["content", "doc_id", "version", "start"])

    return docs.select("doc_id", "version", "text", "open").mapInArrow(run, "content long, doc_id long, version long, start int")


def _same(a: str, b: str):
    return F.col(f"{a}doc_id").eqNullSafe(F.col(f"{b}doc_id")) & (F.col(f"{a}version") == F.col(f"{b}version"))


def _key():
    return F.xxhash64("doc_id", "version")


def repeated_spans(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(``doc_id``, ``version``, ``spans`` array of (first, end) word) of documents with repeats.

    ``docs`` has ``doc_id``, ``version`` (a hash of the text) and ``text``. Rows equal in both are one
    document. The window that comes first in (doc_id, version, word) stays; a null doc_id sorts
    first. A window that overlaps the first one in its own document is no repeat.
    """
    found = cut_lineage(_places(docs, min_words))
    place = F.struct("doc_id", "version", "place")
    # rows that are the same document meet here as equal places
    met = found.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.min("cls").alias("c"), F.max("cls").alias("d"))
    shared = cut_lineage(met.filter("a != b").select("fp", (F.col("c") != F.col("d")).alias("several")))
    held = cut_lineage(likely(found, F.col("fp"), shared.select("fp")).join(shared, "fp").distinct())
    # written, so that the join meets plain tables and AQE can split a class with very many members
    firsts = held.groupBy("fp", "cls").agg(F.min(place).alias("kept"), F.max(place).alias("last")).filter("kept != last")
    judged = held.join(cut_lineage(firsts.select("fp", "cls", "kept")), ["fp", "cls"], "left")
    near = F.col("kept").isNull() | _same("", "kept.") & (F.col("place") - F.col("kept.place") < min_words)  # the first one itself too
    judged = cut_lineage(judged.select(
        "doc_id", "version", "place", "left", "right", "several", near.alias("near")))
    whole = judged.filter(~F.col("near")).select(
        "doc_id", "version", (F.col("place") - F.col("left")).alias("first"), (F.col("place") - F.col("right") + min_words).alias("end"))
    # the others of fingerprints with several classes, window by window
    opened = judged.filter("near and several").groupBy("doc_id", "version").agg(
        F.collect_list(F.struct("place", "left", "right")).alias("open"))
    opened = cut_lineage(opened).withColumnsRenamed({"doc_id": "o_doc_id", "version": "o_version"})
    some = likely(docs, _key(), opened.select(F.xxhash64("o_doc_id", "o_version")))
    texts = some.join(opened, _same("", "o_")).groupBy("doc_id", "version").agg(F.first("text").alias("text"), F.first("open").alias("open"))
    windows = cut_lineage(_windows(texts, min_words))
    start = F.struct("doc_id", "version", "start")
    kept = windows.groupBy("content").agg(F.min(start).alias("kept"), F.max(start).alias("last")).filter("kept != last")
    kept = cut_lineage(kept.select("content", "kept"))
    again = windows.join(kept, "content").filter(~_same("", "kept.") | (F.col("start") - F.col("kept.start") >= min_words))
    single = again.select("doc_id", "version", F.col("start").alias("first"), (F.col("start") + min_words).alias("end"))
    return whole.unionByName(single).groupBy("doc_id", "version").agg(F.collect_set(F.struct("first", "end")).alias("spans"))


def cut_words(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(text without the words of the spans, words removed, words left).

    A line that loses all its words goes; what is left of one that loses some is joined by a space.
    Other lines stay as they are.
    """
    lines, out, at, removed, left = raw.split(b"\n"), [], 0, 0, 0
    change = np.zeros(max((e for _, e in spans), default=0) + 1, np.int32)
    for first, end in spans:
        change[first] += 1
        change[end] -= 1
    gone = np.cumsum(change) > 0
    for line in lines:
        places = [m.span() for m in WORD.finditer(line)]
        own = gone[at:at + len(places)]
        lost = int(own.sum())
        at, removed, left = at + len(places), removed + lost, left + len(places) - lost
        if not lost:
            out.append(line)
        elif lost < len(places):
            own = np.concatenate((own, np.zeros(len(places) - len(own), bool)))
            edges = np.flatnonzero(np.diff(np.concatenate(([True], own, [True])).astype(np.int8)))
            out.append(b" ".join(line[places[a][0]:places[b - 1][1]] for a, b in zip(edges[::2], edges[1::2])))
    return b"\n".join(out), removed, left


def _cut(docs: DataFrame) -> DataFrame:
    """Rows with ``text`` and ``spans`` to rows with the text that is left; other columns pass."""
    names = [c for c in docs.columns if c not in ("text", "spans")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=SLICE):
            texts = part.column("text").cast(pa.binary()).to_numpy(zero_copy_only=False)
            spans = part.column("spans")
            edges = spans.offsets.to_numpy() - spans.offsets.to_numpy()[0]
            first, end = (spans.flatten().field(c).to_numpy() for c in ("first", "end"))
            done = [cut_words(t, list(zip(first[a:b].tolist(), end[a:b].tolist()))) for t, a, b in zip(texts, edges, edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in names], part.column("spans"),
                 pa.array([d[0] for d in done], pa.binary()).cast(pa.string()),
                 pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
                [*names, "spans", "text", "n_removed", "n_left"])

    from pyspark.sql.types import LongType, StructType

    schema = StructType([docs.schema[c] for c in [*names, "spans", "text"]]).add("n_removed", LongType()).add("n_left", LongType())
    return docs.select(*names, "spans", "text").mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row as struct ``row``, with ``doc_id``, ``text`` without its repeated runs, the number of
    words ``n_removed`` and ``n_left`` (null where nothing was removed), and ``spans`` of words.

    Null text is empty. Rows that repeat doc_id and text are the same document and get the same result;
    of equal texts with different ids the one with the smallest id stays, a null id counting as the
    smallest. An empty table gives no rows.
    """
    marked = rows(docs, id_col, text_col).withColumn("version", F.xxhash64("text"))
    spans = cut_lineage(repeated_spans(marked.select("doc_id", "version", "text"), min_words))
    spans = spans.withColumnsRenamed({"doc_id": "s_doc_id", "version": "s_version"})
    # most documents pass without a shuffle; of the others the join decides
    split = likely(marked, _key(), spans.select(F.xxhash64("s_doc_id", "s_version")), flag="maybe")
    joined = split.filter("maybe").join(spans, _same("", "s_"), "left")
    columns = ["row", "doc_id", "text", "n_removed", "n_left", "spans"]
    none = {"n_removed": F.lit(0).cast("long"), "n_left": F.lit(None).cast("long"), "spans": F.lit(None).cast(spans.schema["spans"].dataType)}
    touched = _cut(joined.filter("spans is not null").select("row", "doc_id", "text", "spans")).select(*columns)
    kept = split.filter(~F.col("maybe")).withColumns(none).select(*columns)
    also = joined.filter("spans is null").drop("spans").withColumns(none).select(*columns)
    return kept.unionByName(also).unionByName(touched)


def clean(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text",
          length_col: str | None = "n_chars") -> DataFrame:
    """The columns of ``docs`` with the repeated runs cut out of the text, and ``length_col`` (if there
    is such a column) set to the new length of texts that changed. Documents of which no word
    is left are dropped; a document that had none before stays, null texts stay null.
    """
    df = dedup_lines(docs, min_words, id_col, text_col).filter("n_removed = 0 or n_left > 0")
    values = []
    for name, kind in docs.dtypes:
        value = F.col("row").getField(name)
        if name == text_col:
            value = F.when(F.col("n_removed") > 0, F.col("text")).otherwise(value)
        elif name == length_col:
            value = F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(value)
        values.append(value.alias(name))
    return df.select(*values)
