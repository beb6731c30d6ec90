"""Benchmark decontamination: a BM25 index of test items, searched by block-max WAND.

Every passage of every document (``PASSAGE`` words, a new one each ``STRIDE`` words) is a query. An
item's impacts are divided by its own score, so a passage with all words of an item scores 1 and one
threshold serves items of any length. A passage is retrieved for every item part that reaches the
threshold; a hit counts when both question and answer overlap in five-word shingles, or in shorter ones
where a side has so few words that one edited word breaks more than a fifth of its shingles, or when the
passage holds the item's words without a change.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import broadcast_object, likely, rows, slices, texts, unpack, utf8
from tidemark.session import cut_lineage

STRIDE = 64
PASSAGE = 2 * STRIDE
BLOCK = 32
RANGES = 64
K1, B = 1.2, 0.75
SHINGLE = 5
WORD = re.compile(r"[^\W_]+")


def tokens(raw: bytes) -> list[bytes]:
    """Runs of letters and digits, A-Z in lower case: no mark beside a word or in it makes another word."""
    return " ".join(WORD.findall(raw.lower().decode("utf-8", "replace"))).encode().split()


def question_and_answer(raw: bytes) -> tuple[list[bytes], list[bytes]]:
    """The answer is what follows the last question mark, else the last sentence or line, else the
    last third of the words; the question is what comes before it."""
    text = raw.strip()
    cut = text.rfind(b"?") + 1 if b"?" in text[:-1] else max(text.rfind(b". ", 0, -1), text.rfind(b"\n")) + 1
    question, answer = tokens(text[:cut]), tokens(text[cut:])
    if not question or not answer:
        every = tokens(text)
        third = max(1, len(every) // 3)
        question, answer = every[:-third], every[-third:]
    return question, answer


def shingles(found: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    return {tuple(found[i:i + size]) for i in range(len(found) - size + 1)}


class Side:
    """Question or answer of an item, held against a region of a document."""

    def __init__(self, found: list[bytes]):
        self.n = len(found)
        self.size = min(SHINGLE, self.n)
        self.whole = shingles(found, self.size) if found else set()
        # the longest shingles of which one edited word breaks at most a fifth
        self.short = max(1, min(SHINGLE, (self.n + 1) // 6))
        self.parts = Counter(tuple(found[i:i + self.short]) for i in range(self.n - self.short + 1))

    def share(self, region: list[bytes]) -> float:
        """Share of the shingles that the region holds; the short ones have to be in twice the side's length."""
        if not self.n:
            return 1.0
        best = len(self.whole & shingles(region, self.size)) / len(self.whole)
        if self.short == SHINGLE or best == 1.0:
            return best
        for at in range(0, len(region), self.n):
            near = region[at:at + 2 * self.n]
            held = Counter(tuple(near[i:i + self.short]) for i in range(len(near) - self.short + 1))
            best = max(best, sum((self.parts & held).values()) / (self.n - self.short + 1))
        return best


def parts_of(found: list[bytes]) -> list[Counter]:
    """An item's words in parts of at most ``STRIDE``, the last one reaching back."""
    return [Counter(found[max(0, min(at, len(found) - STRIDE)):at + STRIDE]) for at in range(0, len(found), STRIDE)]


def counts_of(parts: list[Counter]) -> tuple[dict[bytes, int], int, float]:
    """(parts that hold each word, number of parts, their mean length)."""
    return Counter(w for p in parts for w in p), len(parts), sum(sum(p.values()) for p in parts) / max(1, len(parts))


class Index:
    """Inverted index of item parts of at most ``STRIDE`` words: a passage holds any part whole."""

    def __init__(self, items: Iterable[tuple[int, bytes]], counts: tuple[dict[bytes, int], int, float] | None = None):
        """``counts``: the parts that hold each word, all parts, their mean length; if left out, those of these
        items. An item is known by its place among those with a word, as ids may repeat."""
        self.terms: dict[bytes, int] = {}
        self.item: list[int] = []
        self.ids: list[int] = []
        self.sides: list[list[Side]] = []
        self.length: list[int] = []
        self.joined: list[bytes] = []
        found_parts = []
        for item, raw in items:
            found = tokens(raw)
            if not found:
                continue
            self.ids.append(item)
            self.sides.append([Side(x) for x in question_and_answer(raw)])
            self.length.append(len(found))
            self.joined.append(b" ".join(found))
            for part in parts_of(found):
                found_parts.append(part)
                self.item.append(len(self.ids) - 1)
        parts = found_parts
        df, total, mean = counts or counts_of(parts)
        postings: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        for number, part in enumerate(parts):
            size = sum(part.values())
            impact = {
                w: math.log(1 + (total - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * size / mean))
                for w, n in part.items()}
            whole = sum(impact.values())
            for w, x in impact.items():
                postings[w].append((number, x / whole))
        self.parts: list[list[int]] = []
        self.impacts: list[list[float]] = []
        self.block_last: list[list[int]] = []
        self.block_top: list[list[float]] = []
        for w, posted in postings.items():
            self.terms[w] = len(self.parts)
            self.parts.append([p for p, _ in posted])
            self.impacts.append([x for _, x in posted])
            blocks = [posted[i:i + BLOCK] for i in range(0, len(posted), BLOCK)]
            self.block_last.append([b[-1][0] for b in blocks])
            self.block_top.append([max(x for _, x in b) for b in blocks])
        self.top = np.array([max(b) for b in self.block_top], np.float64)
        # the highest impact of each term in each of RANGES equal ranges of parts; last row: unknown
        self.range_top = np.zeros((len(self.parts) + 1, RANGES), np.float32)
        for t, (own, impacts) in enumerate(zip(self.parts, self.impacts)):
            np.maximum.at(self.range_top[t], np.array(own) * RANGES // len(self.item), np.array(impacts, np.float32))

    def search(self, terms: Iterable[int], threshold: float) -> list[tuple[int, float]]:
        """(part, score) of every part with a score of at least ``threshold``: block-max WAND."""
        threshold -= 1e-9
        cursors = [[self.parts[t][0], t, 0] for t in terms]
        found = []

        def forward(moved: list[list[int]], target: int) -> None:
            for c in moved:
                if c[0] < target:
                    c[2] = bisect_left(self.parts[c[1]], target, c[2])
                    c[0] = self.parts[c[1]][c[2]] if c[2] < len(self.parts[c[1]]) else -1

        while True:
            cursors = [c for c in cursors if c[0] >= 0]
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += self.top[c[1]]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                return found
            part = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == part:
                pivot += 1
            head = cursors[:pivot + 1]
            bound, end = 0.0, len(self.item)
            for _, t, _ in head:
                k = bisect_left(self.block_last[t], part)
                if k < len(self.block_last[t]):
                    bound += self.block_top[t][k]
                    end = min(end, self.block_last[t][k])
            if bound < threshold:
                # nothing up to the end of the nearest block can reach the threshold
                after = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(self.item)
                forward(head, min(end + 1, after))
            elif head[0][0] == part:
                score = sum(self.impacts[t][at] for _, t, at in head)
                if score >= threshold:
                    found.append((part, score))
                forward(head, part + 1)
            else:
                forward(head, part)

    def hits(self, found: list[bytes], threshold: float, overlap: float,
             passages: Iterable[int]) -> dict[int, tuple[float, float, float, int]]:
        """Per item, by its place in ``ids``, the verified hit with the best score: (score, question, answer, first word)."""
        best: dict[int, tuple[float, float, float, int]] = {}
        for at in passages:
            terms = {t for t in map(self.terms.get, found[at:at + PASSAGE]) if t is not None}
            for part, score in self.search(terms, threshold):
                item = self.item[part]
                if item in best and best[item][0] >= score:
                    continue
                reach = self.length[item]
                region = found[max(0, at - reach):at + PASSAGE + reach]
                shares = [side.share(region) for side in self.sides[item]]
                if min(shares) < overlap and self.joined[item] in b" ".join(region):
                    shares = [1.0] * len(shares)  # word for word, with letters beside its ends
                if min(shares) >= overlap:
                    best[item] = (score, *shares, at)
        return best


def reached(index: Index, docs: list[list[bytes]], threshold: float) -> Iterator[tuple[int, list[int]]]:
    """(document, first words of its passages) that may reach the threshold.

    The passages of all ``docs`` are bounded together: a passage is passed over when in no range of
    parts the highest impacts of its distinct terms add up to the threshold.
    """
    sizes = np.array([len(d) for d in docs], np.int64)
    blocks = -(-sizes // STRIDE)
    first = np.concatenate(([0], np.cumsum(blocks)))
    unknown = len(index.parts)
    get = index.terms.get
    term = np.array([get(w, unknown) for d in docs for w in d], np.int64)
    if not len(term):
        return
    place = np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    block = np.repeat(first[:-1], sizes) + place // STRIDE
    # passage k holds blocks k and k + 1 of its document
    before = (place >= STRIDE) & (term < unknown)
    known = term < unknown
    pairs = np.unique(np.concatenate((block[known], block[before] - 1)) * unknown + np.concatenate((term[known], term[before])))
    if not len(pairs):
        return
    passage, of = np.divmod(pairs, unknown)
    begin = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
    bound = np.add.reduceat(index.range_top[of], begin, axis=0).max(axis=1)
    hit = passage[begin][bound >= threshold - 1e-3]
    doc = np.searchsorted(first, hit, side="right") - 1
    for i in np.unique(doc).tolist():
        yield i, ((hit[doc == i] - first[i]) * STRIDE).tolist()


def _search(index: Index, batches: Iterator[pa.RecordBatch], threshold: float, overlap: float) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        docs = [tokens(t) for t in utf8(part.column("text"))]
        out = []
        for i, passages in reached(index, docs, threshold):
            for item, hit in index.hits(docs[i], threshold, overlap, passages).items():
                out.append((i, index.ids[item], *hit))
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(cols[0], pa.int32())),
                 part.column("version").take(pa.array(cols[0], pa.int32())), pa.array(cols[1], pa.int64()),
                 *[pa.array(c, pa.float64()) for c in cols[2:5]], pa.array(cols[5], pa.int64())],
                ["doc_id", "version", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block of items the parts that hold each word; the row without a word counts all parts and their words."""
    for piece in slices(batches):
        sums: dict[tuple[int, bytes | None], list[int]] = defaultdict(lambda: [0, 0])
        for block, raw in zip(piece.column("block").to_pylist(), utf8(piece.column("text"))):
            for part in parts_of(tokens(raw)):
                every = sums[block, None]
                every[0] += 1
                every[1] += sum(part.values())
                for w in part:
                    sums[block, w][0] += 1
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in sums], pa.int32()), pa.array([w for _, w in sums], pa.binary()),
                 pa.array([p for p, _ in sums.values()], pa.int64()), pa.array([n for _, n in sums.values()], pa.int64())],
                ["block", "term", "parts", "words"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, overlap: float = 0.8,
               index_words: int = 200_000, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per leaked item and document: ``doc_id``, ``version`` (hash of the text), ``item_id``,
    ``score``, ``question_overlap``, ``answer_overlap``, ``first_word`` of the passage.

    The items are indexed in blocks of about ``index_words`` words (the bound of what is broadcast at
    once); every document is searched against each block. A word's weight and the mean length come from
    all items, so a score does not depend on the blocks. Null texts and items without a word match
    nothing; items with a null id are left out, as a hit could not be named. Items that repeat an id
    are searched apart, and the best hit is returned. Rows that repeat doc_id and text give one row.
    """
    spark = docs.sparkSession
    marked = texts(docs, id_col, text_col).withColumn("version", F.xxhash64("text"))
    items = texts(benchmark, item_col, item_text_col).filter("doc_id is not null").distinct()
    items = items.withColumn("n", F.size(F.split("text", r"\s+")))
    items = cut_lineage(items.withColumn("h", F.xxhash64("doc_id", "text")))
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-int(total) // index_words))
    # a block holds about index_words words, whatever the number of items
    own = F.pmod(F.col("h"), F.lit(blocks)).cast("int")
    held = cut_lineage(items.select(own.alias("block"), "text").mapInArrow(_count_words, "block int, term binary, parts long, words long"))
    sums = held.filter("term is null").agg(F.sum("parts"), F.sum("words")).first()
    n_parts, n_words = (int(x or 0) for x in sums)
    df = cut_lineage(held.filter("term is not null").groupBy("term").agg(F.sum("parts").alias("parts")))
    out = None
    for k in range(blocks):
        ours = df.join(held.filter(F.col("block") == k).select("term").distinct(), "term", "left_semi").collect()
        counts = {bytes(r["term"]): r["parts"] for r in ours}, n_parts, n_words / max(1, n_parts)
        rows_ = items.filter(own == k).orderBy("doc_id", "text").collect()
        index = broadcast_object(spark, Index(((r.doc_id, r.text.encode()) for r in rows_), counts))

        def run(batches, index=index):
            return _search(index(), batches, threshold, overlap)

        found = marked.mapInArrow(
            run, "doc_id long, version long, item_id long, score double, question_overlap double, answer_overlap double, first_word long")
        if blocks > 1:
            found = cut_lineage(found)  # one block's index at a time
        out = found if out is None else out.union(found)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap", "first_word")).alias("b")
    return out.groupBy("doc_id", "version", "item_id").agg(best).select("doc_id", "version", "item_id", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no item leaks, with their own columns.

    Null and empty texts stay, as do all rows of a table without items; rows that repeat id and text
    share their fate, each with its own columns; an empty table stays empty.
    """
    leaks = find_leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    leaks = cut_lineage(leaks.select(F.col("doc_id").alias("l_id"), F.col("version").alias("l_version")).distinct())
    marked = rows(docs, id_col, text_col).withColumn("version", F.xxhash64("text")).drop("text")
    split = likely(marked, F.xxhash64("doc_id", "version"), leaks.select(F.xxhash64("l_id", "l_version")), flag="maybe")
    same = F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("version") == F.col("l_version"))
    rest = split.filter("maybe").join(leaks, same, "left_anti")
    return unpack(split.filter(~F.col("maybe")).select("row").union(rest.select("row")), docs)
