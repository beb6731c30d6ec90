"""Ranked lexical search, term at a time, with limited accumulators.

The documents become blocks of postings of the items' terms, written as a table (a row per block), and
the counts over all documents follow from that table. Every task then searches its blocks for every
item: the rarest term comes first and opens an accumulator for each of its documents. When the terms
that are left, at their highest contributions in the block, cannot lift a new document to the k-th
partial score, no accumulator is opened any more; the survivors get the remaining contributions
exactly. The best k so far of a task are the bar for its next block, and a rank over the tasks' bests
gives the result: nothing but k documents per item and task is shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.base import broadcast_object, column, slices, texts, utf8
from tidemark.session import cut_lineage

BLOCK_DOCS = 8192
BLOCK_POSTINGS = 1 << 19
INDEX_WORDS = 200_000
NO_ID = -(1 << 63)

# ASCII letters and digits and all bytes above ASCII make terms; A-Z in lower case
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

BLOCKS = """n_documents long, n_terms long, ids array<long>, lengths array<long>,
terms array<int>, counts array<int>, docs array<int>, tfs array<int>"""


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(TERM_BYTES).split()


def weight(n_documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


def _index(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Blocks of postings, by term and then by document, of the terms in the vocabulary."""
    ids: list[int] = []
    lengths: list[int] = []
    terms: list[np.ndarray] = []
    tfs: list[np.ndarray] = []
    own: list[int] = []
    postings = 0
    get = vocabulary.get

    def block() -> pa.RecordBatch:
        term = np.concatenate(terms) if terms else np.empty(0, np.int32)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), own)
        order = np.argsort(term, kind="stable")
        different, counts = np.unique(term, return_counts=True)
        tf = np.concatenate(tfs) if tfs else np.empty(0, np.int32)
        columns = [
            (ids, pa.int64()), (lengths, pa.int64()), (different, pa.int32()), (counts.astype(np.int32), pa.int32()),
            (doc[order], pa.int32()), (tf[order], pa.int32())]
        return pa.RecordBatch.from_arrays(
            [pa.array([sum(n > 0 for n in lengths)], pa.int64()), pa.array([sum(lengths)], pa.int64()),
             *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind)) for x, kind in columns]],
            ["n_documents", "n_terms", "ids", "lengths", "terms", "counts", "docs", "tfs"])

    for part in slices(batches):
        for doc, raw in zip(part.column("doc_id").to_pylist(), utf8(part.column("text"))):
            found = terms_of(raw)
            held = np.array([t for t in map(get, found) if t is not None], np.int32)
            term, tf = np.unique(held, return_counts=True)
            ids.append(NO_ID if doc is None else doc)
            lengths.append(len(found))
            own.append(len(term))
            terms.append(term)
            tfs.append(tf.astype(np.int32))
            postings += len(term)
            if len(ids) >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                yield block()
                ids, lengths, terms, tfs, own, postings = [], [], [], [], [], 0
    if ids:
        yield block()


class Block:
    """The postings of a block with the part of each score that does not depend on the item."""

    def __init__(self, row: dict[str, np.ndarray], n_documents: int, n_terms: int):
        self.ids = row["ids"]
        mean = 75 + 25 * row["lengths"] * n_documents // max(1, n_terms)
        self.docs = row["docs"]
        tf = row["tfs"].astype(np.int64)
        self.part = 1_000_000_000 * tf // (1000 * tf + 12 * mean[self.docs])
        ends = np.cumsum(row["counts"])
        self.place = {t: (a, b) for t, a, b in zip(row["terms"].tolist(), (ends - row["counts"]).tolist(), ends.tolist())}
        self.top = dict(zip(self.place, np.maximum.reduceat(self.part, ends - row["counts"]).tolist())) if len(ends) else {}
        self.sums = np.zeros(len(self.ids), np.int64)
        self.has = np.zeros(len(self.ids), bool)

    def search(self, query: list[tuple[int, int]], k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that may be among the best ``k``, of (term, weight times repeats); no
        document with a score below ``bar`` counts."""
        query = [(*self.place[t], w, w * self.top[t]) for t, w in query if w and t in self.place]
        query.sort(key=lambda q: q[1] - q[0])  # the rarest first
        remaining = sum(q[3] for q in query)
        if remaining < max(bar, 1):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        sums, opened = self.sums, np.empty(0, np.int64)
        for at, (a, b, w, top) in enumerate(query):
            docs = self.docs[a:b]
            new = docs[~self.has[docs]]
            self.has[new] = True
            sums[docs] += w * self.part[a:b]
            opened = np.concatenate((opened, new))
            remaining -= top
            kth = bar
            if len(opened) >= k:
                partial = sums[opened]
                kth = max(kth, int(np.partition(partial, len(partial) - k)[len(partial) - k]))
            if remaining < kth:
                break
        else:
            at = len(query)
        # no new accumulators from here on; a survivor can still reach the k-th partial score
        scores = sums[opened]
        sums[opened], self.has[opened] = 0, False
        kept = scores + remaining >= kth
        docs, scores = opened[kept], scores[kept]
        order = np.argsort(docs)
        docs, scores = docs[order], scores[order]
        for a, b, w, top in query[at + 1:]:
            if not len(docs):
                break
            posted = self.docs[a:b]
            where = np.minimum(np.searchsorted(posted, docs), len(posted) - 1)
            scores = scores + np.where(posted[where] == docs, w * self.part[a:b][where], 0)
        return docs, scores


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _search(batches: Iterator[pa.RecordBatch], queries: list[list[tuple[int, int]]], n_documents: int, n_terms: int,
            k: int) -> Iterator[pa.RecordBatch]:
    none = np.empty(0, np.int64)
    best = [(none, none)] * len(queries)
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "lengths", "terms", "counts", "docs", "tfs")}
            block = Block(row, n_documents, n_terms)
            for q, query in enumerate(queries):
                ids, scores = best[q]
                # a document that only equals the k-th score may still have a smaller id
                docs, found = block.search(query, k, int(scores[-1]) if len(scores) == k else 1)
                if len(docs):
                    best[q] = _best(np.concatenate((ids, block.ids[docs])), np.concatenate((scores, found)), k)
    number = np.repeat(np.arange(len(queries)), [len(s) for _, s in best])
    if len(number):
        yield pa.RecordBatch.from_arrays(
            [pa.array(number, pa.int64()), pa.array(np.concatenate([i for i, _ in best])), pa.array(np.concatenate([s for _, s in best]))],
            ["number", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", index_words: int = INDEX_WORDS) -> DataFrame:
    """The ``k`` documents with the highest scores above 0 for each item: ``item_id``, ``rank`` (from 1),
    ``doc_id``, ``score``; equal scores by ascending doc_id.

    Null text holds no term, and neither an item nor a document without a term is in a result. Each
    row is a document of its own, also one that repeats another (they tie), and each item row is an
    item of its own, also with a null or repeated item id. A null doc_id comes before all others. Other
    columns are not read; an empty table on either side gives no rows. Items are searched in groups of
    about ``index_words`` words, which bounds what is broadcast; the counts always cover all documents.
    """
    spark = docs.sparkSession
    listed = items.select(column(item_col).alias("item_id"), F.coalesce(column(item_text_col).cast("string"), F.lit("")).alias("text"))
    listed = cut_lineage(listed.withColumn("n", F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))))
    total = listed.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-int(total) // index_words))
    # equal items get the same group and are told apart inside it
    group = F.pmod(F.xxhash64("item_id", "text"), F.lit(groups))
    plain = texts(docs, id_col, text_col)
    out = None
    for g in range(groups):
        rows = listed.filter(group == g).orderBy("item_id", "text").select("item_id", "text").collect()
        asked = [Counter(terms_of(r.text.encode())) for r in rows]
        vocabulary = {t: n for n, t in enumerate(dict.fromkeys(t for a in asked for t in a))}
        known = broadcast_object(spark, vocabulary)

        def index(batches, known=known):
            return _index(batches, known())

        blocks = cut_lineage(plain.mapInArrow(index, BLOCKS))
        sums = blocks.agg(F.sum("n_documents"), F.sum("n_terms")).first()
        n_documents, n_terms = (int(x or 0) for x in sums)
        # as many rows as the vocabulary has terms, which index_words bounds
        counts = blocks.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("df"))
        df = {r["terms"]: r["df"] for r in counts.collect()}
        weights = {t: weight(n_documents, df[n]) for t, n in vocabulary.items() if n in df}
        asked = [[(vocabulary[t], weights[t] * n) for t, n in a.items() if t in weights] for a in asked]
        sent = broadcast_object(spark, (asked, n_documents, n_terms))

        def run(batches, sent=sent):
            return _search(batches, *sent(), k)

        found = blocks.select("ids", "lengths", "terms", "counts", "docs", "tfs").mapInArrow(run, "number long, doc_id long, score long")
        first = Window.partitionBy("number").orderBy(F.desc("score"), "doc_id")
        found = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
        named = spark.createDataFrame([(n, r.item_id) for n, r in enumerate(rows)], f"number long, item_id {dict(listed.dtypes)['item_id']}")
        found = found.join(F.broadcast(named), "number").select(
            "item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")
        out = found if out is None else out.union(found)
    return out


# the same rows by plain SQL: every term of every document, counted
ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
d AS (SELECT doc_id, terms, len(terms)::BIGINT AS n FROM t WHERE len(terms) > 0),
s AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM d),
m AS (SELECT doc_id, 75 + (25 * n * nd) // l AS m FROM d, s),
q AS (
  SELECT item_id, term, count(*)::BIGINT AS r FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
p AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM p, s GROUP BY term),
c AS (
  SELECT item_id, doc_id, sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM c WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""
