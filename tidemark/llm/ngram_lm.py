"""A bigram language model in Elias-Fano tries, one per shard of contexts.

p(w | u) = (n(u,w) - D) / c(u) + b(u) p(w) over all pairs seen, p(w) add-one smoothed. A text's log10 probability is its unigram score plus the gain of each pair
over the unigram, so every shard can add up its own pairs.

The pairs of all documents are dealt once, by the hash of the context; contexts with many pairs are
spread by the hash of the next word, and pairs with many occurrences by the chunk too; the counts of
such contexts and pairs are added up apart and are the same in each of their shards. A map task sends the different pairs of a chunk with the
documents that hold them, packed, so a frequent pair costs one entry per chunk. The same dealt rows
are counted (training documents only) and then scored (all documents): Spark keeps the shuffle, and
makes lost parts of it anew. No part of the model is bounded by anything but the input.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import broadcast_object, column, runs, slices, utf8, words
from tidemark.llm.elias_fano import Trie
from tidemark.session import cut_lineage

BOS, END = 1, 2
ID_BITS = np.uint64((1 << 48) - 1)
DISCOUNT = 0.75
CHUNK_TOKENS = 1 << 20
CHUNK_DOCS = 60_000
SHARD_TOKENS = 3 << 20
FREQUENT = 64
FREQUENT_PAIR = 4


def word_ids(found: Iterable[bytes], count: int = -1) -> np.ndarray:
    """48-bit ids of words; hashing again is cheaper than a look-up among so many."""
    return np.maximum(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, count) & ID_BITS, np.uint64(END + 1))


def _mix(ids: np.ndarray) -> np.ndarray:
    x = ids * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(32)) >> np.uint64(7)


def _pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = u * np.uint64(0x9E3779B97F4A7C15) ^ w * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ x >> np.uint64(29)) >> np.uint64(1)


def frequent(docs: DataFrame) -> tuple[int, dict[int, int], dict[int, int]]:
    """(number of tokens, {id: count} of words and {key: count} of pairs with over a quarter of a shard). Counts
    leave out tasks in which a word comes less than ``FREQUENT`` times, and slices in which a pair comes
    less than ``FREQUENT_PAIR`` times. They only decide where pairs go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = 0, [{}, {}]
        for part in slices(batches, most=1 << 22):
            found = [words(t) for t in utf8(part.column("text"))]
            begins = np.cumsum([0, *map(len, found[:-1])])
            found = np.insert(word_ids(chain.from_iterable(found)), begins, BOS)
            total += len(found)
            after = np.append(found[1:], np.uint64(BOS))
            after[after == BOS] = END
            for own, keys, least in zip(held, (found, _pair_key(found, after)), (2, FREQUENT_PAIR)):
                values, counts = np.unique(keys, return_counts=True)
                some = counts >= least
                for v, n in zip(values[some].tolist(), counts[some].tolist()):
                    own[v] = own.get(v, 0) + n
            held = [{v: n for v, n in own.items() if n >= FREQUENT} if len(own) > 1 << 20 else own for own in held]
        rows = [(0, 0, total), *[(kind, v, n) for kind, own in enumerate(held) for v, n in own.items() if n >= FREQUENT]]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1, 2)], ["kind", "id", "n"])

    counted = docs.select("text").mapInArrow(run, "kind long, id long, n long").groupBy("kind", "id").agg(F.sum("n").alias("n"))
    # the words and pairs kept have a quarter of a shard each: at most four times the number of shards of either
    found: list[dict[int, int]] = [{}, {}]
    for r in counted.filter(((F.col("kind") == 0) & (F.col("id") == 0)) | (F.col("n") > SHARD_TOKENS // 4)).collect():
        found[r["kind"]][r["id"]] = r["n"]
    return found[0].pop(0, 0), *found


def _index(held: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted number in an ascending array, or -1."""
    if not len(held):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
    return np.where(held[at] == wanted, at, -1)


class Deal:
    """Where a pair goes: a context has one shard, or ``spread`` ones in a row, in which a word has one place,
    or several in a row that its chunks share."""

    def __init__(self, tokens: int, frequent: dict[int, int], pairs: dict[int, int]):
        self.shards = max(1, -(-tokens // SHARD_TOKENS))
        self.hot, self.spread = self._wide(frequent)
        self.pairs, self.pair_spread = self._wide(pairs)

    def _wide(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array(sorted(counts), np.uint64)
        return keys, np.array([min(self.shards, -(-4 * counts[int(k)] // SHARD_TOKENS)) for k in keys], np.uint64)

    def is_hot(self, u: np.ndarray) -> np.ndarray:
        return _index(self.hot, u) >= 0

    def hot_pair(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Place among the pairs spread by chunk, or -1; their contexts are spread themselves."""
        out = np.full(len(u), -1, np.int64)
        own = np.flatnonzero(self.is_hot(u))
        out[own] = _index(self.pairs, _pair_key(u[own], w[own]))
        return out

    def shard(self, u: np.ndarray, w: np.ndarray, chunk: int) -> np.ndarray:
        out = _mix(u) % np.uint64(self.shards)
        at = _index(self.hot, u)
        own = np.flatnonzero(at >= 0)
        offset, pair = _mix(w[own]), self.hot_pair(u[own], w[own])
        wide = pair >= 0
        offset[wide] += _mix(np.array([chunk], np.uint64)) % self.pair_spread[pair[wide]]
        out[own] += offset % self.spread[at[own]]
        return (out % np.uint64(self.shards)).astype(np.int32)

    def holds(self, shard: int, u: np.ndarray) -> np.ndarray:
        """Whether pairs of the spread contexts ``u`` can be in a shard."""
        return self._offset(shard, u) < self.spread[_index(self.hot, u)]

    def holds_pair(self, shard: int, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Whether occurrences of the spread pairs can be in a shard."""
        wide = self.spread[_index(self.hot, u)]
        offset = self._offset(shard, u)
        return (offset < wide) & ((offset + wide - _mix(w) % wide) % wide < self.pair_spread[self.hot_pair(u, w)])

    def _offset(self, shard: int, u: np.ndarray) -> np.ndarray:
        shards = np.uint64(self.shards)
        return (np.uint64(shard) + shards - _mix(u) % shards) % shards


class Whole:
    """What is known of spread contexts (id, count, mass) and pairs (context, word, count, count of the word)."""

    def __init__(self, contexts: dict[int, tuple], pairs: list[tuple]):
        ids = sorted(contexts)
        self.ids = np.array(ids, np.uint64)
        self.n = np.array([contexts[i][0] for i in ids], np.int64)
        self.mass = np.array([contexts[i][1] for i in ids], np.float64)
        self.pairs = np.array([p[:2] for p in pairs], np.uint64).reshape(-1, 2)
        self.uses = np.array([p[2:] for p in pairs], np.int64).reshape(-1, 2)


def _pack(parts: list[np.ndarray]) -> bytes:
    return b"".join(struct.pack("<Q", p.nbytes) + p.tobytes() for p in parts)


def _unpack(payload: bytes, kinds: list[str]) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size, = struct.unpack_from("<Q", payload, at)
        out.append(np.frombuffer(payload, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size
    return out


def _six(ids: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _eight(packed: np.ndarray) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = packed.reshape(-1, 6)
    return out.view("<u8").reshape(-1)


KINDS = ["<i8", "u1", "<u4", "u1", "<u4", "<u2"]  # documents (differences), contexts, pairs each, words, uses each, uses


def _chunk_rows(doc_ids: list[int], tokens: list[np.ndarray], deal: Deal, chunk: int) -> Iterator[tuple[int, bytes]]:
    """(shard, payload) of the pairs of some documents. ``tokens`` begin with BOS and end with END."""
    flat = np.concatenate(tokens)
    sizes = np.array([len(t) for t in tokens])
    doc = np.repeat(np.arange(len(tokens), dtype=np.uint64), sizes)
    table, code = np.unique(flat, return_inverse=True)
    first = flat != END
    place = np.flatnonzero(first)
    # one sort brings uses into the order (context, word, document)
    bits = max(1, int(len(table) - 1).bit_length())
    key = (code[place].astype(np.uint64) << np.uint64(bits) | code[place + 1].astype(np.uint64)) << np.uint64(16) | doc[place]
    key.sort()
    pair = key >> np.uint64(16)
    begin = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    uses = np.diff(np.concatenate((begin, [len(pair)])))
    u = table[(pair[begin] >> np.uint64(bits)).astype(np.int64)]
    w = table[(pair[begin] & np.uint64((1 << bits) - 1)).astype(np.int64)]
    used = (key & np.uint64(0xFFFF)).astype("<u2")
    shard = deal.shard(u, w, chunk)
    order = np.argsort(shard, kind="stable")
    docs = np.diff(np.array(doc_ids, "<i8"), prepend=0).astype("<i8")
    edges = np.concatenate(([0], np.flatnonzero(np.diff(shard[order])) + 1, [len(order)]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        own = order[a:b]
        change = np.flatnonzero(np.concatenate(([True], u[own][1:] != u[own][:-1])))
        take = np.repeat(begin[own] - np.concatenate(([0], np.cumsum(uses[own])[:-1])), uses[own]) + np.arange(uses[own].sum())
        yield int(shard[own[0]]), _pack([
            docs, _six(u[own][change]), np.diff(np.concatenate((change, [len(own)]))).astype("<u4"),
            _six(w[own]), uses[own].astype("<u4"), used[take]])


def _dealt(docs: DataFrame, deal: Deal):
    """The pairs of all documents as an RDD of (shard, (chunk, train, payload)), one shard a partition."""
    sent = broadcast_object(docs.sparkSession, deal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent()
        held: dict[bool, tuple[list, list]] = {True: ([], []), False: ([], [])}
        sizes, number, task = {True: 0, False: 0}, 0, TaskContext.get().partitionId()

        def flush(train: bool) -> pa.RecordBatch:
            nonlocal number
            chunk = (task << 32) + number
            rows = list(_chunk_rows(*held[train], own, chunk))
            number, sizes[train], held[train] = number + 1, 0, ([], [])
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()),
                 pa.array([train] * len(rows)), pa.array([r[1] for r in rows], pa.binary())], ["shard", "chunk", "train", "payload"])

        for part in slices(batches):
            for doc, held_out, raw in zip(part.column("key").to_pylist(), part.column("held_out").to_pylist(), utf8(part.column("text"))):
                found = words(raw)
                tokens = np.empty(len(found) + 2, np.uint64)
                tokens[0], tokens[-1] = BOS, END
                tokens[1:-1] = word_ids(found, len(found))
                train = not held_out
                held[train][0].append(doc)
                held[train][1].append(tokens)
                sizes[train] += len(tokens)
                if sizes[train] >= CHUNK_TOKENS or len(held[train][0]) >= CHUNK_DOCS:
                    yield flush(train)
        for train in (True, False):
            if held[train][0]:
                yield flush(train)

    rows = docs.mapInArrow(run, "shard int, chunk long, train boolean, payload binary").rdd
    return rows.map(lambda r: (r[0], (r[1], r[2], bytes(r[3])))).partitionBy(deal.shards, _own)


def _own(shard: int) -> int:
    return shard


def _pairs(payloads: list[bytes]) -> tuple[np.ndarray, ...]:
    """Ids and counts of contexts, pairs of each, their words and counts; sorted by context and word."""
    us, ws, ns = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for payload in payloads:
        _, u, per, w, uses, _ = _unpack(payload, KINDS)
        us.append(np.repeat(_eight(u), per))
        ws.append(_eight(w))
        ns.append(uses)
    u, w, n = np.concatenate(us), np.concatenate(ws), np.concatenate(ns).astype(np.int64)
    us, ws, ns = None, None, None
    order = np.lexsort((w, u))
    u, w, n = u[order], w[order], n[order]
    if not len(u):
        return u, n, n, w, n
    begin = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (w[1:] != w[:-1]))))
    u, w, n = u[begin], w[begin], np.add.reduceat(n, begin)
    edge = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
    return u[edge], np.add.reduceat(n, edge), np.diff(np.concatenate((edge, [len(u)]))), w, n


def _apart(pairs: tuple[np.ndarray, ...], wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and numbers of pairs of the contexts without the spread pairs."""
    ids, counts, per, _, n = pairs
    place = np.repeat(np.arange(len(ids)), per)[wide]
    return counts - np.bincount(place, n[wide], len(ids)).astype(np.int64), per - np.bincount(place, minlength=len(ids))


def _count(rows, deal: Deal) -> Iterator[tuple]:
    """Per shard: contexts with counts, the parts of spread contexts and pairs, and the different next words."""
    shard, held = None, []
    for shard, (_, train, payload) in rows:
        if train:
            held.append(payload)
    if not held:
        return
    found = _pairs(held)
    ids, _, per, w, n = found
    u = np.repeat(ids, per)
    wide = deal.hot_pair(u, w) >= 0
    counts, per = _apart(found, wide)
    mass = counts - DISCOUNT * per
    hot = deal.is_hot(ids)
    yield (shard, int(counts[~hot & (ids != BOS)].sum()), int((~hot & (ids != BOS)).sum()),
           bytearray(_pack([ids[~hot], counts[~hot], mass[~hot]])), bytearray(_pack([ids[hot], counts[hot], mass[hot]])),
           bytearray(_pack([u[wide], w[wide], n[wide]])), bytearray(_pack([np.unique(w)])))


def _columns(frame: DataFrame, payload: str, kinds: list[str], schema: str) -> DataFrame:
    """Rows of ``shard`` and the packed arrays of a payload column."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, packed in zip(batch.column("shard").to_pylist(), batch.column(payload).to_pylist()):
                parts = _unpack(packed, kinds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(parts[0]), shard, np.int32)), *[pa.array(p.view("<i8") if p.dtype == "<u8" else p) for p in parts]], names)

    return frame.select("shard", payload).mapInArrow(run, schema)


def score_corpus(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows that ``held_out`` does not mark and score every row.

    Returns ``doc_id``, ``held_out``, ``n_tokens`` (words and an end), ``n_known``, ``train_tokens``,
    ``base_score`` (add-one unigram, log10) and ``score`` (log10). Null and empty texts have only the
    end; a null ``held_out`` trains; a null doc_id is kept; repeated rows count and are scored each.
    Without training rows the score equals the base score.
    """
    spark = docs.sparkSession
    rows = docs.select(
        column(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))
    # a key that packs a null id: ids keep their value, null is the smallest long
    rows = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), "held_out", "text")
    deal = Deal(*frequent(rows))
    dealt = _dealt(rows, deal)
    sent = broadcast_object(spark, deal)

    counted = spark.createDataFrame(
        dealt.mapPartitions(lambda part: _count(part, sent())),
        "shard int, tokens long, types long, contexts binary, spread binary, pairs binary, next binary")
    counted = cut_lineage(counted)
    # a spread context has one row in each of its shards; their number follows that of the shards
    parts = _columns(counted, "spread", ["<u8", "<i8", "<f8"], "shard int, id long, n long, mass double")
    spread = parts.groupBy("id").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass")).collect()
    totals = counted.agg(F.sum("tokens"), F.sum("types")).first()
    unigrams = _columns(counted, "contexts", ["<u8", "<i8", "<f8"], "shard int, id long, n long, mass double").select("id", "n")
    whole = {r["id"]: (r["n"], r["mass"]) for r in spread}
    parts = _columns(counted, "pairs", ["<u8", "<u8", "<i8"], "shard int, u long, w long, n long")
    pairs = [(r["u"], r["w"], r["n"]) for r in parts.groupBy("u", "w").agg(F.sum("n").alias("n")).collect()]
    for u, _, n in pairs:
        whole[u] = (whole[u][0] + n, whole[u][1] + n - DISCOUNT)
    # every training text has one beginning and one end
    ends = whole[BOS][0] if BOS in whole else (unigrams.filter(F.col("id") == BOS).agg(F.sum("n")).first()[0] or 0)
    n_total = (totals[0] or 0) + sum(n for i, (n, _) in whole.items() if i != BOS) + ends
    n_types = (totals[1] or 0) + sum(i != BOS for i in whole) + (ends > 0)
    more = spark.createDataFrame([(i, n) for i, (n, _) in whole.items() if i != BOS] + [(END, ends)], "id long, n long")
    unigrams = unigrams.filter(F.col("id") != BOS).union(more)

    # a shard gets the counts of its different next words, not one for each pair
    following = _columns(counted, "next", ["<u8"], "shard int, id long")
    known = following.join(unigrams.withColumnRenamed("n", "c"), "id").select("shard", "id", "c")
    grouped = known.repartition("shard").sortWithinPartitions("shard", "id")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "shard"):
            packed = _pack([part.column(c).to_numpy() for c in ("id", "c")])
            yield pa.RecordBatch.from_arrays([part.column("shard").slice(0, 1).combine_chunks(), pa.array([packed])], ["shard", "bundle"])

    bundles = grouped.mapInArrow(bundle, "shard int, bundle binary").rdd.map(lambda r: (r[0], (None, None, bytes(r[1]))))
    space = n_total + n_types + 1
    followers = spark.createDataFrame([(i,) for i in {w for _, w, _ in pairs}], "id long")
    of = {r["id"]: r["n"] for r in unigrams.join(followers, "id").collect()} if pairs else {}
    whole_sent = broadcast_object(spark, Whole(whole, [(u, w, n, of[w]) for u, w, n in pairs]))
    # the counts of a shard's words come before its rows, which are counted again and then scored: their
    # pairs take more room on disk than time
    held = bundles.partitionBy(deal.shards, _own).union(dealt)
    partial = held.mapPartitions(lambda part: _score(part, sent, whole_sent, space)).reduceByKey(
        lambda a, b: a if b is None else [a[0], *[x + y for x, y in zip(a[1:], b[1:])]])
    out = spark.createDataFrame(partial.map(lambda x: (x[0][1], bytearray(_pack(x[1])))), "train boolean, sums binary")
    end_score = float(np.log10((ends + 1) / space))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for train, packed in zip(batch.column("train").to_pylist(), batch.column("sums").to_pylist()):
                key, base, gain, uses, seen = _unpack(packed, ["<i8", "<f8", "<f8", "<i8", "<i8"])
                count = len(key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, mask=key == np.iinfo(np.int64).min), pa.array(np.full(count, not train)), pa.array(uses + 1),
                     pa.array(seen + int(ends > 0)), pa.array(np.full(count, n_total, np.int64)),
                     pa.array(base + end_score), pa.array(base + gain + end_score)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return out.mapInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _trie(shard: int, payloads: list[bytes], bundle: bytes | None, deal: Deal, whole: Whole, space: int) -> bytes | None:
    """The trie of a shard. Every spread context and pair whose occurrences may be in the shard is in it, with its
    whole count and back-off, whether or not the shard has training occurrences of it."""
    found = _pairs(payloads)
    ids, _, per, w, n = found
    u = np.repeat(ids, per)
    wide = deal.hot_pair(u, w) >= 0
    counts, per = _apart(found, wide)
    u, w, n = u[~wide], w[~wide], n[~wide]
    mass = counts - DISCOUNT * per
    words_known, c = _unpack(bundle, ["<i8", "<i8"]) if bundle else ([], np.empty(0, np.int64))
    c = c[np.searchsorted(words_known, w.view("<i8"))]
    here = deal.holds(shard, whole.ids)
    every = np.union1d(ids, whole.ids[here])
    if not len(every):
        return None
    n_context, mass_context = np.zeros(len(every), np.int64), np.zeros(len(every))
    for own, own_n, own_mass in ((ids, counts, mass), (whole.ids[here], whole.n[here], whole.mass[here])):
        at = np.searchsorted(every, own)
        n_context[at], mass_context[at] = own_n, own_mass
    some = deal.holds_pair(shard, *whole.pairs.T)
    u, w = (np.concatenate((x, y)) for x, y in zip((u, w), whole.pairs[some].T))
    n, c = (np.concatenate((x, y)) for x, y in zip((n, c), whole.uses[some].T))
    place = np.searchsorted(every, u)
    backoff = 1 - mass_context / n_context
    gain = np.log10((n - DISCOUNT) / n_context[place] / ((c + 1) / space) + backoff[place])
    short = w & np.uint64(0xFFFFFFFF)
    order = np.lexsort((short, place))
    return Trie.encode(every, n_context, np.log10(backoff), place[order], short[order], gain[order])


def _score(rows, deal, whole, space: int) -> Iterator[tuple]:
    """((chunk, train), [doc keys, base, gain, words, known words]) of each payload of a shard."""
    held, bundle = [], None
    for shard, (chunk, train, payload) in rows:
        if chunk is None:
            bundle = payload
        else:
            held.append((chunk, train, payload))
    if not held:
        return
    encoded = _trie(shard, [payload for _, train, payload in held if train], bundle, deal(), whole(), space)
    trie = Trie(encoded) if encoded else None
    while held:
        chunk, train, payload = held.pop()
        docs, u, per, w, uses, used = _unpack(payload, KINDS)
        docs, u, w = np.cumsum(docs), _eight(u), _eight(w)
        if trie is None:
            count, gain = np.zeros(len(u), np.int64), np.zeros(len(w))
        else:
            place = trie.context(u)
            count = trie.count(place)
            gain = trie.gain(np.repeat(place, per), w & np.uint64(0xFFFFFFFF))
        word = u != BOS
        base = np.where(word, np.log10((count + 1) / space), 0.0)
        each = np.repeat(np.column_stack((base, word, word & (count > 0))), per, axis=0)
        n = len(docs)
        at = used.astype(np.int64)
        yield (chunk, train), [
            docs, np.bincount(at, np.repeat(each[:, 0], uses), n), np.bincount(at, np.repeat(gain, uses), n),
            np.bincount(at, np.repeat(each[:, 1], uses), n).astype(np.int64),
            np.bincount(at, np.repeat(each[:, 2], uses), n).astype(np.int64)]
