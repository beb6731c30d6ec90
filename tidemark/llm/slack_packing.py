"""Packing of token ids into sequences by minimum bin slack.

A task encodes its documents and keeps a pool of what is left of them below one sequence. A sequence
begins with the longest stretch of the pool; which further lengths fill it closest to its capacity is
found by subset sums: a bitset holds every sum that the lengths so far can reach, each length comes
in as often as the pool has it (in chunks of 1, 2, 4, ... of them), and the counts are read back from
the bitsets of the steps. What the best set leaves open is filled by the head of one more document,
so no sequence of the full capacity has padding. The rest of a task, less than one sequence, fills
sequences whose capacities are powers of two, which need none either.

Documents are packed where they are read: nothing is shuffled, and a task holds one shard at a time.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from operator import neg

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import gathered, slices, texts
from tidemark.llm.word_ids import WordIds

CAPACITY = 2048
SLICE = 1 << 23
# a pool is packed when it holds as many documents or ids; what stays goes on to the next
SHARD_DOCS = 1 << 14
SHARD_IDS = 1 << 22
OUT_IDS = 1 << 20
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
PART_BITS = 40


def best_set(lengths: Iterable[int], count: Callable[[int], int], target: int) -> tuple[int, list[tuple[int, int]]]:
    """(sum, [(length, count)]) of the multiset of different ``lengths`` whose sum is closest below
    ``target``. A length is there ``count(length)`` times. The steps end as soon as the target itself
    is reached.
    """
    mask = (1 << (target + 1)) - 1
    reached = [1]
    steps: list[tuple[int, int]] = []  # length, copies in the chunk
    for size in lengths:
        if size > target:
            continue
        left, chunk = min(count(size), target // size), 1
        while left:
            take = min(chunk, left)
            before = reached[-1]
            now = (before | before << size * take) & mask
            if now != before:
                reached.append(now)
                steps.append((size, take))
                if now >> target & 1:
                    left = take
            left -= take
            chunk *= 2
        if reached[-1] >> target & 1:
            break
    best = at = reached[-1].bit_length() - 1
    chosen: dict[int, int] = {}
    for k in range(len(steps) - 1, -1, -1):
        if not reached[k] >> at & 1:
            size, take = steps[k]
            at -= size * take
            chosen[size] = chosen.get(size, 0) + take
    return best, list(chosen.items())


class Pool:
    """Stretches of documents by length: (document, start) of each, the latest taken first."""

    def __init__(self):
        self.by_length: dict[int, list[tuple[int, int]]] = {}
        self.order: list[int] = []  # the different lengths, negative: longest first
        self.total = 0

    def add(self, length: int, doc: int, start: int) -> None:
        if length not in self.by_length:
            self.by_length[length] = []
            insort(self.order, -length)
        self.by_length[length].append((doc, start))
        self.total += length

    def take(self, length: int) -> tuple[int, int]:
        held = self.by_length[length]
        found = held.pop()
        self.total -= length
        if not held:
            del self.by_length[length], self.order[bisect_left(self.order, -length)]
        return found

    def longest(self) -> int:
        return -self.order[0]

    def best(self, room: int) -> tuple[int, list[tuple[int, int]]]:
        fitting = islice(self.order, bisect_left(self.order, -room), None)
        return best_set(map(neg, fitting), lambda size: len(self.by_length[size]), room)


def fill(pool: Pool, capacity: int) -> list[tuple[int, int, int]]:
    """Take (document, start, length) of one full sequence from a pool that holds enough ids."""
    out, room, longest = [], capacity, pool.longest()
    if longest < room:
        out.append((*pool.take(longest), longest))
        best, chosen = pool.best(room - longest)
        out += [(*pool.take(size), size) for size, count in chosen for _ in range(count)]
        room -= longest + best
    if room:
        # the set leaves some room, or one stretch is longer than all of it: cut the longest one
        longest = pool.longest()
        doc, start = pool.take(longest)
        out.append((doc, start, room))
        if longest > room:
            pool.add(longest - room, doc, start + room)
    return out


def pack(lengths: list[int], capacity: int = CAPACITY, pool: Pool | None = None, end: bool = True) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length), in which the pieces follow each other from 0 on.

    A document of at least ``capacity`` gives whole sequences first. With a ``pool`` its stretches are
    packed too, and what does not fill a sequence stays in it, unless ``end``: then the rest goes
    to sequences whose lengths are powers of two.
    """
    pool = Pool() if pool is None else pool
    sequences = []
    for doc, n in enumerate(lengths):
        whole = n // capacity
        sequences += [[(doc, k * capacity, capacity)] for k in range(whole)]
        if n % capacity:
            pool.add(n % capacity, doc, whole * capacity)
    while pool.total >= capacity:
        sequences.append(fill(pool, capacity))
    while end and pool.total:
        sequences.append(fill(pool, 1 << (pool.total.bit_length() - 1)))
    return sequences


class Shard:
    """The documents of one pool: what is left of earlier ones, then new ones."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.ids: list[np.ndarray] = []
        self.docs: list[pa.Array] = []
        self.starts: list[np.ndarray] = []  # of the stretch in its document
        self.sizes: list[np.ndarray] = []  # of the stretch
        self.tokens: list[np.ndarray] = []  # of the document
        self.n_docs = self.n_ids = 0

    def add(self, docs: pa.Array, starts: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, ids: np.ndarray) -> None:
        for held, new in zip((self.docs, self.starts, self.sizes, self.tokens, self.ids), (docs, starts, sizes, tokens, ids)):
            held.append(new)
        self.n_docs += len(docs)
        self.n_ids += len(ids)

    def packed(self, first: int, end: bool) -> tuple[Iterator[pa.RecordBatch], int, Shard]:
        """(rows of the packed pieces, the next sequence's number, the shard that goes on)."""
        rest = Shard(self.capacity)
        if not self.n_docs:
            return iter(()), first, rest
        docs, starts = pa.concat_arrays(self.docs), np.concatenate(self.starts)
        sizes, tokens, ids = np.concatenate(self.sizes), np.concatenate(self.tokens), np.concatenate(self.ids)
        pool = Pool()
        sequences = pack(sizes.tolist(), self.capacity, pool, end)
        pieces = [(doc, at, n, first + k) for k, own in enumerate(sequences) for doc, at, n in own]
        offsets = [x for own in sequences for x in np.cumsum([0] + [p[2] for p in own[:-1]]).tolist()]
        left = [(doc, at, n, -1) for n, held in pool.by_length.items() for doc, at in held]
        table = np.array(pieces + left, np.int64).reshape(-1, 4)
        offset = np.array(offsets + [0] * len(left), np.int64)
        # the pieces of the documents, in their order, part the ids: the ids need no copy
        order = np.lexsort((table[:, 1], table[:, 0]))
        table, offset = table[order], offset[order]
        edges = np.concatenate(([0], np.cumsum(table[:, 2])))
        here = table[:, 3] >= 0
        for k in np.flatnonzero(~here).tolist():
            doc, at, n, _ = table[k].tolist()
            rest.add(docs.slice(doc, 1), starts[doc:doc + 1] + at, np.array([n]), tokens[doc:doc + 1], ids[edges[k]:edges[k + 1]].copy())

        def rows() -> Iterator[pa.RecordBatch]:
            blocks = edges[:-1] // OUT_IDS
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(table)]
            buffer = pa.py_buffer(ids.astype("<u4", copy=False))
            for a, b in zip(cuts, cuts[1:]):
                own = np.flatnonzero(here[a:b])
                if not len(own):
                    continue
                part, base = table[a:b], edges[a]
                bounds = pa.py_buffer(((edges[a:b + 1] - base) * 4).astype(np.int32))
                binary = pa.Array.from_buffers(pa.binary(), b - a, [None, bounds, buffer[4 * int(base):]])
                doc = part[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [docs.take(pa.array(doc)), pa.array(starts[doc] + part[:, 1]), pa.array(part[:, 2].copy()),
                     pa.array(tokens[doc]), pa.array(part[:, 3].copy()), pa.array(offset[a:b]), binary],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]).take(pa.array(own))

        return rows(), first + len(sequences), rest


def pack_tokens(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every id of every text, each text followed by ``end_id``, in sequences: one row per piece with
    ``doc_id``, ``start`` (its document's ids before it), ``length``, ``doc_tokens``, ``sequence_id``,
    ``offset`` (its place in the sequence) and ``ids`` (unsigned 32-bit little-endian numbers).

    A sequence is ``capacity`` ids long, or a power of two below it. Null text is empty (only the end
    id), null doc_id is kept, rows that repeat an id or a whole row are documents of their own, an
    empty table gives no rows, other columns are not read. ``sequence_id`` is the input partition's
    number times 2**40 plus a number from 0. A piece of a document is cut only where a sequence ends.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder, number = WordIds.of_worker(tokenizer), TaskContext.get().partitionId() << PART_BITS
        shard = Shard(capacity)
        for piece in slices(gathered(batches, least=SLICE), most=SLICE):
            ids, edges = encoder(piece.column("text"))
            ids = np.insert(ids, edges[1:], end_id)
            ends = edges[1:] + np.arange(1, len(edges))
            sizes, at = np.diff(ends, prepend=0), 0
            while at < len(ends):
                begin = int(ends[at] - sizes[at])
                to = int(np.searchsorted(ends, begin + max(1, SHARD_IDS - shard.n_ids))) + 1
                to = min(to, at + max(1, SHARD_DOCS - shard.n_docs), len(ends))
                own = sizes[at:to]
                shard.add(piece.column("doc_id").slice(at, to - at), np.zeros(to - at, np.int64), own, own, ids[begin:ends[to - 1]])
                at = to
                if shard.n_ids >= SHARD_IDS or shard.n_docs >= SHARD_DOCS:
                    rows, number, shard = shard.packed(number, False)
                    yield from rows
        yield from shard.packed(number, True)[0]

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32``, the unsigned crc32 of their ids, in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
