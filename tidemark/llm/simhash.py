"""SimHash near-duplicates, compared over bit planes.

Fingerprints that can lie within the radius share all bits of two of ``radius + 2`` parts, so equal
parts deal them into buckets. Inside a bucket the fingerprints are stored vertically, one plane per
bit, and the distances to 64 fingerprints per machine word grow together in carry-save counters. A
word whose 64 distances all exceed the radius is abandoned. A bucket gives at most one link per
member (to the smallest member it can reach there), never its pairs.

A bucket of more than ``BUCKET`` fingerprints is dealt again by the bits that are still free, until
at most 16 bits are: such a bucket cannot hold more than 65,536 different fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import likely, rows, slices, texts, unpack, utf8, words
from tidemark.llm.components import components
from tidemark.session import cut_lineage

SEED = 42
BUCKET = 4096
SMALL = 32
FREE_BITS = 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles: a bit is 1 if set in over half of their hashes."""
    found = words(raw)
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    stops = ends[min(shingle, len(found)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    counts, total = np.zeros(64, np.int64), len(stops)
    for at in range(0, total, 1 << 15):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at:at + (1 << 15)], stops[at:at + (1 << 15)])]
        bits = np.unpackbits(np.array(part, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(``doc_id``, ``version``, ``fp`` long: the 64 bits as a signed number) of ``doc_id``, ``version``
    (a hash of the text) and ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in utf8(part.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("version"), pa.array(fps.view(np.int64))], ["doc_id", "version", "fp"])

    return docs.mapInArrow(run, "doc_id long, version long, fp long")


# ---- bit planes

def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words) of uint64: bit i of plane p is bit 63-p of fingerprint i (padded with zeros)."""
    size = -(-len(fps) // 64) * 64
    padded = np.zeros(size, ">u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(differs: list[np.ndarray], lanes: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose number of set bits over all ``differs`` is at most ``radius``.

    ``differs`` holds one array per plane, each shaped like ``lanes`` (queries, words). The counters
    start at ``2**k - 1 - radius``, so the carry out of the top bit marks a lane beyond the radius.
    """
    width = max(1, int(radius).bit_length())
    flat = lanes.reshape(-1)
    alive = np.flatnonzero(flat)
    beyond = ~flat[alive]
    first = (1 << width) - 1 - radius
    counter = [np.full(len(alive), ALL if first >> k & 1 else 0, np.uint64) for k in range(width)]
    views = [d.reshape(-1) for d in differs]
    for at in range(0, len(views), 2):
        x = views[at][alive]
        y = views[at + 1][alive] if at + 1 < len(views) else np.zeros_like(x)
        # two planes enter the lowest counter at once; the carries ripple up
        low = counter[0] ^ x
        carries = [counter[0] & x, low & y]
        counter[0] = low ^ y
        for k in range(1, width):
            up = []
            for carry in carries:
                up.append(counter[k] & carry)
                counter[k] = counter[k] ^ carry
            carries = up
        for carry in carries:
            beyond = beyond | carry
        if at % 8 == 6:
            live = beyond != ALL
            if not live.all():
                alive, beyond = alive[live], beyond[live]
                counter = [c[live] for c in counter]
                if not len(alive):
                    break
    out = np.zeros_like(flat)
    out[alive] = ~beyond
    return out.reshape(lanes.shape)


def _lanes(mask: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.ascontiguousarray(mask).view(np.uint8), bitorder="little")[:n])


def bucket_components(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint of one bucket the lowest index it can reach there.

    Breadth first: up to 64 found members query the unvisited lanes together, each once.
    """
    n = len(fps)
    stored = planes(fps)
    varies = [p for p in range(64) if 0 < int(np.bitwise_count(stored[p]).sum()) < n]
    stored = stored[varies]
    free = np.zeros(stored.shape[1] if varies else -(-n // 64), np.uint64)
    np.bitwise_or.at(free, np.arange(n) // 64, np.uint64(1) << (np.arange(n) % 64).astype(np.uint64))
    root = np.full(n, -1)
    for seed in range(n):
        if root[seed] >= 0:
            continue
        todo = [seed]
        root[seed] = seed
        free[seed // 64] &= ~(np.uint64(1) << np.uint64(seed % 64))
        while todo:
            ask, todo = todo[:64], todo[64:]
            if not varies:
                hits = free.copy()
            else:
                flips = [np.where(fps[ask] >> np.uint64(63 - p) & np.uint64(1), ALL, np.uint64(0)) for p in varies]
                live = np.flatnonzero(free)
                if not len(live):
                    break
                lanes = np.repeat(free[live][None, :], len(ask), 0)
                differs = [stored[k][live][None, :] ^ f[:, None] for k, f in enumerate(flips)]
                hits = np.zeros_like(free)
                hits[live] = np.bitwise_or.reduce(within(differs, lanes, radius), axis=0)
            free &= ~hits
            new = _lanes(hits, n)
            root[new] = seed
            todo.extend(new.tolist())
    return root


def small_links(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets of at most ``SMALL`` members, all buckets of a slice together: lane i
    holds the difference of row i and the row ``shift`` places on, if both are in one bucket."""
    left, right = [], []
    for shift in range(1, SMALL):
        a = np.flatnonzero(group[:-shift] == group[shift:]) if shift < len(group) else np.empty(0, int)
        if not len(a):
            break
        for part in np.array_split(a, -(-len(a) // (1 << 16))):
            differs = planes(fps[part] ^ fps[part + shift])
            lanes = np.full(differs.shape[1], ALL, np.uint64)
            if len(part) % 64:
                lanes[-1] = (np.uint64(1) << np.uint64(len(part) % 64)) - np.uint64(1)
            hit = part[_lanes(within(list(differs), lanes, radius), len(part))]
            left.append(hit)
            right.append(hit + shift)
    none = np.empty(0, int)
    return (np.concatenate(left) if left else none), (np.concatenate(right) if right else none)


def link_buckets(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of the buckets of one partition, sorted by (``table``, ``key``)."""
    def link(table, key, fp, node):
        edge = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1
        begin = np.concatenate(([0], edge))
        size = np.diff(np.concatenate((begin, [len(fp)])))
        group = np.repeat(np.arange(len(begin)), size)
        small = size[group] <= SMALL
        rows = np.flatnonzero(small & (size[group] > 1))
        a, b = small_links(fp[rows], group[rows], radius)
        u, v = [node[rows[a]]], [node[rows[b]]]
        for g in np.flatnonzero(size > SMALL):
            own = slice(begin[g], begin[g] + size[g])
            root = bucket_components(fp[own], radius)
            moved = np.flatnonzero(root != np.arange(len(root)))
            u.append(node[own][moved])
            v.append(node[own][root[moved]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("table", "key", "fp", "node")]
        now[2] = now[2].view(np.uint64)
        if rest is not None:
            now = [np.concatenate((x, y)) for x, y in zip(rest, now)]
        last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        rest = [x[cut:] for x in now]
        if cut:
            yield link(*[x[:cut] for x in now])
    if rest is not None:
        yield link(*rest)


# ---- buckets

def _split(bits: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.array(bits), parts)]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _masks(fixed: int, radius: int) -> list[int]:
    """``fixed`` with each choice of two of ``radius + 2`` parts of the free bits added."""
    free = [b for b in range(64) if not fixed >> b & 1]
    return [fixed | _mask(x + y) for x, y in combinations(_split(free, radius + 2), 2)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Links (``u``, ``v``) whose closure equals that of all pairs of ``nodes`` within ``radius``.

    ``nodes`` has unique ``fp`` and a long ``node`` for each. Radius 0 to 4.
    """
    def dealt(frame: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
        """A row per new mask; ``table`` is a number for the mask."""
        numbers = {m: i for i, m in enumerate(sorted({m for new in masks.values() for m in new}))}
        choice = None
        for old, new in masks.items():
            tables = F.array(*[
                F.struct(F.lit(numbers[m]).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                for m in new])
            choice = F.when(F.col("table") == old, tables) if choice is None else choice.when(F.col("table") == old, tables)
        levels.append({numbers[m]: m for m in numbers})
        return frame.select(F.explode(choice).alias("x"), "fp", "node").select("x.table", "x.key", "fp", "node")

    levels: list[dict[int, int]] = []
    current = dealt(nodes.select(F.lit(0).alias("table"), "fp", "node"), {0: _masks(0, radius)})
    out = None
    while True:
        last = min(64 - m.bit_count() for m in levels[-1].values()) <= FREE_BITS
        sizes = current.groupBy("table", "key").count()
        sizes = cut_lineage(sizes.filter("count > 1"))
        cold = sizes if last else sizes.filter(F.col("count") <= BUCKET)
        bucketed = current.join(cold.select("table", "key"), ["table", "key"], "left_semi")
        found = (
            bucketed.repartition("table", "key").sortWithinPartitions("table", "key", "fp")
            .mapInArrow(lambda batches: link_buckets(batches, radius), "u long, v long")
        )
        out = found if out is None else out.union(found)
        hot = sizes.filter(F.col("count") > BUCKET)
        if last or hot.isEmpty():
            return out
        again = current.join(hot.select("table", "key"), ["table", "key"], "left_semi")
        current = dealt(again, {t: _masks(m, radius) for t, m in levels[-1].items()})


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``fingerprint`` 16 hex digits, ``component_id``, ``version``) for every row of ``docs``.

    The component is the smallest doc_id that links of at most ``radius`` differing bits reach.
    Null and empty texts have fingerprint zero and link like any other. Rows that repeat a doc_id
    are kept, each with the component of its own fingerprint. A row with a null doc_id keeps its
    fingerprint; its component is that of the fingerprint, or null if no row with an id reaches it.
    """
    marked = texts(docs, id_col, text_col).withColumn("version", F.xxhash64("text"))
    marked = cut_lineage(fingerprints(marked, shingle))
    nodes = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("node")))
    classes = components(near_links(nodes.filter("node is not null"), radius))
    labels = cut_lineage(nodes.join(classes, "node", "left").select(
        "fp", F.coalesce("component", "node").alias("component_id")))
    return marked.join(labels, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "version")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each group, with their own columns; a row
    without an id stays only where its group has none with one. Repeated rows leave one.
    """
    classes = cut_lineage(near_duplicates(docs, shingle, radius, id_col, text_col))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")
    group = F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("loose")
    kept = classes.groupBy("component_id", group).agg(F.min(place).alias("k"), F.count(F.lit(1)).alias("n"))
    kept = cut_lineage(kept.filter("n > 1").select("component_id", "loose", F.col("k.doc_id").alias("k_id"), F.col("k.version").alias("k_version")))
    # a document that is alone in its group passes without a shuffle; the others meet the kept ones
    in_group = F.col("component_id").eqNullSafe(F.col("g_component")) & F.col("g_loose").eqNullSafe(F.col("loose"))
    named = kept.select(F.col("component_id").alias("g_component"), F.col("loose").alias("g_loose"))
    crowded = classes.select("doc_id", "version", "component_id", group).join(named, in_group, "left_semi")
    key = F.xxhash64("doc_id", "version")
    marked = rows(docs, id_col, text_col).withColumn("version", F.xxhash64("text")).drop("text")
    split = likely(marked, key, cut_lineage(crowded.select(key.alias("h"))), flag="maybe")
    crowd = crowded.select("doc_id", "version").distinct().withColumnsRenamed({"doc_id": "c_id", "version": "c_version"})
    winners = kept.select("k_id", "k_version").distinct()

    def same(id_: str, version: str) -> Column:
        return F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col("version") == F.col(version))

    met = split.filter("maybe")
    won = met.join(winners, same("k_id", "k_version"), "left_semi").groupBy("doc_id", "version").agg(F.first("row").alias("row"))
    alone = met.join(crowd, same("c_id", "c_version"), "left_anti")
    return unpack(split.filter(~F.col("maybe")).select("row").union(alone.select("row")).union(won.select("row")), docs)
