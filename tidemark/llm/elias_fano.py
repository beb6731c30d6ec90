"""Elias-Fano sequences and a two-level n-gram trie over flat buffers.

Nothing is decoded when a trie is opened: its levels are views on the buffer, be it bytes, an Arrow
value or a memory-mapped file.
"""

from __future__ import annotations

import struct

import numpy as np

PART = 1 << 15
ONE = np.uint64(1)
HALVES = [np.uint64(1 << k) for k in range(5, -1, -1)]


def _low_bits(n: int, top: int) -> int:
    return max(0, min(56, (top // max(1, n)).bit_length() - 1))


class EliasFano:
    """A non-decreasing sequence of numbers below 2**63: low bits packed, high bits in unary."""

    def __init__(self, buffer, at: int = 0):
        self.n, self.low_bits, low_size, high_words = struct.unpack_from("<QQQQ", buffer, at)
        at += 32
        # a view that reads eight bytes at any byte
        self.low = np.ndarray((max(0, low_size - 7),), "<u8", buffer, at, (1,))
        at += low_size
        self.high = np.frombuffer(buffer, "<u8", high_words, at)
        ones = np.bitwise_count(self.high).astype(np.int64)
        self.ones = np.concatenate(([0], np.cumsum(ones)))
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones
        self.end = at + high_words * 8

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = _low_bits(n, top + 1)
        low = values & np.uint64((1 << low_bits) - 1)
        pieces = []
        for a in range(0, n, PART):
            bits = np.unpackbits(low[a:a + PART].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :low_bits]
            pieces.append(np.packbits(bits.reshape(-1), bitorder="little").tobytes())
        packed = b"".join(pieces) + bytes(8)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        words = ((int(places[-1]) if n else 0) + 1) // 64 + 1
        high = np.zeros(words * 64, np.uint8)
        high[places] = 1
        return (struct.pack("<QQQQ", n, low_bits, len(packed), words) + packed
                + np.packbits(high, bitorder="little").tobytes())

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th (from 0) one or zero in the high bits."""
        before = self.ones if ones else self.zeros
        out = np.empty(len(k), np.int64)
        for a in range(0, len(k), PART):
            own = k[a:a + PART]
            word = np.searchsorted(before, own, side="right") - 1
            bits = self.high[word] if ones else ~self.high[word]
            left = (own - before[word]).astype(np.uint8)
            inside = np.zeros(len(own), np.uint64)
            # the half that holds the place, six times
            for width in HALVES:
                count = np.bitwise_count(bits & ((ONE << width) - ONE))
                past = left >= count
                left -= count * past
                step = width * past
                bits >>= step
                inside += step
            out[a:a + PART] = word * 64 + inside.astype(np.int64)
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.low_bits
        return (self.low[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        high = (self._select(i, True) - i).astype(np.uint64)
        return high << np.uint64(self.low_bits) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of the first element equal to each x, or -1: the successor search goes straight to
        the elements that share the high bits of x."""
        x = np.asarray(x, np.uint64)
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        can = np.flatnonzero(high < self.zeros[-1])
        high, low = high[can], x[can] & np.uint64((1 << self.low_bits) - 1)
        stop = np.minimum(self._select(high, False) - high, self.n)
        start = np.zeros(len(can), np.int64)
        some = np.flatnonzero(high > 0)
        start[some] = self._select(high[some] - 1, False) - (high[some] - 1)
        # the low bits ascend among them: halve the range of all queries together
        want, left, right = low, start.copy(), stop.copy()
        live = np.flatnonzero(left < right)
        while len(live):
            middle = (left[live] + right[live]) >> 1
            less = self._low(middle) < want[live]
            left[live[less]] = middle[less] + 1
            right[live[~less]] = middle[~less]
            live = live[left[live] < right[live]]
        hit = np.flatnonzero(left < stop)
        hit = hit[self._low(left[hit]) == want[hit]]
        out[can[hit]] = left[hit]
        return out


def _quantise(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """256 mean levels of equally filled ranges, and the code of each value."""
    values = np.asarray(values, np.float64)
    if not len(values):
        return np.zeros(256, "<f4").tobytes(), np.empty(0, np.uint8)
    edges = np.unique(np.quantile(values, np.linspace(0, 1, 257)[1:-1], method="nearest"))
    codes = np.searchsorted(edges, values, side="left")
    sums, counts = np.bincount(codes, values, 256), np.bincount(codes, minlength=256)
    return (sums / np.maximum(counts, 1)).astype("<f4").tobytes(), codes.astype(np.uint8)


class Trie:
    """Contexts, their counts and back-off codes; the successors of each with probability codes.

    Level 1: context ids (Elias-Fano), cumulative counts (Elias-Fano, exact), back-off codes.
    Level 2: monotone pointers (Elias-Fano) from a context to its successors; a successor is stored
    relative to its context, as ``place of the context * 2**32 + 32 bits of the word's id``.
    """

    def __init__(self, buffer, at: int = 0):
        offsets = struct.unpack_from("<6Q", buffer, at)
        self.ids, self.counts, self.pointers, self.next = (EliasFano(buffer, at + o) for o in offsets[:4])
        self.levels = [np.frombuffer(buffer, "<f4", 256, at + o) for o in offsets[4:]]
        self.codes = [np.frombuffer(buffer, np.uint8, n, at + o + 1024) for o, n in zip(offsets[4:], (self.ids.n, self.next.n))]

    @staticmethod
    def encode(ids: np.ndarray, counts: np.ndarray, backoff: np.ndarray,
               context: np.ndarray, word: np.ndarray, gain: np.ndarray) -> bytes:
        """``ids`` ascending; ``context`` (a place in ids) and ``word`` (below 2**32) sorted together."""
        pointers = np.searchsorted(context, np.arange(len(ids) + 1))
        body = [
            EliasFano.encode(ids), EliasFano.encode(np.concatenate(([0], np.cumsum(counts)))), EliasFano.encode(pointers),
            EliasFano.encode(context.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)),
        ]
        for values in (backoff, gain):
            levels, codes = _quantise(values)
            body.append(levels + codes.tobytes())
        offsets = np.concatenate(([48], 48 + np.cumsum([len(b) for b in body])))[:-1]
        return struct.pack("<6Q", *offsets.tolist()) + b"".join(body)

    def context(self, ids: np.ndarray) -> np.ndarray:
        return self.ids.find(ids)

    def count(self, place: np.ndarray) -> np.ndarray:
        """Exact training count of contexts; 0 for place -1."""
        out = np.zeros(len(place), np.int64)
        known = np.flatnonzero(place >= 0)
        at = place[known]
        out[known] = (self.counts.access(at + 1) - self.counts.access(at)).astype(np.int64)
        return out

    def backoff(self, place: np.ndarray) -> np.ndarray:
        """log10 of the back-off weight; 0 for place -1."""
        out = np.zeros(len(place))
        known = place >= 0
        out[known] = self.levels[0][self.codes[0][place[known]]]
        return out

    def gain(self, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 of p(word | context) / p(word): the stored one, or the back-off weight."""
        out = self.backoff(place)
        known = np.flatnonzero(place >= 0)
        at, of = np.unique(place[known], return_inverse=True)
        some = (self.pointers.access(at + 1) > self.pointers.access(at))[of]
        ask = known[some]
        found = self.next.find(place[ask].astype(np.uint64) << np.uint64(32) | word[ask].astype(np.uint64))
        hit = found >= 0
        out[ask[hit]] = self.levels[1][self.codes[1][found[hit]]]
        return out
