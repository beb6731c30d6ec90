"""Minimum bin slack: subset sums against trying all, sequences against the ids of the whole texts."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cases import ROWS, empty, odd
from tidemark.llm import queries, slack_packing

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_best_set_equals_trying_all():
    rng = random.Random(1)
    for _ in range(300):
        lengths = rng.sample(range(1, 40), rng.randint(0, 5))
        counts = [rng.randint(1, 3) for _ in lengths]
        target = rng.randint(1, 90)
        sums = {sum(n * x for n, x in zip(lengths, own)) for own in product(*[range(c + 1) for c in counts])}
        best, chosen = slack_packing.best_set(lengths, dict(zip(lengths, counts)).get, target)
        assert best == max(s for s in sums if s <= target)
        assert sum(size * n for size, n in chosen) == best and all(0 < n <= counts[lengths.index(size)] for size, n in chosen)


@pytest.mark.parametrize("seed", range(5))
def test_pack_holds_every_id_once_without_padding(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 7, 7, 64, rng.randint(1, 300), rng.randint(1, 9000)]) for _ in range(rng.randint(0, 400))]
    sequences = slack_packing.pack(sizes, 256)
    filled = [sum(n for _, _, n in own) for own in sequences]
    assert all(n == 256 or n & (n - 1) == 0 for n in filled) and sum(n < 256 for n in filled) <= 8
    held = defaultdict(list)
    for own in sequences:
        for doc, at, n in own:
            held[doc].append((at, n))
    for doc, size in enumerate(sizes):
        own = sorted(held[doc])
        assert [a for a, _ in own] == [0, *np.cumsum([n for _, n in own]).tolist()[:-1]] and sum(n for _, n in own) == size
    # cuts are few: at most one per sequence besides those of documents longer than a sequence
    assert sum(map(len, held.values())) <= len(sizes) + len(sequences)


def check(rows, want):
    """Pieces against (doc_id, ids) of all documents, ids apart."""
    whole = {d: ids for d, ids in want}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = whole[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(ids) == r["length"] > 0 and r["doc_tokens"] == len(whole[r["doc_id"]])
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places, total in [(p, len(whole[d])) for d, p in by_doc.items()] + [(p, None) for p in by_sequence.values()]:
        places.sort()
        ends = [a + n for a, n in places]
        assert [a for a, _ in places] == [0, *ends[:-1]]
        if total is None:
            assert ends[-1] == 2048 or ends[-1] < 2048 and ends[-1] & (ends[-1] - 1) == 0
        else:
            assert ends[-1] == total
    assert by_doc.keys() == whole.keys()


@pytest.mark.parametrize("shard", [(1 << 14, 1 << 22), (7, 3000)])
def test_query(spark, monkeypatch, shard):
    monkeypatch.setattr(slack_packing, "SHARD_DOCS", shard[0])
    monkeypatch.setattr(slack_packing, "SHARD_IDS", shard[1])
    monkeypatch.setattr(slack_packing, "OUT_IDS", 1000 if shard[0] == 7 else 1 << 20)
    plain = Tokenizer.from_file(PATH)
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    check(queries.QUERIES["op11_slack_packing"](spark, SF).collect(),
          [(d, [*plain.encode(t, add_special_tokens=False).ids, 1]) for d, t in docs])


def test_odd_rows(spark):
    """Null and empty texts hold an end id, null and repeated ids are kept, ties of length too."""
    plain = Tokenizer.from_file(PATH)
    rows = slack_packing.pack_tokens(odd(spark), PATH).collect()
    want = Counter((r[0], len(plain.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in ROWS)
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0) == want
    assert sum(r["length"] for r in rows) == sum(n * k for (_, n), k in want.items())
    assert slack_packing.pack_tokens(empty(spark), PATH).collect() == []
    sizes = Counter()
    for r in rows:
        sizes[r["sequence_id"]] += r["length"]
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes.values())
