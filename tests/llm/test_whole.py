"""Cases that the operators once left out, against what the text itself says."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, license_align, ngram_lm, queries

SF = "/root/testdata/sf0.01"


# ---- decontamination

def leaks(items, texts):
    """(text, item) places of the hits."""
    index = decontaminate.Index((i, x.encode()) for i, x in enumerate(items))
    docs = [decontaminate.tokens(x.encode()) for x in texts]
    return {(i, item) for i, passages in decontaminate.reached(index, docs, 0.75)
            for item in index.hits(docs[i], 0.75, 0.8, passages)}


def test_verbatim_items_are_hits():
    items = [x for x, in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet' ORDER BY item_id").fetchall()]
    texts = [x for x, in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()]
    rng = random.Random(6)
    for item in items[:40]:
        left, right = (rng.choice(["%%%", "&&&", "#", "<", "*", "~ ", "“", "-", "and"]) for _ in range(2))
        texts.append(f"some words before {left}{item}{right}and some after")
    want = {(i, k) for i, text in enumerate(texts) for k, item in enumerate(items) if item in text}
    assert len(want) >= 40 and want <= leaks(items, texts)


def test_one_edited_word():
    for n in (5, 7, 11, 17, 28, 29, 40):
        question = [f"q{i}" for i in range(n)]
        answer = [f"a{i}" for i in range(n)]
        for side in (question, answer):
            held = [*question, *answer]
            held[held.index(side[n // 2])] = "edited"
            assert leaks([f"{' '.join(question)}? {' '.join(answer)}"], ["pad " * 90 + " ".join(held) + " pad" * 90]) == {(0, 0)}
    # the question with another answer is no leak
    assert not leaks([f"{' '.join(question)}? a b c d e f"], [" ".join([*question, *"u v w x y z".split()])])


# ---- language model

@pytest.mark.parametrize("shard_tokens", [1 << 20, 4000])
def test_lm_of_all_pairs(spark, monkeypatch, shard_tokens):
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", shard_tokens)
    if shard_tokens < 10_000:
        monkeypatch.setattr(ngram_lm, "CHUNK_TOKENS", 2000)
        monkeypatch.setattr(ngram_lm, "FREQUENT", 2)
    small = "/root/testdata/sf0.001"
    docs = [(d, ["begin", *t.encode().lower().split(), "end"]) for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()]
    train = [x for d, x in docs if zlib.crc32(str(d).encode()) % 7 != 2]
    count, pairs = Counter(w for x in train for w in x[1:]), Counter(p for x in train for p in zip(x, x[1:]))
    context, follow = Counter(), Counter(u for u, _ in pairs)
    for (u, _), n in pairs.items():
        context[u] += n
    space = sum(count.values()) + len(count) + 1
    got = {r["doc_id"]: r["score"] for r in queries.QUERIES["op4_ngram_lm"](spark, small).collect()}
    for doc, x in docs:
        score = 0
        for u, w in zip(x, x[1:]):
            single = (count[w] + 1) / space
            score += math.log10((max(pairs[u, w] - 0.75, 0) + 0.75 * follow[u] * single) / context[u] if context[u] else single)
        assert abs(got[doc] - score) < 0.05 * len(x)  # 8-bit probabilities


def test_lm_splits_frequent_pairs(spark, monkeypatch):
    """Two words make a third of all pairs, most of them in few documents; half of the begins are one word."""
    for name, value in (("SHARD_TOKENS", 4000), ("CHUNK_TOKENS", 2000), ("FREQUENT", 2)):
        monkeypatch.setattr(ngram_lm, name, value)
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(12)]  # so few that each shard has a level for each probability
    texts = [" ".join(["hot", "pair"] * rng.randint(150, 250) if i % 6 == 0 else rng.choices([*pool, "hot", "pair"], k=rng.randint(0, 90)))
             for i in range(600)]
    texts += ["hot", "pair hot pair", "unseen hot unseen pair", "hot unseen"]
    held = [i % 5 == 1 or i >= 600 for i in range(len(texts))]
    frame = spark.createDataFrame(list(zip(range(len(texts)), texts)), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r for r in ngram_lm.score_corpus(frame, (F.col("doc_id") % 5 == 1) | (F.col("doc_id") >= 600)).collect()}

    docs = [["begin", *t.split(), "end"] for t in texts]
    train = [x for x, h in zip(docs, held) if not h]
    count, pairs = Counter(w for x in train for w in x[1:]), Counter(p for x in train for p in zip(x, x[1:]))
    context, follow = Counter(), Counter(u for u, _ in pairs)
    for (u, _), n in pairs.items():
        context[u] += n
    space = sum(count.values()) + len(count) + 1
    for doc, x in enumerate(docs):
        base = sum(math.log10((count[w] + 1) / space) for w in x[1:])
        score = 0
        for u, w in zip(x, x[1:]):
            single = (count[w] + 1) / space
            score += math.log10((max(pairs[u, w] - 0.75, 0) + 0.75 * follow[u] * single) / context[u] if context[u] else single)
        row = got[doc]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(x) - 1, sum(count[w] > 0 for w in x[1:]), sum(count.values()))
        assert row["base_score"] == pytest.approx(base, rel=1e-9)
        assert abs(row["score"] - score) < 1e-4 * len(x), doc

    rows = frame.select(F.col("doc_id").alias("key"), F.lit(False).alias("held_out"), "text")
    deal = ngram_lm.Deal(*ngram_lm.frequent(rows))
    key = ngram_lm._pair_key(*ngram_lm.word_ids([b"hot", b"pair"]).reshape(2, 1))
    assert key[0] in deal.pairs
    # two bytes a use: no shard has much more than its part of them
    uses = ngram_lm._dealt(rows, deal).mapValues(lambda x: len(ngram_lm._unpack(x[2], ngram_lm.KINDS)[5])).reduceByKey(lambda a, b: a + b)
    assert max(n for _, n in uses.collect()) < 3 * ngram_lm.SHARD_TOKENS


# ---- licenses

def test_edited_notices():
    scanner = license_align.Scanner(license_align.TEMPLATES)
    pad = [b"pad%d" % i for i in range(60)]
    for name, template in scanner.templates.items():
        def found(*parts):
            return sorted(x[2:4] for x in scanner.scan([w for p in parts for w in p], 0.8) if x[0] == name)

        count, half = Counter(template), len(template) // 2
        once = [w for w in template if count[w] == 1]
        for k in range(1, len(once)):
            left = [w for w in template if w not in once[:k]]
            if len(license_align.align([*pad, *left, *pad], template)) >= 0.8 * len(template):
                assert found(pad, left, pad), (name, k)
        gap = pad[:min(12, len(template))]
        assert found(pad, template[:half], gap, template[half:], pad) == [(60, 60 + len(template) + len(gap))]
        # a notice after a piece of it
        at = 60 + len(template) - half + 20
        assert (at, at + len(template)) in found(pad, template[half:], pad[:20], template, pad)


def longest_common(text, template):
    row = [0] * (len(template) + 1)
    for w in text:
        last = 0
        for j, t in enumerate(template, 1):
            row[j], last = (last + 1 if w == t else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_scan_against_every_place():
    scanner, rng = license_align.Scanner(license_align.TEMPLATES), random.Random(6)
    names = list(scanner.templates)
    loose = [w for t in scanner.templates.values() for w in t]
    for _ in range(12):
        text = []
        for name in rng.sample(names, 3):
            text += [rng.choice(loose) if rng.random() < 0.2 else b"w%d" % rng.randint(0, 99) for _ in range(rng.randint(0, 60))]
            text += [b"edit" if rng.random() < 0.1 else w for w in scanner.templates[name] if rng.random() > 0.05]
        found = scanner.scan(text, 0.8)
        for name, share, a, b, n in found:
            template = scanner.templates[name]
            assert share == n / len(template) >= 0.8 and longest_common(text[a:b], template) >= n
        for name, template in scanner.templates.items():
            own = [x[2:4] for x in found if x[0] == name]
            size = len(template)
            for a in range(len(text)):
                if text[a] not in template:
                    continue
                pairs = license_align.align(text[a:a + size], template)
                if len(pairs) >= 0.8 * size:
                    assert any(x < a + size and a < y for x, y in own), (name, a, own)


def test_notices_in_far_pieces():
    scanner, rng = license_align.Scanner(license_align.TEMPLATES), random.Random(3)

    def pad(n):
        return [b"w%d" % rng.randint(0, 999) for _ in range(n)]

    for name, template in scanner.templates.items():
        size = len(template)
        if size < license_align.JOINED:
            continue
        least = min(license_align.PIECE, int(0.2 * size) + 1)

        def found(*parts):
            return [x[1:] for x in scanner.scan([w for p in parts for w in p], 0.8) if x[0] == name]

        for _ in range(20):
            p = rng.randint(1, size - 1)
            one, = found(pad(30), template[:p], pad(size + 40), template[p:], pad(30))
            assert one[3] == size or max(p, size - p) >= 0.8 * size  # a piece that is enough stays by itself
            p, q = sorted(rng.sample(range(1, size), 2))
            words = sum(x for x in (p, q - p, size - q) if x >= least)
            if words >= 0.8 * size:
                got, = found(pad(30), template[:p], pad(300), template[p:q], pad(2000), template[q:], pad(30))
                assert got[0] == got[3] / size
                assert got[3] >= words or max(p, q - p, size - q) >= 0.8 * size
        half = size // 2
        # pieces in another order are no notice; two notices in pieces are two; a whole one between pieces counts for itself
        assert not found(template[half:], pad(300), template[:half])
        assert len(found(template[:half], pad(300), template[half:], pad(300), template[:half], pad(300), template[half:])) == 2
        assert sorted(x[0] for x in found(template[:half], pad(300), template, pad(300), template[half:])) == [1.0, 1.0]
        assert not found(*[x for i in range(0, size, 2) for x in (template[i:i + 2], pad(300))])
