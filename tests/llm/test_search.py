"""Lexical search and hard negatives: against SQL, against scoring everything, and odd rows."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cases import empty, items, odd
from check import compare, connect
from tidemark.llm import hard_negatives, lexical_search, queries
from tidemark.llm.lexical_search import terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
@pytest.mark.parametrize("name", ["op12_lexical_search", "op13_hard_negatives"])
def test_query_equals_sql(spark, name, sf):
    path = f"/root/testdata/sf{sf}"
    assert compare(spark, connect(path), path, queries.QUERIES[name], queries.ORACLES[name]) is None


def plain_search(docs, asked, k):
    lower = {i: i + 32 for i in range(65, 91)}
    found = [(d, Counter(TERM.findall((t or "").translate(lower)))) for d, t in docs]
    found = [(d, c, sum(c.values())) for d, c in found if c]
    total, every = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in asked:
        query, scores = Counter(TERM.findall((text or "").translate(lower))), []
        for d, c, n in found:
            m = 100 - 25 + 25 * n * total // every
            score = sum(r * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                        for t, r in query.items() if t in c)
            if score:
                scores.append((-score, (0, 0) if d is None else (1, d), d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores)[:k])]
    return Counter(out)


@pytest.mark.parametrize("seed,block,words,k", [(0, 8192, 200_000, 5), (1, 7, 200_000, 5), (2, 7, 30, 3), (3, 1, 10, 20)])
def test_search_equals_scoring_all(spark, monkeypatch, seed, block, words, k):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", block)
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["Ä", "ß1", "中文", "a-b", "X_y"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 40, 200])))) for i in range(200)]
    docs += [(rng.randint(0, 300), docs[5][1]) for _ in range(30)] + [(None, docs[5][1]), (None, None), (900, "...")]
    asked = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for i in range(12)] + [(3, docs[5][1]), (None, docs[5][1]), (50, None)]
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                                spark.createDataFrame(asked, "item_id long, text string"), k=k, index_words=words)
    assert Counter(map(tuple, got.collect())) == plain_search(docs, asked, k)


def test_search_odd_rows(spark):
    got = lexical_search.search(odd(spark), items(spark)).collect()
    assert {(r["item_id"], r["doc_id"]) for r in got if r["rank"] <= 3} >= {(1, 6), (1, 7), (None, 6)}
    assert Counter((r["item_id"], r["doc_id"]) for r in got)[1, 6] == 2 and {r["item_id"] for r in got} == {1, None}
    assert lexical_search.search(empty(spark), items(spark)).collect() == []
    assert lexical_search.search(odd(spark), items(spark).limit(0)).collect() == []
    assert lexical_search.search(spark.createDataFrame([(1, "...")], "doc_id long, text string"), items(spark)).collect() == []


def test_terms():
    for text in ["A-b_C9 ä,É\x00x", "", "中文。Z", "\x7fq\x80r"]:
        lower = text.translate({i: i + 32 for i in range(65, 91)})
        assert [t.decode() for t in terms_of(text.encode())] == TERM.findall(lower)


# ---- hard negatives

def plain_mine(rows, anchors, k=5, j=3):
    whole = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows
             if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for a, label, v in whole:
        if not anchors(a) or (a, label, tuple(v)) in seen:
            continue
        seen.add((a, label, tuple(v)))
        scored = [(-sum(x * y for x, y in zip(v, w)), i, m) for i, m, w in whole]
        for s, p, _ in sorted(x for x in scored if x[2] == label and x[1] != a)[:k]:
            near = sorted((t, i) for t, i, m in scored if m != label and 50 * -s <= 100 * -t <= 95 * -s)
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(near[:j])]
    return Counter(out)


@pytest.mark.parametrize("seed,block,group", [(0, 8192, 4096), (1, 16, 5), (2, 1, 4096)])
def test_mine_equals_scoring_all(spark, monkeypatch, seed, block, group):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "GROUP", group)
    rng = random.Random(seed)
    scale = [1.0, 1.0, 1.0, 3e5][seed]
    rows = [(i, rng.randint(0, 3), [rng.gauss(0.05, 0.3) * scale for _ in range(rng.choice([12, 12, 12, 5]))]) for i in range(250)]
    rows += [(i + 300, i % 4, [0.25] * 12) for i in range(60)] + [rows[0], rows[10], (10, 3, rows[10][2]), (20, 2, rows[30][2])]
    rows += [(400, None, [0.1] * 12), (410, 1, None), (None, 1, [0.1] * 12), (420, 1, [0.1, None]), (430, 1, [0.1, float("nan")]),
             (440, 1, [float("inf")]), (450, 1, []), (460, 2, [0.0] * 12)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    frame = frame.select("*", F.lit("x").alias("id"), F.lit("y").alias("anchor"), F.lit(0).alias("vector"))
    got = hard_negatives.mine(frame, F.col("vec_id") % 10 == 0)
    assert Counter(map(tuple, got.collect())) == plain_mine(rows, lambda i: i % 10 == 0)


def test_large_numbers_stay_exact(spark):
    rng = random.Random(9)
    rows = [(i, i % 2, [rng.choice([-1, 1]) * rng.uniform(4e5, 5e5) for _ in range(30)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert Counter(map(tuple, hard_negatives.mine(frame, F.col("vec_id") < 20).collect())) == plain_mine(rows, lambda i: i < 20)


def test_mine_of_nothing(spark):
    frame = spark.createDataFrame([(1, 1, [0.5])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(frame.limit(0), F.col("vec_id") > 0).collect() == []
    assert hard_negatives.mine(frame, F.col("vec_id") > 5).collect() == []
    assert hard_negatives.mine(frame, F.col("vec_id") > 0).collect() == []
