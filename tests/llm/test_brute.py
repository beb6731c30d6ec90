"""Operators against plain versions of what they compute."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import (
    base, components, decontaminate, divergence, elias_fano, importance, license_align, line_winnow, ngram_lm, packing, queries,
    simhash, token_blocks, toxicity, word_ids,
)
from tidemark.session import scratch

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def closure(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


# ---- token blocks

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), st.data())
def test_blocks_round_trip(ids, data):
    ids = np.array(ids, np.uint32)
    segment = token_blocks.Segment(token_blocks.encode(ids))
    assert (segment.ids() == ids).all()
    a, b = sorted(data.draw(st.tuples(st.integers(0, len(ids)), st.integers(0, len(ids)))))
    assert (segment.ids(a, b) == ids[a:b]).all()


PIECES = ["word", "Ünd", "ß", "12", " ", " ", "  ", "\n", "\t", "'s", "!", "...", "***", "中", "😀", "²", "_", "<|endoftext|>", "<|ENDoftext|>",
          "\x1c", "\x85", "don't", "É", "é", "İ", "Σ", "\u0301", "\u00a0", "K", "\r", "\x0b", "ª", "½", "ﬃ"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), min_size=1, max_size=8))
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_ids_equal_the_library(name, batch):
    path = public_tokenizers.path(name)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(batch, add_special_tokens=False)]
    ids, edges = word_ids.WordIds.of_worker(path)(pa.array(batch))
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == want


def test_word_ids_after_forgetting(docs, monkeypatch):
    monkeypatch.setattr(word_ids, "KNOWN_WORDS", 50)
    encoder, plain = word_ids.WordIds(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for _, text, _ in docs[:60]:
        assert encoder(pa.array([text]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_special_string_and_rows_of_one_id(spark):
    rows = [(7, "hello <|endoftext|> world"), (7, "b"), (7, "a"), (7, "a"), (None, "first"), (None, None)]
    path = scratch(spark, "tokens")
    token_blocks.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, TOKENIZER)
    got = token_blocks.read_documents(spark, path).orderBy("start").collect()
    sizes = {"hello <|endoftext|> world": 5, "b": 2, "a": 2, "first": 2, None: 1}
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == sorted((d or 0, sizes[t]) for d, t in rows)
    assert [r["doc_id"] for r in got] == [None, None, 7, 7, 7, 7]
    flat = [r["id"] for r in token_blocks.read_range(spark, path, 0, 100).orderBy("position").collect()]
    assert any(flat[i:i + 5] == [31373, 220, 50256, 995, 0] for i in range(len(flat)))


def test_token_query(spark, docs):
    plain, at, want = Tokenizer.from_file(TOKENIZER), 0, []
    for doc, text, _ in docs:
        ids = plain.encode(text, add_special_tokens=False).ids + [0]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = queries.QUERIES["op1_token_blocks"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_read_range(spark, docs, monkeypatch):
    monkeypatch.setattr(token_blocks, "SEGMENT_TOKENS", 3000)
    path = scratch(spark, "tokens")
    token_blocks.write_tokens(spark.createDataFrame(docs, "doc_id long, text string, source string"), path, TOKENIZER)
    plain = Tokenizer.from_file(TOKENIZER)
    flat = [i for _, t, _ in docs for i in [*plain.encode(t, add_special_tokens=False).ids, 0]]
    got = token_blocks.read_range(spark, path, 2500, 9500).orderBy("position").collect()
    assert [tuple(r) for r in got] == list(enumerate(flat))[2500:9500]


# ---- toxicity

def test_folding():
    assert toxicity.fold("Тhe w0rthless STUPID$$$ 1d1ot, é!") == " the worthless stupid idiot e "
    assert toxicity.fold("Тrаsh") == " trash "


def test_exceptions_and_longest_match():
    lexicon = toxicity.Lexicon({"tras": 2.0, "trash": 3.0, "idiot ": 4.0}, ["trash can"])
    assert lexicon.matches(toxicity.fold("trash talk")) == [(0, 3.0)]
    assert lexicon.matches(toxicity.fold("the trash can")) == []
    assert lexicon.matches(toxicity.fold("idiotic idiot")) == [(8, 4.0)]
    assert lexicon.matches(toxicity.fold("xtrash")) == []


def test_matches_against_plain_search():
    rng = random.Random(12)
    words = ["ab", "abc", "abcd", "b", "bc", "abab", "c"]
    for _ in range(300):
        terms = {rng.choice(words) + rng.choice(["", " "]): rng.randint(1, 9) / 4 for _ in range(rng.randint(0, 6))}
        phrases = [" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(rng.randint(0, 4))]
        phrases = [p for p in phrases if p + " " not in terms]
        body = rng.choices(words, k=rng.randint(0, 40))
        folded, wanted, at = f" {' '.join(body)} ", [], 0
        inside = set()
        for phrase in phrases:
            size = phrase.count(" ") + 1
            for i in range(len(body)):
                if body[i:i + size] == phrase.split():
                    inside.update(range(i, i + size))
        for i, word in enumerate(body):
            fits = [t for t in terms if (word + " ").startswith(t)]
            if fits and i not in inside:
                wanted.append((at, terms[max(fits, key=len)]))
            at += len(word) + 1
        assert toxicity.Lexicon(terms, phrases).matches(folded) == wanted


def test_long_text_of_spared_matches():
    lexicon = toxicity.Lexicon({"trash": 1.0}, ["trash can"])
    found = lexicon.matches(toxicity.fold("trash can and trash talk " * 100_000))
    assert len(found) == 100_000 and found[0] == (14, 1.0)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.QUERIES["op2_toxicity"](spark, sf).filter("held_out")
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("toxic", "predicted").collect()
    hit = Counter(map(tuple, rows))
    assert hit[1, 1] / (hit[1, 1] + hit[1, 0]) > 0.85
    assert hit[0, 1] / (hit[0, 1] + hit[0, 0]) < 0.01


def test_sample_is_bounded_in_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "_logistic", lambda x, y: seen.append(len(y)) or (0.0, 0.0, 0.0, 0.0))
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("stupid text "), "id").alias("text")).union(
        spark.createDataFrame([(2, "a clean text"), (3, "another")], "doc_id long, text string"))
    toxicity.train(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int"), sample_rows=3, min_documents=1)
    assert seen == [3]


# ---- SimHash

def plain_fingerprint(text):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    size = min(3, len(found))
    h = [xxhash.xxh64_intdigest(b" ".join(found[i:i + size]), 42) for i in range(len(found) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_query(spark, docs):
    fps = [plain_fingerprint(t) for _, t, _ in docs]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    root = closure(len(fps), links)
    want = [(docs[i][0], f"{fps[i]:016x}", docs[root[i]][0]) for i in range(len(fps))]
    assert sorted(map(tuple, queries.QUERIES["op3_simhash"](spark, SF).collect())) == want


@pytest.mark.parametrize("radius,bucket", [(0, 4096), (1, 8), (2, 4096), (2, 8), (3, 8)])
def test_near_links(spark, monkeypatch, radius, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = np.unique(np.concatenate([base[rng.integers(0, 12, 300)] ^ np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64) for _ in range(2)]))
    links = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= radius]
    nodes = spark.createDataFrame([(int(x), i) for i, x in enumerate(fps.view(np.int64))], "fp long, node long")
    found = {r["node"]: r["component"] for r in components.components(simhash.near_links(nodes, radius)).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == closure(len(fps), links)


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(100)] + [(200, 201), (7, 7), (None, 5)]
    random.Random(1).shuffle(chain)
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(101)}, 200: 200, 201: 200}


# ---- language model

@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**60) | st.integers(0, 40), max_size=200), st.lists(st.integers(0, 60), max_size=20))
def test_elias_fano(values, asked):
    values = np.sort(np.array(values, np.uint64))
    sequence = elias_fano.EliasFano(elias_fano.EliasFano.encode(values))
    assert (sequence.access(np.arange(len(values))) == values).all()
    first = {}
    for i, v in enumerate(values.tolist()):
        first.setdefault(v, i)
    asked = [*asked, *values.tolist()]
    assert sequence.find(np.array(asked, np.uint64)).tolist() == [first.get(x, -1) for x in asked]


@pytest.mark.parametrize("shard_tokens", [1 << 20, 4000])
def test_lm_query(spark, docs, monkeypatch, shard_tokens):
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", shard_tokens)
    if shard_tokens < 10_000:
        monkeypatch.setattr(ngram_lm, "CHUNK_TOKENS", 2000)
        monkeypatch.setattr(ngram_lm, "FREQUENT", 2)
    count, pairs = Counter(), Counter()
    for doc, text, _ in docs:
        if zlib.crc32(str(doc).encode()) % 7 != 2:
            found = text.encode().lower().split()
            count.update([*found, "end"])
            pairs.update(zip(["begin", *found], [*found, "end"]))
    total, types = sum(count.values()), len(count)
    context, mass = Counter(), Counter()
    for (u, _), n in pairs.items():
        context[u] += n
        mass[u] += n - 0.75
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_ngram_lm"](spark, SF).collect()}
    for doc, text, _ in docs:
        seq, row = [*text.encode().lower().split(), "end"], got[doc]
        base = [math.log10((count[w] + 1) / (total + types + 1)) for w in seq]
        score = 0
        for u, w, b in zip(["begin", *seq], seq, base):
            kept = max(pairs[u, w] - 0.75, 0)
            score += math.log10(kept / context[u] + (1 - mass[u] / context[u]) * 10**b) if context[u] else b
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(seq), sum(count[w] > 0 for w in seq), total)
        assert row["base_score"] == pytest.approx(sum(base), rel=1e-9)
        assert abs(row["score"] - score) < 0.05 * len(seq)  # 8-bit probabilities


# ---- importance resampling

def test_top_k(spark):
    keys = [random.Random(4).randint(-10**12, 10**12) for _ in range(500)] + [7] * 20
    frame = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, key long")
    for k in (0, 1, 250, 519, 520, 600):
        got = {r["key"] for r in importance.top_k(frame, "key", k).filter("selected").collect()}
        assert got == set(sorted(keys, reverse=True)[:k])


def test_importance_prefers_the_target(spark):
    rows = importance.resample(
        spark.createDataFrame([(i, ("good words here " if i % 2 else "junk %% stuff ") * 20) for i in range(40)], "doc_id long, text string"),
        spark.createDataFrame([(i,) for i in range(1, 20, 2)], "doc_id long"), k=20).filter("selected").collect()
    assert {r["doc_id"] % 2 for r in rows} == {1}


def test_importance_against_plain_counts(spark):
    rng = random.Random(8)
    kinds = ["the cat sat on a mat and ate", "buy now cheap %% offer $$ click", "x"]
    rows = [(i, " ".join(rng.choices(rng.choice(kinds).split(), k=rng.randint(0, 30)))) for i in range(120)]
    rows += [(5, "a row with an id that comes twice"), (None, "the cat sat"), (7, None)]
    target = {i for i in range(0, 60, 3)} | {5, 7}
    got = importance.resample(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in target], "doc_id long"), reach=0.9).collect()

    def grams(text):
        h = [xxhash.xxh64_intdigest(w.encode()) for w in (text or "").split()]
        for i, x in enumerate(h):
            yield x % importance.FEATURES
            if i + 1 < len(h):
                x = x * 0x9E3779B97F4A7C15 % 2**64 ^ h[i + 1]
                yield (x ^ x >> 29) % importance.FEATURES

    every, good = Counter(), Counter()
    for doc, text in rows:
        every.update(grams(text))
        if doc in target:
            good.update(grams(text))
    n_every, n_good = importance.FEATURES + every.total(), importance.FEATURES + good.total()
    wanted = Counter()
    for doc, text in rows:
        own = Counter(grams(text)) if doc in target else Counter()  # a target row is not in its own model
        weight = sum(math.log((good[g] + 1 - own[g]) / (n_good - own.total()) * n_every / (every[g] + 1)) for g in grams(text))
        wanted[doc, doc in target, len(list(grams(text))), round(weight, 6)] += 1
    assert Counter((r["doc_id"], r["in_target"], r["n_grams"], round(r["log_weight"], 6)) for r in got) == wanted
    # noise of a Gumbel draw on top, and as many rows as reach the key of nine tenths of the target
    keys = sorted(r["key"] for r in got if r["in_target"])
    least = keys[math.ceil(len(keys) * 0.1) - 1]
    assert all(r["selected"] == (r["key"] >= least) for r in got)
    noise = [r["key"] / 1e6 - r["log_weight"] for r in got]
    assert abs(sum(noise) / len(noise) - 0.577) < 0.4 and min(noise) > -2.5


# ---- line dedup

def plain_repeats(texts, least):
    """Texts without the words of runs of ``least`` words that an earlier document holds, or the same one before."""
    seen, out = {}, {}
    for doc, text in texts:
        words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        body, gone = [text[a:b] for a, b in words], set()
        for i in range(len(body) - least + 1):
            first = seen.setdefault(tuple(body[i:i + least]), (doc, i))
            if first[0] != doc or i - first[1] >= least:
                gone.update(range(i, i + least))
        lines, n = [], 0
        for line in text.split("\n"):
            count = len(re.findall(r"[^\x20\x09-\x0D]+", line))
            own = [k for k in range(n, n + count) if k not in gone]
            if len(own) == count:
                lines.append(line)
            elif own:
                runs = [[own[0], own[0]]]
                for k in own[1:]:
                    if k == runs[-1][1] + 1:
                        runs[-1][1] = k
                    else:
                        runs.append([k, k])
                lines.append(" ".join(text[words[a][0]:words[b][1]] for a, b in runs))
            n += count
        out[doc] = "\n".join(lines)
    return out


def test_line_query(spark, docs):
    got = {r["doc_id"]: r["text"] for r in queries.QUERIES["op7_line_dedup"](spark, SF).collect()}
    want = plain_repeats([(d, t) for d, t, _ in docs], 50)
    assert got == want and sum(want[d] != t for d, t, _ in docs) > 10


@pytest.mark.parametrize("least", [3, 8, 20])
def test_line_runs(spark, least):
    rng = random.Random(least)
    pool = [" ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(1, 40))) for _ in range(25)]
    texts = [(i, rng.choice(["\n", " ", "  \t"]).join(rng.choice([*pool, "", f"own{i}", "x x x x x x"]) for _ in range(rng.randint(0, 25)))) for i in range(60)]
    texts += [(60, "p q " * 60), (61, "p q " * 20 + "r " * 30), (62, "")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["text"] for r in line_winnow.dedup_lines(frame, min_words=least).collect()}
    assert got == plain_repeats(texts, least)


def test_line_passages_begin_anywhere(spark):
    """A passage of 50 words inside other lines, with other breaks, is found in every later document."""
    passage = [f"p{i}" for i in range(50)]
    texts = [(i, " ".join(f"a{i}x{k}" for k in range(i * 7 % 30)) + " " + ("\n" if i % 2 else " ").join(passage) + f" z{i} " * 60) for i in range(20)]
    texts.append((20, " ".join(passage[:49])))
    rows = {r["doc_id"]: r for r in line_winnow.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert rows[0]["n_removed"] == 0 and rows[20]["n_removed"] == 0
    assert all(rows[i]["n_removed"] == 50 and "p49" not in rows[i]["text"] and f"z{i}" in rows[i]["text"] for i in range(1, 20))


# ---- decontamination

def test_block_max_wand_equals_all_scores():
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}".encode() for _ in range(3000)]
    index = decontaminate.Index((i, b" ".join(rng.choices(vocabulary, k=rng.randint(1, 150)))) for i in range(300))
    for _ in range(60):
        found = [index.terms[w] for w in set(rng.choices(vocabulary, k=rng.randint(1, 150))) if w in index.terms]
        scores = defaultdict(float)
        for t in found:
            for part, x in zip(index.parts[t], index.impacts[t]):
                scores[part] += x
        for threshold in (0.05, 0.3, 0.6):
            got = dict(index.search(found, threshold))
            assert got.keys() == {p for p, s in scores.items() if s >= threshold - 1e-9}


def test_leak_query(spark, docs):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    want = set()
    for doc, text, _ in docs:
        found = decontaminate.tokens(text.encode())
        held = {n: decontaminate.shingles(found, n) for n in range(1, 6)}
        for item, body in items:
            sides = decontaminate.question_and_answer(body.encode())
            if all(len((s := decontaminate.shingles(x, min(5, len(x)))) & held[min(5, len(x))]) >= 0.8 * len(s) for x in sides):
                want.add((doc, item))
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op8_decontaminate"](spark, SF).collect()}
    assert got == want and got


def test_long_item_and_blocks_of_the_index(spark):
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(1, " ".join(["x"] * 500 + words + ["y"] * 300)), (2, " ".join(words[:60]))], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(words) if i == 9 else f"other {i} thing") for i in range(40)], "item_id long, text string")
    for size in (200_000, 60):
        got = decontaminate.find_leaks(docs, items, index_words=size).select("doc_id", "item_id").collect()
        assert list(map(tuple, got)) == [(1, 9)]


def test_one_id_with_two_texts_and_scores_over_blocks(spark):
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.8))}x{rng.randint(0, 40)}" for _ in range(4000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(8, 90)))) for i in range(60)]
    items += [(7, "an entirely different question about rivers? with an answer of its own"), (7, None), (7, items[3][1])]
    docs = [(i, " ".join(rng.choices(words, k=200)) + " " + (items[i][1] or "") + " tail " * 50) for i in range(len(items))]
    frames = (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = [sorted(map(tuple, decontaminate.find_leaks(*frames, index_words=n).drop("version").collect())) for n in (200_000, 600)]
    assert found[0] == found[1]
    pairs = {(r[0], r[1]) for r in found[0]}
    assert pairs >= {(i, items[i][0]) for i in range(len(items)) if items[i][1]} and (60, 7) in pairs and (7, 7) in pairs and (3, 7) in pairs


# ---- licenses

def test_increasing():
    rng = random.Random(2)
    for _ in range(50):
        values = [rng.randint(0, 9) for _ in range(rng.randint(0, 12))]
        best = 0
        for mask in range(1 << len(values)):
            own = [v for i, v in enumerate(values) if 1 << i & mask]
            if all(a < b for a, b in zip(own, own[1:])):
                best = max(best, len(own))
        got = license_align.increasing(values)
        assert len(got) == best and all(values[a] < values[b] for a, b in zip(got, got[1:]))


def test_license_scan(spark):
    mit = license_align.TEMPLATES["mit"]
    edited = mit.replace("free of charge", "at no cost").replace("copies of the Software", "its copies", 1)
    rows = [(1, f"Intro words here.\n{mit}\nEnd."), (2, f"Text.\n{edited}"), (3, "nothing of the kind, without permission of anyone"),
            (4, "x\nReleased under the MIT License.\n" + "pad " * 200 + "\nReleased under the MIT License."),
            (5, f"{mit}\n{mit}")]
    got = license_align.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = Counter((r["doc_id"], r["license"]) for r in got)
    assert found == {(1, "mit"): 1, (2, "mit"): 1, (4, "mit-notice"): 2, (5, "mit"): 2}
    share = {r["doc_id"]: r["coverage"] for r in got}
    assert share[1] == 1.0 and 0.9 < share[2] < 1.0


# ---- packing

def plain_pack(pieces, capacity):
    bins, out = [], []
    for size, source, cluster in pieces:
        fits = [(capacity - used, i) for i, (used, sources, clusters) in enumerate(bins)
                if used < capacity and capacity - used >= size and (source is None or source not in sources) and (cluster is None or cluster not in clusters)]
        if fits:
            _, i = min(fits)
        else:
            i = len(bins)
            bins.append([0, set(), set()])
        out.append((i, bins[i][0]))
        bins[i][0] += size
        bins[i][1].add(source)
        bins[i][2].add(cluster)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_packing_equals_plain_best_fit(seed):
    rng = random.Random(seed)
    pieces = [(rng.randint(1, 100), rng.choice(["hot", "hot", "a", "b", "c", None]), rng.choice([1, 2, *range(3, 400), None])) for _ in range(1200)]
    pieces.sort(key=lambda p: -p[0])
    assert packing.pack(pieces, 100) == plain_pack(pieces, 100)


def test_packing_query(spark, docs):
    rows = queries.QUERIES["op10_packing"](spark, SF).collect()
    sizes, bins = Counter(), defaultdict(list)
    for r in rows:
        sizes[r["doc_id"]] += r["n_tokens"]
        bins[r["bin_id"]].append(r)
    assert sizes == {d: len(t.encode().split()) + 1 for d, t, _ in docs}
    for held in bins.values():
        assert len({r["source"] for r in held}) == len(held) == len({r["cluster"] for r in held})
        edges = sorted((r["bin_offset"], r["n_tokens"]) for r in held)
        assert all(a + n == b for (a, n), (b, _) in zip(edges, edges[1:])) and edges[0][0] == 0
        assert sum(n for _, n in edges) <= 2048


def test_equal_rows_go_to_all_shards(spark):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit(None).cast("string").alias("source"))
    sizes = [r["count"] for r in packing.pack_documents(docs, 64, shard_pieces=100).groupBy(F.shiftright("bin_id", 32)).count().collect()]
    assert len(sizes) == 30 and max(sizes) < 160


# ---- quality rules and pipeline

def test_quality_has_no_python(spark):
    frame = queries.QUERIES["op6_quality_rules"](spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_repeated_words_and_lines(spark):
    text = "a b c d a b c\nx\nx\n\n \nx y"
    row = divergence.assess(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")).select("f.*").first()
    assert (row["n_words"], row["word_chars"], row["n_dup_lines"], row["n_repeat_words"]) == (11, 11, 1, 6)


def test_keep_one_of_a_group(spark):
    same, other, third = "one two three four five six", "seven eight nine ten eleven", "a b c d e f g"
    docs = [(3, same), (1, same), (2, other), (2, other), (None, same), (None, third), (None, third), (5, None), (6, "")]
    got = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter([(1, same), (2, other), (None, third), (5, None)])


def test_likely_rows_lose_none(spark, monkeypatch):
    monkeypatch.setattr(base, "LIKELY_BITS", 1 << 10)
    df = spark.range(5000).withColumn("k", F.when(F.col("id") % 100 != 0, F.col("id")))
    wanted = spark.createDataFrame([(i,) for i in range(1, 5000, 50)] + [(-4,)], "h long")
    got = {r["id"] for r in base.likely(df, F.col("k"), wanted).collect()}
    assert got >= set(range(1, 5000, 50)) and len(got) < 1200
    marked = base.likely(df, F.col("k"), wanted, flag="maybe").collect()
    assert len(marked) == 5000 and {r["id"] for r in marked if r["maybe"]} == got
    assert base.likely(df, F.col("k"), wanted.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = dict(duckdb.sql(f"""
        WITH documents AS (SELECT * FROM '{SF}/documents.parquet'), k AS ({queries.ORACLES['op6_quality_rules']})
        SELECT doc_id, text FROM documents JOIN k USING (doc_id) WHERE kept""").fetchall())
    cut = plain_repeats(sorted(kept.items()), 50)
    cut = {d: t for d, t in cut.items() if t.split() or not kept[d].split()}
    ids = sorted(cut)
    fps = [plain_fingerprint(cut[d]) for d in ids]
    root = closure(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    ids = [d for i, d in enumerate(ids) if root[i] == i]
    left = spark.createDataFrame([(d, cut[d]) for d in ids], "doc_id long, text string")
    leaks = {r["doc_id"] for r in decontaminate.find_leaks(left, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    want = {d: len(cut[d].encode().split()) + 1 for d in ids if d not in leaks}
    sizes = Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        sizes[r["doc_id"]] += r["n_tokens"]
    assert sizes == want and docs.count() > len(want) > 100
