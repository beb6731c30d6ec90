"""Odd rows, empty tables and clashing columns, for every operator and stage."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cases import ROWS, empty, items, labels, odd
from tidemark.llm import (
    decontaminate, divergence, importance, license_align, line_winnow, ngram_lm, packing, simhash, token_blocks, toxicity,
)
from tidemark.session import scratch

IDS = Counter(r[0] for r in ROWS)


def tokens(spark, docs):
    path = scratch(spark, "tokens")
    token_blocks.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_blocks.read_documents(spark, path)


# name: (function, whether every row comes back)
OPERATORS = {
    "tokens": (tokens, True),
    "toxicity": (lambda s, d: toxicity.score(d, toxicity.train(d, labels(s))), True),
    "simhash": (lambda s, d: simhash.near_duplicates(d), True),
    "lm": (lambda s, d: ngram_lm.score_corpus(d, F.col("doc_id") == 1), True),
    "importance": (lambda s, d: importance.resample(d, labels(s)), True),
    "quality": (lambda s, d: divergence.assess(d).select("row.doc_id", "f.*", "kept"), True),
    "lines": (lambda s, d: line_winnow.dedup_lines(d).drop("row"), True),
    "leaks": (lambda s, d: decontaminate.find_leaks(d, items(s)), False),
    "licenses": (lambda s, d: license_align.scan_licenses(d), False),
    "packing": (lambda s, d: packing.pack_documents(d).filter("piece = 0"), True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    run, every = OPERATORS[name]
    rows = run(spark, odd(spark)).collect()
    if every:
        assert Counter(r["doc_id"] for r in rows) == IDS


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name][0](spark, empty(spark)).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_and_empty(spark, tmp_path, name, stage):
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd(spark), empty(spark)):
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            assert all(r["score"] == "own score" for r in rows)


def test_leaks_and_empty_benchmark(spark):
    found = decontaminate.find_leaks(odd(spark), items(spark)).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, found)) == [(6, 1), (7, 1)]
    assert decontaminate.find_leaks(odd(spark), items(spark).limit(0)).collect() == []


def test_simhash_of_odd_rows(spark):
    found = {r["doc_id"]: r for r in simhash.near_duplicates(odd(spark).filter("doc_id is not null")).collect()}
    assert found[2]["fingerprint"] == found[3]["fingerprint"] == found[4]["fingerprint"] == "0" * 16
    assert {found[i]["component_id"] for i in (2, 3, 4)} == {2}
    assert {found[i]["component_id"] for i in (6, 7)} == {6}
    kept = Counter(r["doc_id"] for r in simhash.keep_one(odd(spark)).collect())
    assert kept == Counter([1, 2, 5, 6, 8, None])


def test_toxicity_without_labels(spark):
    lexicon = toxicity.train(odd(spark), labels(spark).limit(0))
    assert {r["score"] for r in toxicity.score(odd(spark), lexicon).collect()} == {0.5}


def test_lm_without_training_rows(spark):
    rows = ngram_lm.score_corpus(odd(spark), F.lit(True)).collect()
    assert all(r["score"] == r["base_score"] and r["train_tokens"] == 0 and r["n_known"] == 0 for r in rows)
