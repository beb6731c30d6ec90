"""One query per operator over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    decontaminate,
    divergence,
    hard_negatives,
    importance,
    lexical_search,
    license_align,
    line_winnow,
    ngram_lm,
    packing,
    simhash,
    slack_packing,
    token_blocks,
    toxicity,
)
from tidemark.llm.base import crc_remainder
from tidemark.llm.divergence_sql import ORACLE as DIVERGENCE_SQL
from tidemark.session import prepare, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op6_quality_rules": DIVERGENCE_SQL,
    "op12_lexical_search": lexical_search.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}


def _query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@_query
def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token ids in a folder of segments, read back from it."""
    path = scratch(spark, "tokens")
    token_blocks.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_blocks.read_documents(spark, path)


@_query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; a third of the ids is held out of the training."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.train(docs, labels.filter(crc_remainder(F.col("doc_id"), 3) != 1))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", (crc_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", "n_matches")


@_query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", "fingerprint", "component_id")


@_query
def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents; a seventh of the ids is held out of the training."""
    return ngram_lm.score_corpus(table(spark, sf_dir, "documents"), crc_remainder(F.col("doc_id"), 7) == 2)


@_query
def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn by their likeness to those labelled as good."""
    target = table(spark, sf_dir, "labels").filter("quality = 1")
    return importance.resample(table(spark, sf_dir, "documents"), target).drop("version")


@_query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of all documents."""
    found = divergence.assess(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), carry=["doc_id"])
    f = F.col("f")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[f[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed", "kept")


@_query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the runs of 50 words that an earlier one holds."""
    return line_winnow.dedup_lines(table(spark, sf_dir, "documents"), min_words=50).select("doc_id", "text", "n_removed", "spans")


@_query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items found in documents."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("version")


@_query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices found in documents."""
    return license_align.scan_licenses(table(spark, sf_dir, "documents"))


@_query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 2,048 words, no source or copy twice in one."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=2048).drop("version")


@_query
def op11_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of 2,048, with a digest of each piece."""
    pieces = slack_packing.pack_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return slack_packing.digest(pieces)


@_query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each test item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


@_query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives for every fiftieth vector; every seventh has a wrong label."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)
