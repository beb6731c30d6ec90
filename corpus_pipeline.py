"""From raw documents to packed training sequences: five stages, each a Parquet table for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, divergence, line_winnow, packing, simhash
from tidemark.llm.base import unpack
from tidemark.llm.queries import table
from tidemark.session import cut_lineage, prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the divergence checks keep.

    A null or empty text has too few words and goes; rows that repeat are judged each; an empty table stays empty.
    """
    prepare(spark)
    return unpack(divergence.assess(docs).filter("kept"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of 50 words that an earlier one holds; those left without a word go.

    Null and empty texts stay as they are. The smallest doc_id keeps a run, a null one counting as the
    smallest; rows equal in id and text are one document, of which every row stays.
    """
    prepare(spark)
    return line_winnow.clean(docs, min_words=50)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the smallest doc_id.

    Null and empty texts have fingerprint zero and are one group; a row without an id stays only where its
    group has none with one; repeated rows leave one.
    """
    prepare(spark)
    return simhash.keep_one(docs, shingle=3, radius=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item. Null and empty texts stay; rows that repeat share their fate."""
    prepare(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of the documents in sequences of 2,048 words.

    A null text is an end token alone; null ids and repeated rows are kept; ties go by doc_id.
    """
    prepare(spark)
    return packing.pack_documents(docs, capacity=2048).drop("version")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

# fingerprints, winnowing and packing have no SQL form; tests hold the stages against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again, from ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
