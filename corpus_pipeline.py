"""A corpus pipeline: language identification, quality, near-duplicates, packing.

Each stage takes the documents that its predecessor kept and works on all of them; all but the last return the
columns of ``documents``.  :func:`run` writes every stage's rows to the shared checkpoint folder and reads them again.

Defined results: a null, empty or letterless text has no language and goes with the first stage; rows that repeat an id
are documents of their own, and one of them goes only if its text has a near copy; an empty table gives no pieces;
extra columns travel along up to the packing stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import langid, packing, quality, queries, simhash
from shelfspark.llm._batches import dropped, saved, swept, tables


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the model is fitted on the labelled ones among them."""
    return langid.keep_identified(docs, langid.fit(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likely to have the highest grade; the model is fitted on the rated ones among them."""
    return quality.keep_good(docs, quality.fit(docs, queries.graded(queries.table(spark, sf_dir, "labels"))))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of exact and near copies; unlike texts of one id all stay."""
    return simhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in windows of 2048 tokens."""
    return packing.pack_documents(docs, queries.vocabulary("word_bpe_49k.json"))


STAGES = [("language ID", language), ("quality classifier", good), ("SimHash near-dedup", distinct), ("packing", packed)]

#: The stages are models and tokenizers, which SQL does not express; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before = list(tables(spark))
        done = swept(saved(stage(spark, docs, sf_dir)), before)  # what the stage wrote for itself goes
        if before and before[-1] == getattr(docs, "_saved_at", None):
            dropped(docs)
        docs = done
    return docs
