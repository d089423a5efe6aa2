"""The corpus pipeline: quality, toxicity and near-duplicate filters, then packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. The filters return the columns of
documents as they were, whatever further columns there are; the last stage returns the packed pieces.

Null and empty texts are no good quality and go. Rows with a null id are kept like others; of near duplicates the one of the
smallest id stays, of repeated rows one, of unlike texts under one id each. Very long texts are worked on whole. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarryspark.llm import packing, quality, simhash, toxicity
from quarryspark.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity trusted text doesn't exceed."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar by 0.8 or more."""
    return simhash.without_near_duplicates(docs, shingle=5, similarity=0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in windows of 1024."""
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), added=added)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", near_duplicates),
    ("packing", packed),
]

#: No stage but the first join of labels can be said in SQL: language model, neighbours, components and packing can't.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
