"""A corpus pipeline of five operators.

Each stage takes all documents that its predecessor kept, written as Parquet and read again. Stages return the columns of
``documents``, further columns included, whatever their names; the last returns the packed pieces. Null texts count as empty; an empty table gives an
empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from askframe.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from askframe.llm.common import drop, written
from askframe.llm.queries import table, vocabulary


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the labels of documents still here.

    Equal texts have equal scores, so copies go or stay together; rows without an id are scored too, but teach nothing.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the document with the largest id; a null id is smaller than any other. A row that repeats an id and text stays once."""
    return exact_dedup.drop_copies(docs, "doc_id", "text", keep="max")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the document with the smallest id. Texts without words and rows without an id stay."""
    return ngram_join.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. A null source is a source; documents without words are taken as often as others of their source; ties are broken by id."""
    return mixing.mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens; a document that the mix repeats has each piece as often."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), 4096)


STAGES = [
    ("toxicity", toxic),
    ("exact dedup", copies),
    ("near dedup", near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: Learned scores, hash order and the packing search have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        drop(*before)  # what a stage read is not needed once its result is written
        before = [docs]
    return docs
