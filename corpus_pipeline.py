"""From raw documents to packed token windows, one table to the next.

Each stage reads all that its predecessor kept, as Parquet in the shared
folder, and returns what it keeps; all but the last return the columns of
documents. The last stage returns the pieces of the packed windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import exact_dedup, jaccard_join, mixing, packing, quality
from lodestone.llm.common import materialize, release, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest id."""
    return exact_dedup.drop_copies(docs)


def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 5-word shingle sets with a similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs, measure=jaccard_join.Measure(5, 4, 5))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_sources(docs)


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_documents),
    ("exact_dedup", distinct_documents),
    ("jaccard_join", dissimilar_documents),
    ("mix", mixed_documents),
    ("pack", packed_windows),
]

#: A network, shingle components and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if done is not None:
            release(done)  # the next stage's table is written
        done = docs
    return docs
