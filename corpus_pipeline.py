"""Corpus pipeline: toxicity, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from barloom.llm.common import cut, new_path


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain, fitted on the labels of `sf_dir`, does not reject."""
    return toxicity.keep_clean(docs, toxicity.fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return exact_dedup.keep_first(docs, exact_dedup.DigestIndex(spark, new_path(spark, "index")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word similarity 0.8 or more join."""
    return jaccard_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix of sources takes them."""
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in packed sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", clean),
    ("exact_dedup", distinct_texts),
    ("ngram_jaccard_join", distinct_documents),
    ("mixing", mixture),
    ("packing", sequences),
]

#: Hashing, model fitting and the library's tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
