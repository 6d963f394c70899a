"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import base, dedup, packing, pii, similarity, toxicity


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score as toxic go.  Null and empty texts have the score of no word; equal rows go or stay together; an empty table stays empty."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the smallest doc_id stays (nulls last, then in order of reading); null and empty texts are equal."""
    return dedup.without_duplicates(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 or more the smallest doc_id stays; texts without a word all stay."""
    return similarity.one_of_each(docs)


def personal_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; found spans are replaced by their kind, null texts stay null."""
    return pii.masked(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are pieces of at most 2048 tokens with their place in a sequence; a null or empty text is one piece, its end id."""
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxic_out),
    ("exact_dedup", copies_out),
    ("jaccard_join", near_copies_out),
    ("pii", personal_data_masked),
    ("packing", sequences),
]

#: A fitted classifier and a genetic search can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's rows are written to the shared folder and read by the next.

    Null and empty texts pass all filters but exact dedup, which keeps one of them, and are one piece
    in the end; of equal rows one stays; ties go to the smallest doc_id, nulls last; an empty table
    gives no piece.  Other columns, whatever their names, go through the first four stages.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = base.written(docs, f"stage-{name}")
    return docs
