"""A training corpus from raw documents: each stage is written as Parquet and read again as the next one's input.

Stages take and return the columns of documents (the last one: pieces); other columns are left out. Any of them may be
null. Repeated rows are documents of their own until near duplicates are reduced; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ensspark.llm import op04_ngram_join, op06_secrets, op07_quality, op08_sentencepiece, op09_mixing
from ensspark.llm.common import landed, prepared, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null and empty texts have too few words and go. Copies are judged alike."""
    prepared(spark)
    return op07_quality.kept_documents(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; among rows that share it, one.

    Texts without words are in no group and stay, each row of them.
    """
    prepared(spark)
    return op04_ngram_join.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of every secret; n_chars follows the text. A null text stays null."""
    prepared(spark)
    rows = op06_secrets.redacted(docs.select(*COLUMNS))
    return rows.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it; texts without words add nothing to it either way."""
    prepared(spark)
    return op09_mixing.copied(docs.select(*COLUMNS)).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row's best segmentation, ready for training; copies are encoded alike, a null text has none."""
    prepared(spark)
    rows = op08_sentencepiece.encoded(docs.select(*COLUMNS))
    return rows.select("row.doc_id", "row.lang", "row.source", "n_tokens", "ids", "score", "round_trip")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources", mixing),
    ("SentencePiece encoding", encoding),
]
# The learnt models, the components and the pieces' lattice have no SQL; their operators are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs = table(prepared(spark), sf_dir, "documents", *COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = landed(docs, f"pipeline-{k}")
    return docs
