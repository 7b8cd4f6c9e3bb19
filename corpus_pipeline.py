"""The corpus pipeline: documents in, token ids of the cleaned and mixed corpus out.

For every stage: rows with a null id, rows that repeat and columns of any further
names are rows and columns like others and stay as they are; null texts count as
empty where a text is read and stay null; texts of any length are read whole; an
empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweir.llm import exact_dedup, jaccard_join, mixing, tokens, toxicity
from docweir.session import materialise

#: Documents with this probability of being toxic or more go.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from the labels of these documents.

    Empty texts are scored by the bias alone; equal texts stay or go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = toxicity.fit(docs, labels, toxicity.confirmed_rows())
    return toxicity.score(docs, weights, column="__toxic").where(F.col("__toxic") < TOXIC).drop("__toxic")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays, exactly one row; empty and null texts are equal, null ids the smallest."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that reach each other over near copies the one with the smallest id stays.

    Rows of one id stay or go together, rows with a null id go if an id is in reach;
    texts without words are linked with nothing and stay.
    """
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a null source is a source like others."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-pair ids of every text, and what they decode to; empty texts have no ids."""
    return tokens.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded="decoded")


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies),
          ("mixing", mix_sources), ("byte-pair encoding", encode)]

#: A trained classifier and byte-pair ids have no SQL form; tests/llm compares the result with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn; each result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
