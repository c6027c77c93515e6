"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it
kept; its result is written as Parquet and read again as the next one's documents. All
stages but the last return the columns of ``documents``.

1. ``quality``: documents that the quality classifier rejects go.
2. ``language``: documents whose language is unknown or uncertain go.
3. ``near_duplicates``: one document of each near-duplicate group stays, the smallest id;
   texts link from a similarity of their five-word shingles of 0.8; SimHash with pigeonring and
   MinHash name candidates, each is confirmed.
4. ``secrets``: secrets, and weak parts of a credential that occur together, are masked.
5. ``packing``: the rest is tokenized and packed into sequences of at most 2048 ids.

The classifiers learn from labelled rows among the documents that they are given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from contest_analytics.llm import langid, packing, quality, secret_scan, similar
from contest_analytics.llm.queries import TOKENIZER
from contest_analytics.streaming.sinks import scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: Classifiers and connected components have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
