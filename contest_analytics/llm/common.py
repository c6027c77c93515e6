"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contest_analytics import scale


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that the cluster shares."""
    scale.shared_dir(df.sparkSession)
    return df.checkpoint()


def text_rows(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small slices, so that Python holds few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fold(doc_id: str = "doc_id", parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids count as remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(parts)), F.lit(0))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
