"""Versioned tables that readers only see when complete (A6), and state files (A7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contest_analytics.sources.tables import validate_state

STATE_SCHEMA = (
    "version string, ema map<string,string>, rounds map<string,string>, hotkeys map<string,string>"
)


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, oldest first: those whose job left its success marker."""
    p, fs = _folder(spark, path)
    if not fs.exists(p):
        return []
    out = []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        marker = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("v") and name[1:].isdigit() and fs.exists(marker):
            out.append(int(name[1:]))
    return sorted(out)


def write_snapshot(df: DataFrame, path: str, version: int | None = None) -> int:
    """Write the next version beside the old ones; it becomes current once committed."""
    spark = df.sparkSession
    if version is None:
        version = max(versions(spark, path), default=-1) + 1
    df.write.mode("overwrite").parquet(f"{path}/v{version:012d}")
    return version


def read_snapshot(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version (older than ``before``), or None."""
    found = [v for v in versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/v{found[-1]:012d}") if found else None


def state_rows(files: DataFrame) -> DataFrame:
    """State documents ``(version, ema, rounds, hotkeys)`` to one untyped row per key."""
    return files.select(
        "version", "rounds", "hotkeys", F.explode("ema").alias("uid", "ema")
    ).select(
        "version",
        "uid",
        "ema",
        F.try_element_at("rounds", F.col("uid")).alias("rounds"),
        F.try_element_at("hotkeys", F.col("uid")).alias("hotkey"),
    )


def load_state(spark: SparkSession, path: str, backup: str | None = None) -> tuple[DataFrame, DataFrame] | None:
    """``(ok, rejected)`` of the state file, or of its backup when the file is missing
    or no JSON document; None when neither can be read."""
    for source in (path, backup or f"{path}.bak"):
        p, fs = _folder(spark, source)
        if not fs.exists(p):
            continue
        docs = spark.read.text(source, wholetext=True).select(
            F.from_json("value", STATE_SCHEMA).alias("s")
        )
        docs = docs.select("s.*").filter(F.col("version").isNotNull() & F.col("ema").isNotNull())
        if docs.isEmpty():
            continue
        return validate_state(state_rows(docs))
    return None
