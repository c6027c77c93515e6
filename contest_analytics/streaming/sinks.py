"""Running a stream to tables, and publishing snapshots from one."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contest_analytics.operators.leaderboard import snapshot
from contest_analytics.scale import shared_dir
from contest_analytics.sources.snapshots import read_snapshot, versions, write_snapshot


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def feed(df: DataFrame, time_col: str, slices: int, files: int = 8) -> DataFrame:
    """``df`` as a stream of ``slices`` micro-batches of equal spans of time, oldest first.

    For replays of a table: each slice is written to the shared folder after the one before, in
    ``files`` files, which is what one trigger reads.
    """
    spark = df.sparkSession
    path = scratch(spark, "feed")
    low, high = df.agg(F.min(time_col), F.max(time_col)).first()
    step = ((high or 0) - (low or 0)) // slices + 1
    for n in range(slices):
        start = (low or 0) + n * step
        part = df.filter((F.col(time_col) >= start) & (F.col(time_col) < start + step))
        part.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def drain(stream: DataFrame, mode: str = "update", keys: list[str] | None = None) -> DataFrame:
    """Process everything available into a table; with ``keys``, its last row per key.

    Batches are written by number, so a repeated batch overwrites itself.
    """
    spark = stream.sparkSession
    out, ckpt = scratch(spark, "drain"), scratch(spark, "stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{out}/batch={batch_id}"
        )

    q = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", ckpt)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    q.awaitTermination()
    rows = spark.read.parquet(out).drop("batch")
    if keys is None:
        return rows.drop("_batch")
    rest = [c for c in rows.columns if c not in [*keys, "_batch"]]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_l"))
    return last.select(*keys, "_l.*")


def publish_snapshots(
    board_stream: DataFrame,
    path: str,
    checkpoint: str,
    key: str = "contributor",
    gap: int = 0,
    clock: Callable[[int], int] | None = None,
    **kw,
) -> StreamingQuery:
    """Merge micro-batches of board updates into the published snapshot.

    ``board_stream`` is the update stream of ``stream_leaderboard``. The new board
    is the previous one without the updated keys, plus the updates; readers see it
    only when complete. A version is published ``gap`` or more after the one before it on
    the ``clock`` (batch number -> time; seconds by default); until then updates wait in a
    table beside the snapshots. A replayed batch leaves a complete version as it is.
    """
    spark = board_stream.sparkSession
    waiting = f"{path}/waiting"
    now = clock or (lambda _: int(time.time()))

    def publish(batch: DataFrame, batch_id: int) -> None:
        # Written in any case: a batch that is not read leaves its state uncommitted.
        write_snapshot(batch.select(key, "ema", "rounds"), waiting, version=batch_id)
        if batch_id in versions(spark, path):
            return
        at = now(batch_id)
        last = max((v for v in versions(spark, path) if v < batch_id), default=-1)
        old = read_snapshot(spark, path, before=batch_id)
        if old is not None and gap > 0:
            before = old.agg(F.max("published_at")).first()[0]
            if before is not None and at - before < gap:
                return
        news = [v for v in versions(spark, waiting) if last < v <= batch_id]
        parts = [read_snapshot(spark, waiting, before=v + 1).withColumn("_v", F.lit(v)) for v in news]
        every = reduce(DataFrame.unionByName, parts)
        newest = every.groupBy(key).agg(F.max_by(F.struct("ema", "rounds"), "_v").alias("_l"))
        fresh = newest.select(key, "_l.*")
        if old is not None:
            kept = old.select(key, F.col("exact").alias("ema"), "rounds")
            fresh = fresh.unionByName(kept.join(fresh.select(key), key, "left_anti"))
        one = fresh.withColumn("contest", F.lit("all"))
        snap = snapshot(one, ["contest"], key, **kw).drop("contest")
        exact = fresh.select(key, F.col("ema").alias("exact"))
        dated = snap.join(exact, key).withColumn("published_at", F.lit(at).cast("long"))
        write_snapshot(dated, path, version=batch_id)

    return (
        board_stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(publish)
        .start()
    )
