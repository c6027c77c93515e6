"""Streams that Spark's own windows, joins and de-duplication express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contest_analytics import config as C
from contest_analytics.functions.curves import sanitize_score
from contest_analytics.operators.allocation import epoch_phase


def timed(stream: DataFrame, micros: str = "micros", name: str = "ts") -> DataFrame:
    """Adds an event time: watermarks need a zoned timestamp."""
    return stream.withColumn(name, F.timestamp_micros(micros))


def stream_dedup(stream: DataFrame, unique: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each id once; the state of an id is dropped when the watermark passes it."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([unique])


def _in_time(assigned: DataFrame, responses: DataFrame, keys: list[str], deadline: str) -> DataFrame:
    """Every assignment with each of its responses inside the deadline, or with none."""
    a, r = assigned.alias("a"), responses.alias("r")
    match = (F.col("r.ts") >= F.col("a.ts")) & (
        F.col("r.ts") <= F.col("a.ts") + F.expr(f"interval {deadline}")
    )
    for k in keys:
        match = match & (F.col(f"a.{k}") == F.col(f"r.{k}"))
    return a.join(r, match, "left_outer").select(
        "a.*", F.col("r.ts").alias("answered"), F.coalesce(F.col("r.score"), F.lit(0.0)).alias("score")
    )


def stream_nonresponders(
    assigned: DataFrame,
    responses: DataFrame,
    keys: list[str],
    deadline: str = "1 hour",
    delay: str = "10 minutes",
) -> DataFrame:
    """Assignments with the scores of responses inside the deadline, else 0.

    Both sides carry ``ts``. An assignment without a response comes out once the
    watermark is past its deadline, one with several responses once for each: see
    :func:`first_answers`, and :func:`settle` for those still open when a run ends.
    """
    return _in_time(assigned.withWatermark("ts", delay), responses.withWatermark("ts", delay), keys, deadline)


def first_answers(matched: DataFrame, unique: str) -> DataFrame:
    """One row per assignment ``unique``: its first answer, of equal times the least score."""
    never = F.lit("9999-12-31").cast("timestamp")
    answer = F.struct(F.coalesce("answered", never).alias("at"), "score")
    rest = [c for c in matched.columns if c not in (unique, "answered", "score")]
    best = matched.groupBy(unique).agg(*[F.first(c).alias(c) for c in rest], F.min(answer).alias("_best"))
    return best.select(unique, *rest, F.col("_best.score").alias("score"))


def settle(
    matched: DataFrame,
    assigned: DataFrame,
    responses: DataFrame,
    keys: list[str],
    unique: str,
    deadline: str = "1 hour",
) -> DataFrame:
    """Exactly one row per assignment at the end of a bounded run.

    ``matched`` is what the stream gave; assignments that it still holds open are joined
    with the responses in one batch pass.
    """
    done = first_answers(matched, unique)
    open_ones = assigned.join(done.select(unique), unique, "left_anti")
    return done.unionByName(first_answers(_in_time(open_ones, responses, keys, deadline), unique))


def stream_epoch_agg(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Count and mean score per epoch, phase and round (columns ``ts``, ``sec``, ``raw``)."""
    phased = epoch_phase(stream.withWatermark("ts", delay), "sec").withColumn(
        "_s", sanitize_score("raw")
    )
    epoch = F.window("ts", f"{C.EPOCH_SECONDS} seconds")
    return (
        phased.groupBy(epoch, "phase", "round")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("_s").alias("mean_score"))
        .select(F.unix_seconds("window.start").alias("epoch_start"), "phase", "round", "n", "mean_score")
    )


def stream_error_rate(
    stream: DataFrame, key: str, is_error: str = "is_error", span="1 hour", slide="5 minutes", delay="1 hour"
) -> DataFrame:
    """Errors per key in sliding windows; the filter comes before the window copies rows."""
    errors = stream.withWatermark("ts", delay).filter(F.col(is_error))
    return (
        errors.groupBy(F.window("ts", span, slide), key)
        .agg(F.count(F.lit(1)).alias("errors"))
        .select(F.unix_seconds("window.start").alias("window_start"), key, "errors")
    )


def stream_votes(votes: DataFrame, threshold: float = C.VOTE_SHARE) -> DataFrame:
    """Update stream of ``(pair, winner, share_a)``: two sums of state per pair.

    ``weight`` is the annotator's reliability, 1.0 if the column is absent.
    """
    w = F.col("weight") if "weight" in votes.columns else F.lit(1.0)
    side = lambda c: F.sum(F.when(F.col("choice") == c, w).otherwise(0.0))
    sums = votes.groupBy("pair").agg(side("a").alias("_a"), side("b").alias("_b"))
    total = F.col("_a") + F.col("_b")
    share = F.when(total >= 1e-8, F.col("_a") / total)
    return sums.select(
        "pair",
        F.when(share > threshold, "a").when(1.0 - share > threshold, "b").alias("winner"),
        share.alias("share_a"),
    )
