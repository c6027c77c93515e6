"""Submission gates and per-submission scalars (B). Row-local: no shuffle anywhere."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contest_analytics import config as C
from contest_analytics.functions.curves import as_col, bell, clip, ramp


def decode_payload(payload) -> Column:
    """Base64 text to bytes; null or malformed text gives null."""
    return F.try_to_binary(as_col(payload), F.lit("base64"))


def payload_gate(df: DataFrame, payload="payload", seconds="seconds", samples="samples") -> DataFrame:
    """Adds ``reject_reason`` (null when admissible)."""
    broken = F.exists(
        F.col(samples), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    return df.withColumn(
        "reject_reason",
        F.when(F.col(payload).isNull(), "undecodable")
        .when(F.octet_length(payload) > C.MAX_PAYLOAD_BYTES, "too_large")
        .when(F.col(seconds) > C.MAX_SECONDS, "too_long")
        .when(broken, "not_finite"),
    )


def is_silent(rms) -> Column:
    return as_col(rms) < C.SILENCE_RMS


def silence_gate(df: DataFrame, rms="rms", score="score") -> DataFrame:
    return df.withColumn("gated_score", F.when(is_silent(rms), 0.0).otherwise(F.col(score)))


def timed_out(measured_seconds, reported_ms) -> Column:
    """Measured time decides; the reported time only where none was measured."""
    measured, reported = as_col(measured_seconds), as_col(reported_ms)
    return F.coalesce(
        measured > C.TIMEOUT_SECONDS, reported > C.TIMEOUT_SECONDS * 1000, F.lit(False)
    )


def timeout_gate(df: DataFrame, measured="measured_s", reported="reported_ms") -> DataFrame:
    return df.withColumn("timed_out", timed_out(measured, reported))


def duration_penalty(actual, requested) -> Column:
    actual, requested = as_col(actual), as_col(requested)
    off = F.try_divide(F.abs(actual - requested), requested)
    return F.when(requested <= 0, 1.0).otherwise(ramp(off, C.DURATION_OK, C.DURATION_ZERO))


def speed_score(seconds, duration) -> Column:
    """Generation time relative to the requested duration; 0.5 without a timing."""
    r = as_col(seconds) / F.greatest(as_col(duration), F.lit(1.0))
    return (
        F.when(r.isNull(), 0.5)
        .when(r <= 1.0, 1.0)
        .when(r >= 6.0, 0.0)
        .when(r <= 3.0, 1.0 - 0.7 * (r - 1.0) / 2.0)
        .otherwise(0.3 * (1.0 - (r - 3.0) / 3.0))
    )


def quality_gate(
    df: DataFrame, size="size", rms="rms", actual="actual", expected="expected", peak="peak"
) -> DataFrame:
    """Adds ``failed_check``: the first failing quick check, or null."""
    a, e = F.col(actual), F.col(expected)
    return df.withColumn(
        "failed_check",
        F.when(F.col(size) < 1024, "too_small")
        .when(F.col(rms) < 0.001, "silent")
        .when((a < e * 0.5) | (a > e * 1.5), "duration")
        .when(F.col(peak) > 0.99, "clipping"),
    )


def words(text) -> Column:
    """Lower-cased whitespace tokens."""
    return F.filter(F.split(F.lower(as_col(text)), r"\s+"), lambda w: w != "")


#: Cells of the table of a pair of word arrays up to which the JVM fills it in; and words of both,
#: which get a letter each from ``LETTER`` on, below the surrogates.
TABLE_CELLS, TABLE_WORDS, LETTER = 4_000_000, 50_000, 256


def lettered(words_of: Column, vocabulary: Column) -> Column:
    """A text with one letter for each word: its place in the vocabulary."""
    codes = F.transform(
        words_of, lambda w: F.lpad(F.hex(F.array_position(vocabulary, w) + LETTER), 4, "0")
    )
    return F.decode(F.unhex(F.array_join(codes, "")), "UTF-16BE")


@F.pandas_udf(T.LongType())
def long_edit_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """Edit distance of two word arrays of any length.

    A row of the table is a pair of whole numbers: the bits of ``up`` and ``down`` tell where a
    cell is one more or one less than the cell above it. One step for each word of ``right``
    works on all words of ``left`` at once.
    """

    def distance(a: np.ndarray, b: np.ndarray) -> int:
        n = len(a)
        if not n:
            return len(b)
        spots: dict[str, int] = {}
        for i, w in enumerate(a):
            spots[w] = spots.get(w, 0) | 1 << i
        every, last = (1 << n) - 1, 1 << (n - 1)
        up, down, total = every, 0, n
        for w in b:
            same = spots.get(w, 0)
            free = (((same & up) + up) ^ up) | same | down
            more, less = down | (every & ~(free | up)), up & free
            total += bool(more & last) - bool(less & last)
            more, less = (more << 1 | 1) & every, (less << 1) & every
            up, down = less | (every & ~(free | more)), more & free
        return total

    return pd.Series([distance(a, b) for a, b in zip(left, right)], dtype="int64")


def word_error_rate(df: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Adds ``wer``: the edit distance of the words over the number of reference words.

    Words become letters, so that the JVM's distance of texts is that of the words. Only pairs
    of very many words take another way, in Python. With no reference words the rate is 0 or 1;
    a null text gives null.
    """
    r, h = F.col("_ref_words"), F.col("_hyp_words")
    # With no reference words the distance is the number of heard words.
    rate = F.when(F.size(r) == 0, F.least(F.size(h), F.lit(1)).cast("double")).otherwise(
        F.col("_distance") / F.size(r)
    )
    split = df.withColumn("_ref_words", words(ref)).withColumn("_hyp_words", words(hyp))
    cells, both = F.size(r).cast("long") * F.size(h), F.size(r) + F.size(h)
    small = F.coalesce((cells <= TABLE_CELLS) & (both <= TABLE_WORDS), F.lit(True))
    known = split.filter(small).withColumn("_known", F.array_distinct(F.concat(r, h)))
    short = known.withColumn(
        "_distance", F.levenshtein(lettered(r, F.col("_known")), lettered(h, F.col("_known"))).cast("long")
    ).drop("_known")
    long = split.filter(~small).withColumn("_distance", long_edit_distance(r, h))
    return short.unionByName(long).withColumn("wer", rate).drop("_ref_words", "_hyp_words", "_distance")


def segment_confidence(logprobs, no_speech) -> Column:
    """Mean of exp(logprob) x (1 - no_speech) over a row's segments; none -> 0."""
    parts = F.zip_with(as_col(logprobs), as_col(no_speech), lambda p, s: F.exp(p) * (1.0 - s))
    return F.when(
        F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / F.size(parts)
    ).otherwise(0.0)


def text_intelligibility(
    df: DataFrame, text="text", seconds="seconds", confidence="confidence", wer="wer"
) -> DataFrame:
    """``wer`` is null where no text was expected."""
    n = F.regexp_count(F.col(text), F.lit(r"\S+"))
    pace = F.when(F.col(seconds) > 0, bell(n / F.col(seconds), 2.0, 2.0)).otherwise(0.0)
    base = 0.35 * clip(n / 40.0) + 0.40 * clip(F.col(confidence) / 0.6) + 0.25 * pace
    blended = F.when(F.col(wer).isNull(), base).otherwise(
        0.5 * clip(1.0 - F.col(wer)) + 0.5 * base
    )
    return df.withColumn(
        "intelligibility", F.when(F.trim(F.col(text)) == "", 0.3).otherwise(clip(blended))
    )


def clean_lines(df: DataFrame, col: str, max_lines: int, out: str = "lines") -> DataFrame:
    """Usable lines of a text, in order, as an array. A row's work stays in its row.

    Reading stops at the first plain line that finds ``max_lines`` lines kept;
    a ``[marker]`` line never stops it.
    """
    trimmed = F.transform(F.split(F.col(col), "\n"), lambda x: F.trim(x))
    sized = F.filter(trimmed, lambda x: (F.length(x) >= 2) & (F.length(x) <= 100))

    def marker(x: Column) -> Column:
        return x.startswith("[") & x.endswith("]")

    def boilerplate(x: Column) -> Column:
        found = F.lit(False)
        for phrase in C.BOILERPLATE:
            found = found | F.lower(x).contains(phrase)
        return found

    kept = F.filter(sized, lambda x: marker(x) | ~boilerplate(x))

    def step(acc: Column, x: Column) -> Column:
        bare = F.when(marker(x), x).otherwise(F.regexp_replace(x, r"^[0-9.)\-*]+\s*", ""))
        grown = F.when(bare == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(bare)))
        full = ~marker(x) & (F.size(grown) >= max_lines)
        return F.when(acc["done"], acc).otherwise(F.struct(grown.alias("out"), full.alias("done")))

    nothing = F.struct(
        F.array().cast("array<string>").alias("out"), F.lit(False).alias("done")
    )
    return df.withColumn(out, F.aggregate(kept, nothing, step, lambda acc: acc["out"]))


def conditional_gate(
    df: DataFrame,
    metrics: list[str],
    requested="requested",
    presence="presence",
    peak="peak",
    seconds="seconds",
    unusable_when_requested: float = 0.1,
) -> DataFrame:
    """Replaces sub-metrics that the request makes irrelevant.

    Silent or short input: 0.1 if requested, else 0.5. Not requested: 0 when the
    unwanted signal is present, else 0.5. Requested: the measured values.
    """
    unusable = (F.col(peak) < 1e-6) | (F.col(seconds) < 1.0)
    out = {
        m: F.when(
            unusable, F.when(F.col(requested), unusable_when_requested).otherwise(0.5)
        )
        .when(~F.col(requested), F.when(F.col(presence) > 0.4, 0.0).otherwise(0.5))
        .otherwise(F.col(m))
        for m in metrics
    }
    return df.withColumns(out)
