"""Composite scoring (C). Weights are literals or struct columns, so everything is
row-local except the long forms, which aggregate on the submission key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contest_analytics import config as C
from contest_analytics.functions.curves import as_col, clip


def add_up(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def composite(df: DataFrame, weights: Mapping[str, float], out: str = "composite") -> DataFrame:
    return df.withColumn(
        out, add_up([F.coalesce(F.col(s), F.lit(0.0)) * F.lit(w) for s, w in weights.items()])
    )


def preference_weight(accuracy, bootstrap) -> Column:
    low, high = C.ACCURACY_MIN, C.ACCURACY_MAX
    t = (clip(accuracy, low, high) - low) / (high - low + 1e-8)
    trained = C.PREFERENCE_MIN + t * t * (C.PREFERENCE_MAX - C.PREFERENCE_MIN)
    return (
        F.when(as_col(bootstrap), 0.0)
        .when(as_col(accuracy).isNull(), C.PREFERENCE_MIN)
        .otherwise(trained)
    )


def duration_multiplier(duration, signal: str) -> Column:
    """Weight factor of one signal for a submission's duration band."""
    short = C.SHORT_MULTIPLIERS.get(signal, 1.0)
    long = C.LONG_MULTIPLIERS.get(signal, 1.0)
    if short == long:
        return F.lit(min(2.0, max(0.5, short)))
    # Evaluates to `short` below the band and to `long` above it.
    d = F.greatest(F.least(as_col(duration), F.lit(C.LONG_SECONDS)), F.lit(C.SHORT_SECONDS))
    slope = (long - short) / (C.LONG_SECONDS - C.SHORT_SECONDS)
    value = F.lit(short) + (d - C.SHORT_SECONDS) * F.lit(slope)
    # Between two factors inside the range there is nothing to clip.
    return value if 0.5 <= min(short, long) and max(short, long) <= 2.0 else clip(value, 0.5, 2.0)


def duration_multipliers(df: DataFrame, duration: str = "duration") -> DataFrame:
    return df.withColumn(
        "multipliers", F.struct(*[duration_multiplier(duration, s).alias(s) for s in C.SIGNALS])
    )


def raw_weights(
    requested="requested", duration="duration", accuracy="accuracy", bootstrap="bootstrap"
) -> dict[str, Column]:
    """Per-row weights before normalisation: preference scaling, request boost,
    duration factors."""
    raw = {}
    for s, w in C.SIGNAL_WEIGHTS.items():
        base = preference_weight(accuracy, bootstrap) if s == "preference" else F.lit(w)
        if s in C.REQUESTED_BOOST:
            base = base * F.when(as_col(requested), C.REQUESTED_BOOST[s]).otherwise(1.0)
        raw[s] = base * duration_multiplier(duration, s)
    return raw


def adjusted_composite(**columns) -> Column:
    """Weighted mean of a row's signals under :func:`raw_weights`.

    Dividing once by the sum of weights keeps the expression small enough for
    generated code; normalising sixteen weights first does not.
    """
    raw = raw_weights(**columns)
    score = add_up([F.coalesce(F.col(s), F.lit(0.0)) * w for s, w in raw.items()])
    return F.try_divide(score, add_up(list(raw.values())))


def boost_and_renormalize(
    weights: DataFrame,
    rules: Mapping[str, float],
    keys: Sequence[str] = ("submission",),
    flag: str = "requested",
) -> DataFrame:
    """Long weights ``(keys, signal, weight, requested)``.

    A submission has one row per signal, so a window over it is small by design and
    needs one shuffle where an aggregate and a join need two.
    """
    factor = F.lit(1.0)
    for signal, by in rules.items():
        factor = F.when(F.col(flag) & (F.col("signal") == signal), by).otherwise(factor)
    boosted = weights.withColumn("weight", F.col("weight") * factor)
    total = F.sum("weight").over(W.partitionBy(*keys))
    return boosted.withColumn("weight", F.try_divide(F.col("weight"), total))


def final_reward(
    df: DataFrame, bonuses: Sequence[str] = ("phrase_bonus", "arc_bonus"), gated: str | None = None
) -> DataFrame:
    """Adds ``final_reward``; a missing part or a gated row scores 0."""
    whole = add_up([F.col("composite"), *[F.coalesce(F.col(b), F.lit(0.0)) for b in bonuses]])
    for p in C.PENALTIES:
        whole = whole * F.col(p)
    score = F.coalesce(clip(whole), F.lit(0.0))
    # least/greatest skip nulls, so a missing part must be tested on its own.
    score = F.when(whole.isNull(), 0.0).otherwise(score)
    if gated:
        score = F.when(F.coalesce(F.col(gated), F.lit(False)), 0.0).otherwise(score)
    return df.withColumn("final_reward", score)


def light_composite(df: DataFrame) -> DataFrame:
    """Five signals and two penalties; unused columns are never read."""
    whole = add_up([F.col(s) * w for s, w in C.LIGHT_WEIGHTS.items()])
    whole = whole * F.col("duration_penalty") * F.col("artifact_penalty")
    return df.withColumn("light_reward", F.when(whole.isNull(), 0.0).otherwise(clip(whole)))


def present_weighted_mean(
    weights: Mapping[str, float], otherwise: float = 0.5
) -> Column:
    """Weighted mean over the non-null components of a row."""
    num = add_up([F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()])
    den = add_up([F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()])
    return F.when(den > 0, clip(num / den)).otherwise(otherwise)


def breakdown_long(
    df: DataFrame, keys: Sequence[str], weights: Mapping[str, float] = C.SIGNAL_WEIGHTS
) -> DataFrame:
    long = df.unpivot(list(keys), list(weights), "signal", "score")
    table = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])
    return long.withColumn("weight", table[F.col("signal")]).withColumn(
        "contribution", F.col("score") * F.col("weight")
    )


def breakdown_wide(long: DataFrame, keys: Sequence[str], signals: Sequence[str]) -> DataFrame:
    """Back to one column per signal; the known signal list avoids a discovery pass.

    A plain aggregate: the rows of a submission, which lie together, are one before the shuffle,
    where a pivot shuffles each of them by key and signal and then again by key. Where a signal
    comes twice, its first score that is not null counts.
    """
    score = lambda s: F.first(F.when(F.col("signal") == s, F.col("score")), ignorenulls=True)
    return long.groupBy(*keys).agg(*[score(s).alias(s) for s in signals])


def geo_mean_penalty(cols: Sequence[str], floor: float = 0.1) -> Column:
    logs = add_up([F.ln(F.greatest(F.col(c), F.lit(floor))) for c in cols])
    return F.exp(logs / len(cols))


def round_summary(scores: DataFrame, key: str = "challenge", score: str = "score") -> DataFrame:
    s = F.coalesce(F.col(score), F.lit(0.0))
    return scores.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean_score"), F.max(s).alias("max_score")
    )


def aggregate_submetrics(
    long: DataFrame,
    keys: Sequence[str],
    weights: Mapping[str, Mapping[str, float]] = C.SUBMETRIC_WEIGHTS,
    neutral: frozenset[str] | set[str] = C.NEUTRAL_FAMILIES,
) -> DataFrame:
    """``(keys, family, metric, value)`` to one clipped score per key and family.

    A neutral family starts from 0.5 for every metric; what arrives replaces it.
    """
    table = F.create_map(
        *[
            F.lit(v)
            for fam, ms in weights.items()
            for m, w in ms.items()
            for v in (f"{fam}/{m}", float(w))
        ]
    )
    neutral_list = sorted(neutral) or [""]
    w = table[F.concat_ws("/", "family", "metric")]
    value = F.coalesce(F.col("value"), F.lit(0.0))
    start = F.when(F.col("family").isin(*neutral_list), 0.5).otherwise(0.0)
    known = long.withColumn("_w", w).filter(F.col("_w").isNotNull())
    sums = known.groupBy(*keys, "family").agg(
        F.sum(F.col("_w") * value).alias("_got"), F.sum("_w").alias("_seen")
    )
    return sums.select(
        *keys, "family", clip(F.col("_got") + start * (1.0 - F.col("_seen"))).alias("score")
    )
