"""Statistics of long scalar series (I): rows ``(series key, order, x[, y])``.

Every function returns one row per series with its measures and a ``score``.
Neighbours come from :mod:`contest_analytics.scale`, so one very long series is
spread over tasks like any other data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contest_analytics.functions.curves import bell, clip, ramp
from contest_analytics.operators.autocorrelation import Span, lag_sums
from contest_analytics.operators.greedy import thinned
from contest_analytics.scale import (
    around,
    is_hot,
    lookup,
    ordered,
    owned,
    quantiles,
    with_index,
)


def rms(x) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.sqrt(F.avg(c * c))


def steps(df: DataFrame, key: str, order: Sequence[str], x: str, hot: bool | None = None) -> DataFrame:
    """Rows with ``_p``, the value before (null on the first row), and ``idx``."""
    tiled = ordered(df.select(key, *order, x), [key], order, before=1, hot=hot)
    return owned(tiled.withColumn("_p", F.lag(x).over(around([key]))))


def semitones(x, reference) -> Column:
    return 12.0 * F.log2(F.try_divide(x, reference) + 1e-10)


def level(df: DataFrame, key: str, x: str = "x", rate: float = 1.0) -> DataFrame:
    return df.groupBy(key).agg(
        rms(x).alias("rms"),
        F.max(F.abs(x)).alias("peak"),
        (F.count(x) / rate).alias("duration"),
    )


def clipping(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    x: str = "x",
    hard: float = 0.999,
    soft: float = 0.95,
    run: int = 100,
) -> DataFrame:
    """Samples above ``hard`` plus samples in runs longer than ``run`` above ``soft``."""
    hot = is_hot(df, [key])
    placed = with_index(df.select(key, *order, x), [key], order, hot=hot)
    totals = placed.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.abs(x) > hard).alias("hard")
    )
    # Within a run, position among all rows and among loud rows grow together.
    loud = with_index(placed.filter(F.abs(x) > soft).select(key, "idx"), [key], ["idx"], "_j", hot)
    runs = loud.groupBy(key, (F.col("idx") - F.col("_j")).alias("_g")).agg(
        F.count(F.lit(1)).alias("_len")
    )
    soft_counts = runs.groupBy(key).agg(F.sum(F.when(F.col("_len") > run, F.col("_len"))).alias("soft"))
    share = (F.col("hard") + F.col("soft")) / F.col("_n")
    return (
        lookup(totals, soft_counts, [key])
        .withColumn("soft", F.coalesce("soft", F.lit(0)))
        .withColumn("ratio", share)
        .withColumn("score", F.when(F.col("ratio") < 0.001, 1.0).otherwise(ramp("ratio", 0.001, 0.05)))
        .drop("_n")
    )


def dynamic_range(df: DataFrame, key: str, x: str = "x", target: float = 10.0) -> DataFrame:
    db = df.filter(F.col(x) > 1e-8).select(key, (20.0 * F.log10(F.col(x) + 1e-10)).alias("_db"))
    q = quantiles(db, [key], "_db", {"_hi": 0.95, "_lo": 0.05})
    n = df.groupBy(key).agg(F.count_if(F.col(x) > 1e-8).alias("_n"))
    lra = F.col("_hi") - F.col("_lo")
    fit = clip(1.0 - F.abs(lra - target) / (target + 5.0))
    return lookup(n, q, [key]).select(
        key,
        F.coalesce(lra, F.lit(0.0)).alias("range_db"),
        F.when((F.col("_n") < 2) | (lra < 1.0), 0.0).otherwise(fit).alias("score"),
    )


def event_density(df: DataFrame, key: str, t: str = "t", ceiling: float = 4.0) -> DataFrame:
    """Events per second of the series' span against ``ceiling``."""
    s = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("events"), (F.max(t) - F.min(t)).alias("duration")
    )
    fill = F.least(F.try_divide(F.col("events"), F.col("duration") * ceiling), F.lit(1.0))
    return s.withColumn(
        "score", F.when(F.col("duration") < 0.5, 0.0).otherwise(clip(0.3 + 0.7 * fill))
    )


def interval_regularity(
    df: DataFrame, key: str, t: str = "t", strength: str = "x", floor: float = 0.0, unique: str | None = None
) -> DataFrame:
    """Steadiness of the gaps between events, blended with their strength."""
    order = [t, unique] if unique else [t]
    tiled = ordered(df.select(key, *order, strength), [key], order, before=1)
    gaps = owned(tiled.withColumn("_g", F.col(t) - F.lag(t).over(around([key]))))
    s = gaps.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("_g").alias("_mean"),
        F.stddev_pop("_g").alias("_std"),
        (F.avg(strength) / (F.max(strength) + 1e-8)).alias("strength"),
    )
    cv = F.try_divide("_std", "_mean")
    regular = F.greatest(F.lit(0.0), 1.0 - cv / 0.3)
    whole = (0.5 * regular + 0.5 * F.col("strength")) * 0.85 + floor * 0.15
    return s.select(
        key,
        cv.alias("cv"),
        "strength",
        F.when(F.col("_n") < 2, 0.1 * floor)
        .when(F.col("_mean") < 1e-8, 0.0)
        .otherwise(clip(whole))
        .alias("score"),
    )


def _loudness(mean_square: Column) -> Column:
    return F.when(mean_square < 1e-20, -70.0).otherwise(-0.691 + 10.0 * F.log10(mean_square))


def hop_windows(
    df: DataFrame, key: str, order: Sequence[str], x: str, hop: int, hops: int
) -> tuple[DataFrame, DataFrame]:
    """``(windows, totals)``: mean square of every full window of ``hops`` hops.

    Samples are summed per hop first; a window then adds up a few sums instead of
    copying samples into every window they belong to.
    """
    placed = with_index(df.select(key, *order, x), [key], order)
    totals = placed.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(F.col(x) * F.col(x)).alias("_ms"),
        F.max(F.abs(x)).alias("_peak"),
    )
    parts = placed.groupBy(key, F.floor((F.col("idx") - 1) / hop).alias("_b")).agg(
        F.sum(F.col(x) * F.col(x)).alias("_q")
    )
    starts = F.explode(F.sequence(F.col("_b") - (hops - 1), F.col("_b"))).alias("start")
    sums = parts.select(key, starts, "_q").groupBy(key, "start").agg(F.sum("_q").alias("_q"))
    full = lookup(sums, totals, [key]).filter(
        (F.col("start") >= 0) & ((F.col("start") + hops) * hop <= F.col("_n"))
    )
    return full.select(key, "start", (F.col("_q") / (hop * hops)).alias("_ms")), totals


def sliding_loudness(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    x: str = "x",
    rate: int = 1,
    win: int = 3,
    hop: int = 1,
    target: float = -16.0,
    std_target: float = 5.0,
) -> DataFrame:
    """Integrated loudness and the spread of ``win``-second windows every ``hop`` seconds."""
    if win % hop:
        raise ValueError("win must be a multiple of hop")
    windows, totals = hop_windows(df, key, order, x, hop * rate, win // hop)
    loud = windows.withColumn("_l", _loudness(F.col("_ms"))).filter("_l > -69")
    spread = loud.groupBy(key).agg(
        F.stddev_pop("_l").alias("window_std"), F.count(F.lit(1)).alias("_w")
    )
    off = F.abs(F.col("integrated") - target)
    whole = F.when(off <= 4.0, 1.0).otherwise(clip(1.0 - (off - 4.0) / 8.0))
    steady = clip(1.0 - F.abs(F.col("window_std") - std_target) / 8.0)
    short = (F.col("_n") < win * rate) | (F.coalesce("_w", F.lit(0)) < 2)
    return (
        lookup(totals.withColumn("integrated", _loudness(F.col("_ms"))), spread, [key])
        .withColumn(
            "score",
            F.when((F.col("_n") < 0.5 * rate) | (F.col("_peak") < 1e-6), 0.0)
            .when(short, whole)
            .otherwise(0.5 * whole + 0.5 * steady),
        )
        .select(key, "integrated", "window_std", "score")
    )


def block_jitter(
    df: DataFrame, key: str, order: Sequence[str], x: str = "x", win: int = 2, hop: int = 1
) -> DataFrame:
    """Spread of level steps between consecutive active windows."""
    windows, totals = hop_windows(df, key, order, x, hop, win // hop)
    level_rms = F.sqrt("_ms")
    db = F.when(level_rms > 1e-10, 20.0 * F.log10(level_rms)).otherwise(-100.0)
    loud = windows.withColumn("_db", db)
    counts = loud.groupBy(key).agg(
        F.count(F.lit(1)).alias("_w"), F.count_if(F.col("_db") > -60).alias("_a")
    )
    moves = steps(loud.filter("_db > -60"), key, ["start"], "_db")
    jitter = moves.groupBy(key).agg(F.stddev_pop(F.col("_db") - F.col("_p")).alias("jitter"))
    joined = lookup(lookup(totals.select(key), counts, [key]), jitter, [key])
    few = (F.coalesce("_w", F.lit(0)) < 3) | (F.coalesce("_a", F.lit(0)) < 3)
    return joined.select(
        key, "jitter", F.when(few, 0.0).otherwise(clip(F.exp(-0.5 * F.col("jitter")))).alias("score")
    )


def step_expressiveness(
    df: DataFrame, key: str, order: Sequence[str], x: str = "x", target: float = 0.05
) -> DataFrame:
    s = steps(df, key, order, x).groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(x).alias("_mean"),
        F.max(x).alias("_max"),
        F.stddev_pop(F.col(x) - F.col("_p")).alias("_std"),
    )
    v = F.try_divide("_std", "_mean")
    none = (F.col("_n") < 4) | (F.col("_max") < 1e-8) | (F.col("_mean") < 1e-8)
    return s.select(
        key, v.alias("step_std"), F.when(none, 0.0).otherwise(clip(bell(v, target, 50.0))).alias("score")
    )


def pitched(df: DataFrame, key: str, order: Sequence[str], x: str) -> DataFrame:
    """Positive values with ``_s``, their semitones above the series' first value."""
    voiced = df.filter(F.col(x).isNotNull() & (F.col(x) > 0)).select(key, *order, x)
    first = voiced.groupBy(key).agg(F.min_by(x, F.struct(*order)).alias("_ref"))
    return lookup(voiced, first, [key]).withColumn("_s", semitones(F.col(x), F.col("_ref")))


def interval_mix(df: DataFrame, key: str, order: Sequence[str], x: str = "x") -> DataFrame:
    """Shares of steps, leaps and wide jumps between merged notes."""
    p = pitched(df, key, order, x)
    n = p.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    notes = thinned(p, key, order, "_s")
    moved = steps(notes, key, ["idx"], "note").withColumn("_d", F.abs(F.col("note") - F.col("_p")))
    d = F.col("_d")
    shares = moved.groupBy(key).agg(
        F.count("_d").alias("_k"),
        F.avg(((d >= 0.5) & (d <= 5.0)).cast("double")).alias("steps"),
        F.avg(((d > 5.0) & (d <= 12.0)).cast("double")).alias("leaps"),
        F.avg((d > 12.0).cast("double")).alias("jumps"),
        F.count_distinct(F.rint("note")).alias("_pitches"),
        F.count_distinct(F.rint("_d")).alias("_kinds"),
    )
    base = F.col("steps") + 0.5 * F.col("leaps") - 0.5 * F.col("jumps")
    bonus = F.least(F.lit(0.15), 0.015 * F.col("_kinds"))
    return lookup(n, shares, [key]).select(
        key,
        "steps",
        "leaps",
        "jumps",
        F.when(F.col("_n") < 2, 0.0)
        .when((F.col("_k") == 0) | (F.col("_pitches") <= 2), 0.15)
        .otherwise(clip(base + bonus))
        .alias("score"),
    )


def centred_lags(df: DataFrame, key: str, order: Sequence[str], x: str, span: Span) -> tuple[DataFrame, DataFrame]:
    """``(lags, facts)``: autocovariance sums of the lags of ``span``, and count, mean and sum of squares."""
    facts = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(x).alias("_mean"),
        (F.var_pop(x) * F.count(x)).alias("_zero"),
    )
    c = lookup(df, facts, [key]).select(key, *order, (F.col(x) - F.col("_mean")).alias("_c"))
    return lookup(lag_sums(c, key, order, "_c", span).drop("_n"), facts, [key]), facts


def contour(df: DataFrame, key: str, order: Sequence[str], x: str = "x") -> DataFrame:
    """Smoothness of steps and the strongest autocorrelation at lags n/10..n/2."""
    p = pitched(df, key, order, x)
    moves = steps(p, key, order, "_s").groupBy(key).agg(
        F.stddev_pop(F.abs(F.col("_s") - F.col("_p"))).alias("step_std")
    )
    lags, facts = centred_lags(p, key, order, "_s", lambda n: (max(1, n // 10), n // 2))
    share = F.when(F.col("_zero") > 0, F.col("_sum") / F.col("_zero")).otherwise(F.col("_sum"))
    peaks = lags.groupBy(key).agg(F.max(share).alias("peak"))
    joined = lookup(lookup(facts, moves, [key]), peaks, [key])
    smooth = bell("step_std", 1.0, 2.0)
    periodic = F.when(
        F.col("_n") > 10, clip(1.0 - F.abs(F.coalesce("peak", F.lit(0.0)) - 0.5) / 0.5)
    ).otherwise(0.0)
    return joined.select(
        key,
        "step_std",
        "peak",
        F.when(F.col("_n") < 4, 0.0).otherwise(clip(0.5 * smooth + 0.5 * periodic)).alias("score"),
    )


def half_decay(df: DataFrame, key: str, order: Sequence[str], x: str = "x") -> DataFrame:
    """First lag whose autocorrelation is under one half, relative to the length."""
    lags, facts = centred_lags(df, key, order, x, lambda n: (1, n))
    under = lags.filter(F.col("_sum") / (F.col("_zero") + 1e-10) < 0.5)
    first = under.groupBy(key).agg(F.min("lag").alias("_lag"))
    r = F.coalesce("_lag", "_n") / F.col("_n")
    score = (
        F.when(r < 0.05, r / 0.05)
        .when(r > 0.5, F.greatest(1.0 - (r - 0.5) / 0.5, F.lit(0.0)))
        .otherwise(0.6 + 0.4 * (r - 0.05) / 0.45)
    )
    none = (F.col("_n") < 10) | (F.col("_zero") < 1e-10)
    return lookup(facts, first, [key]).select(
        key, r.alias("ratio"), F.when(none, 0.0).otherwise(clip(score)).alias("score")
    )


def entropy_motif(df: DataFrame, key: str, order: Sequence[str], x: str = "x") -> DataFrame:
    """Entropy of quantised values and the share of the commonest interval."""
    p = pitched(df, key, order, x).withColumn(
        "_note", F.rint(12.0 * F.log2(F.col(x) / 440.0 + 1e-10) + 69.0)
    )
    per_note = p.groupBy(key, "_note").agg(F.count(F.lit(1)).alias("_c"))
    totals = per_note.groupBy(key).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_u"))
    share = F.col("_c") / F.col("_n")
    entropy = lookup(per_note, totals, [key]).groupBy(key).agg(
        (-F.sum(share * F.log2(share + 1e-10))).alias("_e")
    )
    moved = steps(p, key, order, "_s").filter(F.col("_p").isNotNull())
    kinds = moved.groupBy(key, F.rint(F.abs(F.col("_s") - F.col("_p"))).alias("_i")).agg(
        F.count(F.lit(1)).alias("_k")
    )
    motif = kinds.groupBy(key).agg(
        F.max(F.struct("_k", (-F.col("_i")).alias("_neg"))).alias("_top"), F.sum("_k").alias("_m")
    )
    joined = lookup(lookup(totals, entropy, [key]), motif, [key])
    norm = F.col("_e") / F.when(F.col("_u") > 1, F.log2(F.col("_u").cast("double"))).otherwise(1.0)
    dominance = F.try_divide("_top._k", "_m")
    consistent = F.when(F.col("_top._neg") == 0, 0.2).otherwise(bell(dominance, 0.35, 8.0))
    return joined.select(
        key,
        norm.alias("entropy"),
        dominance.alias("dominance"),
        F.when(F.col("_n") < 5, 0.0)
        .otherwise(clip(0.5 * bell(norm, 0.7, 8.0) + 0.5 * consistent))
        .alias("score"),
    )


def arc_fit(df: DataFrame, key: str, order: Sequence[str], x: str = "x", peak: float = 0.6) -> DataFrame:
    """How well the level follows a rise to ``peak`` of the length and a fall; max 0.05."""
    placed = with_index(df.select(key, *order, x), [key], order)
    facts = placed.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.min(x).alias("_lo"), F.max(x).alias("_hi")
    )
    j = lookup(placed, facts, [key])
    at = F.floor(F.col("_n") * peak)
    at = F.when((at < 1) | (at >= F.col("_n") - 1), F.floor(F.col("_n") / 2)).otherwise(at)
    i = F.col("idx") - 1
    tail = F.greatest(F.col("_n") - at - 1, F.lit(1))
    ideal = F.when(i < at, 0.2 + F.try_divide(0.8 * i, at)).otherwise(1.0 - 0.7 * (i - at) / tail)
    level_norm = F.try_divide(F.col(x) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    s = (
        j.filter((F.col("_n") >= 3) & (F.col("_hi") - F.col("_lo") >= 1e-8))
        .select(key, level_norm.alias("_a"), ideal.alias("_b"))
        .groupBy(key)
        .agg(F.corr("_a", "_b").alias("fit"), F.stddev_pop("_a").alias("_v"))
    )
    arc = F.greatest(F.lit(0.0), F.col("fit")) * 0.7 + clip(F.col("_v") / 0.25) * 0.3
    bonus = F.round(clip(arc) * 0.05, 4)
    return lookup(facts.select(key), s, [key]).select(
        key, "fit", F.coalesce(bonus, F.lit(0.0)).alias("bonus")
    )


def two_channel(
    df: DataFrame, key: str, left: str = "x", right: str = "y", target: float = 4.0
) -> DataFrame:
    """Width, phase and mid/side balance of two channels in one pass."""
    mid = (F.col(left) + F.col(right)) / 2
    side = (F.col(left) - F.col(right)) / 2
    s = df.groupBy(key).agg(
        F.covar_pop(left, right).alias("_c"),
        F.stddev_pop(left).alias("_l"),
        F.stddev_pop(right).alias("_r"),
        F.sum(mid * mid).alias("_m"),
        (F.sum(side * side) + 1e-10).alias("_s"),
    )
    c = F.try_divide(F.col("_c"), F.col("_l") * F.col("_r"))
    width = (
        F.when((F.col("_l") < 1e-8) | (F.col("_r") < 1e-8), 0.0)
        .when(c > 0.95, 0.2)
        .when((c >= 0.3) & (c <= 0.8), 1.0)
        .when(c < 0.1, 0.5)
        .when(c > 0.8, 1.0 - (c - 0.8) / 0.15 * 0.8)
        .otherwise(0.5 + (c - 0.1) / 0.2 * 0.5)
    )
    r = F.col("_m") / F.col("_s")
    phase = (
        F.when(F.col("_m") < 1e-10, 0.0)
        .when(r >= 3.0, 1.0)
        .when(r >= 1.0, 0.5 + 0.5 * (r - 1.0) / 2.0)
        .otherwise(clip(r * 0.5, 0.0, 0.5))
    )
    return s.select(
        key,
        width.alias("width"),
        phase.alias("phase"),
        clip(bell(r, target, 0.3)).alias("balance"),
    )


def quartile_contrast(df: DataFrame, key: str, x: str = "x", unique: str = "idx") -> DataFrame:
    """Power of the top quarter of values over the bottom quarter, in dB / 40."""
    placed = with_index(df.select(key, x, unique), [key], [x, unique], "_r")
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    j = lookup(placed, n, [key])
    sq = F.col(x) * F.col(x)
    s = j.groupBy(key).agg(
        F.avg(F.when(F.col("_r") > F.col("_n") - F.ceil(F.col("_n") / 4), sq)).alias("_top"),
        F.avg(F.when(F.col("_r") <= F.floor(F.col("_n") / 4), sq)).alias("_low"),
        F.first("_n").alias("_n"),
    )
    db = 10.0 * F.log10(F.col("_top") / (F.col("_low") + 1e-10))
    return s.select(
        key, db.alias("contrast_db"), F.when(F.col("_n") < 4, 0.0).otherwise(clip(db / 40.0)).alias("score")
    )


def cv_consistency(df: DataFrame, key: str, x: str = "x") -> DataFrame:
    s = df.groupBy(key).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    cv = F.try_divide("_s", "_m")
    return s.select(
        key, cv.alias("cv"), F.when(F.col("_m") < 1e-8, 0.0).otherwise(clip(1.0 - cv / 0.5)).alias("score")
    )


def small_move_share(
    df: DataFrame, key: str, order: Sequence[str], x: str = "x", tolerance: float = 1.0
) -> DataFrame:
    """Share of present values times share of moves within 7 semitones x ``tolerance``."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col(x) > 0).alias("_n"))
    p = pitched(df, key, order, x)
    d = F.abs(F.col("_s") - F.col("_p"))
    s = steps(p, key, order, "_s").groupBy(key).agg(
        F.avg((d <= 7.0 * tolerance).cast("double")).alias("small"),
        F.avg((d < 0.5).cast("double")).alias("_still"),
    )
    present = F.col("_n") / F.col("_all")
    score = present * F.col("small") * F.when(F.col("_still") > 0.9, 0.5).otherwise(1.0)
    return lookup(n, s, [key]).select(
        key,
        present.alias("present"),
        "small",
        F.when(F.col("_n") < 3, 0.0).otherwise(clip(score)).alias("score"),
    )


def active_expressiveness(df: DataFrame, key: str, order: Sequence[str], x: str = "x") -> DataFrame:
    """Variation of the frames above 5% of the loudest one."""
    tops = df.groupBy(key).agg(F.max(x).alias("_max"), F.count(F.lit(1)).alias("_n"))
    active = lookup(df.select(key, *order, x), tops, [key]).filter(F.col(x) > F.col("_max") * 0.05)
    s = steps(active, key, order, x).groupBy(key).agg(
        F.count(F.lit(1)).alias("_a"),
        F.avg(x).alias("_m"),
        F.stddev_pop(x).alias("_sd"),
        F.stddev_pop(F.col(x) - F.col("_p")).alias("_dd"),
    )
    cv, dv = F.try_divide("_sd", "_m"), F.try_divide("_dd", "_m")
    cv_score = (
        F.when(cv < 0.05, cv / 0.05 * 0.3)
        .when(cv <= 0.60, 0.5 + 0.5 * (cv - 0.05) / 0.55)
        .otherwise(clip(1.0 - (cv - 0.60) / 0.60, 0.3, 1.0))
    )
    dv_score = (
        F.when(dv < 0.01, 0.2)
        .when(dv <= 0.15, 0.4 + 0.6 * (dv - 0.01) / 0.14)
        .otherwise(clip(1.0 - (dv - 0.15) / 0.20, 0.3, 1.0))
    )
    few = (F.coalesce("_a", F.lit(0)) < 4) | (F.col("_m") < 1e-10)
    return lookup(tops, s, [key]).select(
        key,
        cv.alias("cv"),
        F.when(F.col("_n") < 4, 0.5)
        .when(few, 0.3)
        .otherwise(clip(0.6 * cv_score + 0.4 * dv_score))
        .alias("score"),
    )


def step_jitter(df: DataFrame, key: str, order: Sequence[str], x: str = "x") -> DataFrame:
    """Spread of semitone steps, and a piecewise score of the median step in cents."""
    voiced = df.filter(F.col(x) > 0)
    hot = is_hot(voiced, [key])
    moved = steps(voiced, key, order, x, hot)
    semis = F.abs(12.0 * F.log2(F.col(x) / (F.col("_p") + 1e-10) + 1e-10))
    cents = 1200.0 * F.abs(F.log2(F.col(x) + 1e-10) - F.log2(F.col("_p") + 1e-10))
    both = moved.select(key, semis.alias("_s"), cents.alias("_cents"))
    s = both.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.stddev_pop("_s").alias("step_std"))
    med = quantiles(both, [key], "_cents", {"median_cents": 0.5}, hot)
    m = F.col("median_cents")
    stability = (
        F.when(F.col("_n") < 10, 0.4)
        .when(m < 2.0, 0.3 + 0.2 * (m / 2.0))
        .when(m <= 30.0, 0.7 + 0.3 * (1.0 - F.abs(m - 15.0) / 15.0))
        .otherwise(clip(1.0 - (m - 30.0) / 100.0, 0.0, 0.5))
    )
    return lookup(s, med, [key]).select(
        key,
        "step_std",
        "median_cents",
        F.when(F.col("_n") < 2, 0.5).otherwise(clip(bell("step_std", 1.5, 2.0))).alias("score"),
        stability.alias("stability"),
    )
