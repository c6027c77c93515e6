"""Statistics of vector sequences (I): rows ``(series key, order, vec)``.

A vector is one frame's bins; ``bands`` are half-open bin ranges. Work inside a
frame stays in its row, sums over frames combine map-side, and neighbouring frames
come from :mod:`contest_analytics.scale`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contest_analytics import config as C
from contest_analytics.functions.curves import as_col, bell, clip, ramp
from contest_analytics.functions.vectors import distance, dot, norm, scaled, total
from contest_analytics.operators.boundaries import section_boundaries
from contest_analytics.operators.embeddings import mean_pairwise_cosine, mean_vector, sum_vector
from contest_analytics.operators.lookups import fifths_distance
from contest_analytics.scale import (
    around,
    block_cells,
    is_hot,
    lookup,
    ordered,
    owned,
    quantiles,
    running_sum,
    with_index,
)

Bands = Sequence[tuple[int, int]]


def squares(vec) -> Column:
    return F.transform(as_col(vec), lambda v: v * v)


def mean_of(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def std_of(a: Column, mean: Column) -> Column:
    """Population standard deviation of an array with a known mean."""
    return F.sqrt(mean_of(F.transform(a, lambda v: (v - mean) * (v - mean))))


def unit(vec, epsilon: float = 1e-8) -> Column:
    return scaled(vec, 1.0 / (norm(vec) + epsilon))


def band(vec, lo: int, hi: int) -> Column:
    return F.slice(as_col(vec), lo + 1, hi - lo)


def flux(df: DataFrame, key: str, order: Sequence[str], vec: str = "vec", hot=None) -> DataFrame:
    """``(key, idx, flux)``: distance of each frame to the one before; none for the first."""
    tiled = ordered(df.select(key, *order, vec), [key], order, before=1, hot=hot)
    moved = owned(tiled.withColumn("flux", distance(vec, F.lag(vec).over(around([key])))))
    return moved.select(key, "idx", "flux")


def discontinuity(
    df: DataFrame, key: str, order: Sequence[str], vec: str = "vec", k: float = 3.0
) -> DataFrame:
    """Share of steps above median + k x 1.4826 x MAD."""
    hot = is_hot(df, [key])
    f = flux(df, key, order, vec, hot).filter(F.col("flux").isNotNull())
    med = quantiles(f, [key], "flux", {"_med": 0.5}, hot)
    off = lookup(f, med, [key]).withColumn("_off", F.abs(F.col("flux") - F.col("_med")))
    mad = quantiles(off.select(key, "_off"), [key], "_off", {"_mad": 0.5}, hot)
    limit = F.col("_med") + k * 1.4826 * F.col("_mad")
    s = lookup(off, mad, [key]).groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg((F.col("flux") > limit).cast("double")).alias("ratio"),
        F.first("_mad").alias("_mad"),
    )
    none = (F.col("_n") < 3) | (F.col("_mad") < 1e-10)
    joined = lookup(df.select(key).distinct(), s, [key])
    return joined.select(
        key,
        "ratio",
        F.when(F.col("_n").isNull() | none, 1.0).otherwise(ramp("ratio", 0.10, 0.40)).alias("score"),
    )


def flux_consistency(df: DataFrame, key: str, order: Sequence[str], vec: str = "vec") -> DataFrame:
    s = flux(df, key, order, vec).groupBy(key).agg(
        F.count("flux").alias("_n"), F.avg("flux").alias("_m"), F.stddev_pop("flux").alias("_s")
    )
    cv = F.try_divide("_s", "_m")
    score = (
        F.when(cv < 0.05, 0.1)
        .when(cv < 0.2, 0.1 + 0.7 * ((cv - 0.05) / 0.15))
        .when(cv <= 2.0, 0.8 + 0.2 * F.least((cv - 0.2) / 0.3, F.lit(1.0)))
        .otherwise(F.greatest(F.lit(0.5), 1.0 - (cv - 2.0) / 4.0))
    )
    none = (F.col("_n") < 3) | (F.col("_m") < 1e-10)
    return s.select(key, cv.alias("cv"), F.when(none, 0.0).otherwise(clip(score)).alias("score"))


def similar_pairs(
    placed: DataFrame, key: str, vec: str, threshold: float, min_gap: int
) -> DataFrame:
    """Block results ``(key, similar, members)``: pairs at least ``min_gap`` apart whose
    dot product exceeds ``threshold``, counted, and the positions taking part."""
    cells = block_cells(placed, [key], "idx", [vec], block=256)
    kind = placed.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for i in range(len(pdf)):
                row = pdf.iloc[i]
                a, b = np.stack(row[f"left_{vec}"]), np.stack(row[f"right_{vec}"])
                ia = row["left_start"] + np.arange(len(a))
                ib = row["right_start"] + np.arange(len(b))
                hit = (a @ b.T > threshold) & (ib[None, :] - ia[:, None] >= min_gap)
                members = np.union1d(ia[hit.any(1)], ib[hit.any(0)])
                rows.append((row[key], int(hit.sum()), members.tolist()))
            yield pd.DataFrame(rows, columns=[key, "similar", "members"])

    return cells.drop("left_block", "right_block").mapInPandas(
        run, f"{key} {kind}, similar long, members array<bigint>"
    )


def chunk_repetition(
    df: DataFrame, key: str, order: Sequence[str], x: str = "x", chunk: int = 8, threshold: float = 0.98
) -> DataFrame:
    """Share of ``chunk``-sample pieces that recur two or more pieces away."""
    placed = with_index(df.select(key, *order, x), [key], order)
    n = placed.groupBy(key).agg(F.floor(F.count(F.lit(1)) / chunk).alias("chunks"))
    pieces = (
        placed.withColumn("_c", F.floor((F.col("idx") - 1) / chunk))
        .groupBy(key, "_c")
        .agg(F.array_sort(F.collect_list(F.struct("idx", x))).alias("_rows"))
        .filter(F.size("_rows") == chunk)
        .withColumn("_v", F.transform("_rows", lambda r: r[x]))
    )
    v = F.when(norm("_v") < 1e-8, F.col("_v")).otherwise(scaled("_v", F.try_divide(F.lit(1.0), norm("_v"))))
    vectors = pieces.select(key, (F.col("_c") + 1).alias("idx"), v.alias("_v"))
    found = similar_pairs(vectors, key, "_v", threshold, 2)
    repeated = (
        found.select(key, F.explode("members").alias("_m"))
        .distinct()
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_k"))
    )
    share = F.try_divide(F.coalesce(F.col("_k"), F.lit(0)), F.col("chunks"))
    return lookup(n, repeated, [key]).select(
        key,
        F.when(F.col("chunks") < 3, 0.0).otherwise(share).alias("ratio"),
        F.when(F.col("chunks") < 3, 1.0).otherwise(clip(1.0 - share / 0.5)).alias("score"),
    )


def window_means(
    df: DataFrame, key: str, order: Sequence[str], vec: str, size: int, partial: bool
) -> DataFrame:
    """``(key, idx, mean)`` per window of ``size`` frames; the short last one if ``partial``."""
    placed = with_index(df.select(key, *order, vec), [key], order)
    w = placed.groupBy(key, (F.floor((F.col("idx") - 1) / size) + 1).alias("idx")).agg(
        mean_vector(vec).alias("mean"), F.count(F.lit(1)).alias("_k")
    )
    return (w if partial else w.filter(F.col("_k") == size)).drop("_k")


def self_similarity_share(
    df: DataFrame, key: str, order: Sequence[str], vec: str = "vec", win: int = 4, threshold: float = 0.85
) -> DataFrame:
    """Share of window pairs that are alike, scored by bands."""
    w = window_means(df, key, order, vec, win, False)
    frames = df.groupBy(key).agg(F.count(F.lit(1)).alias("_f"))
    n = w.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    vectors = w.select(key, "idx", unit("mean").alias("_u"))
    found = similar_pairs(vectors, key, "_u", threshold, 1)
    alike = found.groupBy(key).agg(F.sum("similar").alias("_k"))
    r = F.try_divide(F.coalesce("_k", F.lit(0)), F.col("_n") * (F.col("_n") - 1) / 2)
    score = F.when(r > 0.90, 0.3).when(r < 0.05, r / 0.05 * 0.4).otherwise(bell(r, 0.40, 6.0))
    none = (F.col("_f") < 4) | (F.coalesce("_n", F.lit(0)) < 2)
    return lookup(lookup(frames, n, [key]), alike, [key]).select(
        key,
        F.when(~none, r).alias("ratio"),
        F.when(none, 0.0).otherwise(clip(score)).alias("score"),
    )


def mean_power(df: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    return df.select(key, squares(vec).alias("_p")).groupBy(key).agg(
        mean_vector("_p").alias("power"), F.count(F.lit(1)).alias("frames")
    )


def holes(df: DataFrame, key: str, vec: str = "vec", win: int = 5, db: float = -30.0) -> DataFrame:
    """Share of bins far below their neighbours' moving average (mirrored at the ends)."""
    p = mean_power(df, key, vec)
    n = F.size("power")
    half = win // 2

    def smooth(i: Column) -> Column:
        near = F.transform(F.sequence(i - half, i - half + win - 1), lambda j: F.get(
            F.col("power"), F.when(j < 0, -j - 1).when(j >= n, 2 * n - j - 1).otherwise(j)
        ))
        return total(near) / win

    ratios = F.transform(
        "power",
        lambda v, i: 10.0
        * F.log10(F.greatest(v, F.lit(1e-20)) / F.greatest(smooth(i), F.lit(1e-20))),
    )
    s = p.select(key, n.alias("_n"), ratios.alias("_r"))
    share = F.size(F.filter("_r", lambda v: v < db)) / F.col("_n")
    fall = 1.0 - 0.5 * (F.col("ratio") - 0.02) / (0.10 - 0.02)
    return s.withColumn("ratio", share).select(
        key,
        "ratio",
        F.when((F.col("_n") < 10) | (F.col("ratio") < 0.02), 1.0)
        .when(F.col("ratio") >= 0.10, 0.5)
        .otherwise(clip(fall, 0.5, 1.0))
        .alias("score"),
    )


def half_similarity(df: DataFrame, key: str, order: Sequence[str], vec: str = "vec") -> DataFrame:
    """Mean cosine of frame i and frame i + n/2; best at 0.5."""
    placed = with_index(df.select(key, *order, unit(vec).alias("_u")), [key], order)
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    mid = F.floor(F.col("_n") / 2)
    joined = lookup(placed, n, [key])
    # Both halves meet on (key, position): an even join, whatever the key's size.
    first = joined.filter(F.col("idx") <= mid).select(key, F.col("idx").alias("_i"), "_u")
    second = joined.filter((F.col("idx") > mid) & (F.col("idx") <= 2 * mid)).select(
        key, (F.col("idx") - mid).alias("_i"), F.col("_u").alias("_v")
    )
    s = first.join(second, [key, "_i"]).groupBy(key).agg(clip(F.avg(dot("_u", "_v"))).alias("similarity"))
    return lookup(n, s, [key]).select(
        key,
        "similarity",
        F.when(F.col("_n") < 4, 0.0)
        .otherwise(clip(1.0 - F.abs(F.col("similarity") - 0.5) / 0.5))
        .alias("score"),
    )


# --- labels of frames -------------------------------------------------------


def triads() -> list[tuple[str, list[float]]]:
    """Major and minor triad of every note as unit vectors over 12 bins."""
    out = []
    for i, note in enumerate(C.NOTES):
        for mode, third in (("major", 4), ("minor", 3)):
            on = {i, (i + third) % 12, (i + 7) % 12}
            out.append((f"{note}_{mode}", [1 / math.sqrt(3) if j in on else 0.0 for j in range(12)]))
    return out


def classify_template(
    df: DataFrame, vec: str = "vec", templates: Sequence[tuple[str, Sequence[float]]] | None = None
) -> DataFrame:
    """Adds ``label`` and ``confidence``: the closest template by cosine, first on ties."""
    templates = templates or triads()
    options = F.array(
        *[
            F.struct(
                (-dot("_unit", F.array(*map(F.lit, t)))).alias("d"),
                F.lit(i).alias("i"),
                F.lit(name).alias("n"),
            )
            for i, (name, t) in enumerate(templates)
        ]
    )
    quiet = norm(vec) < 1e-8
    best = F.col("_best")
    return (
        df.withColumn("_unit", F.when(~quiet, scaled(vec, F.try_divide(F.lit(1.0), norm(vec)))))
        .withColumn("_best", F.array_min(options))
        .withColumn("label", F.when(F.col("_unit").isNull(), "none").otherwise(best["n"]))
        .withColumn(
            "confidence",
            F.when(F.col("_unit").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), -best["d"])),
        )
        .drop("_unit", "_best")
    )


def template_clarity(labelled: DataFrame, key: str) -> DataFrame:
    return labelled.groupBy(key).agg(clip((F.avg("confidence") - 0.5) / 0.4).alias("score"))


def transition_score(a: Column, b: Column) -> Column:
    """Quality of moving from label ``a`` to label ``b`` ('C#_minor'; 'none' allowed)."""
    note = F.create_map(*[F.lit(v) for i, n in enumerate(C.NOTES) for v in (n, i)])
    ra, rb = note[F.split_part(a, F.lit("_"), F.lit(1))], note[F.split_part(b, F.lit("_"), F.lit(1))]
    d = fifths_distance(ra, rb)
    return (
        F.when((a == "none") | (b == "none"), 0.3)
        .when(a == b, 0.7)
        .when(ra == rb, 1.0)
        .when(ra.isNull() | rb.isNull(), 0.3)
        .when(d <= 1, 1.0)
        .when(d <= 2, 0.7)
        .when(d <= 3, 0.5)
        .otherwise(0.2)
    )


def transition_quality(
    df: DataFrame, key: str, order: Sequence[str], label: str = "label", seconds: float = 1.0
) -> DataFrame:
    """Mean transition score and the number of labels per 30 s (``seconds`` per frame)."""
    tiled = ordered(df.select(key, *order, label), [key], order, before=1)
    moved = owned(tiled.withColumn("_p", F.lag(label).over(around([key]))))
    s = moved.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(F.when(F.col("_p").isNotNull(), transition_score(F.col("_p"), F.col(label)))).alias("_t"),
        F.count_distinct(F.when(F.col(label) != "none", F.col(label))).alias("labels"),
    )
    per30 = F.col("labels") * (30.0 / (F.col("_n") * seconds))
    return s.select(
        key,
        "labels",
        F.when(F.col("_n") < 2, 0.5).otherwise(clip("_t")).alias("transitions"),
        clip(bell(per30, 5.0, 0.3)).alias("variety"),
    )


def profile_argmax(
    df: DataFrame,
    key: str,
    vec: str = "vec",
    major: Sequence[float] = C.MAJOR_PROFILE,
    minor: Sequence[float] = C.MINOR_PROFILE,
) -> DataFrame:
    """``(key, best, fit)``: the rotated profile closest to the summed histogram.

    Correlation is the dot product of centred unit vectors, so the histogram is
    centred once and each profile is a constant.
    """
    h = df.groupBy(key).agg(sum_vector(vec).alias("_h")).withColumn("_m", mean_of(F.col("_h")))
    h = h.withColumn("_c", F.transform("_h", lambda v: v - F.col("_m")))
    h = h.withColumn("_c", F.transform("_c", lambda v: F.try_divide(v, norm("_c"))))
    options = []
    for shift, note in enumerate(C.NOTES):
        for mode, profile in (("major", major), ("minor", minor)):
            centred = np.array([profile[(i - shift) % 12] for i in range(12)])
            centred = centred - centred.mean()
            centred = (centred / np.linalg.norm(centred)).tolist()
            options.append(
                F.struct(
                    (-dot("_c", F.array(*map(F.lit, centred)))).alias("d"),
                    F.lit(len(options)).alias("i"),
                    F.lit(f"{note} {mode}").alias("n"),
                )
            )
    return h.withColumn("_b", F.array_min(F.array(*options))).select(
        key, F.col("_b.n").alias("best"), (-F.col("_b.d")).alias("fit")
    )


# --- windows and sections ---------------------------------------------------


def phrase_coherence(
    df: DataFrame, key: str, order: Sequence[str], vec: str = "vec", beats: int = 32
) -> DataFrame:
    """Mean pairwise cosine of phrase means, mapped to a bonus of at most 0.05."""
    w = window_means(df, key, order, vec, beats, False).filter(norm("mean") >= 1e-8)
    s = mean_pairwise_cosine(
        w.select(key, scaled("mean", 1.0 / norm("mean")).alias("_u")), [key], "_u"
    )
    bonus = F.round(clip((F.col("agreement") - 0.5) / 0.5) * 0.05, 4)
    return lookup(df.select(key).distinct(), s, [key]).select(
        key, "agreement", F.coalesce(bonus, F.lit(0.0)).alias("bonus")
    )


def progression(
    df: DataFrame, key: str, order: Sequence[str], vec: str = "vec", win: int = 4, seconds: float = 1.0
) -> DataFrame:
    """Distinct dominant bins of the windows, and how alike consecutive windows are."""
    frames = df.groupBy(key).agg(F.count(F.lit(1)).alias("_f"))
    w = window_means(df, key, order, vec, win, True)
    top = F.array_position("mean", F.array_max("mean"))
    tiled = ordered(
        w.select(key, F.col("idx").alias("_w"), "mean", top.alias("_top"), norm("mean").alias("_n")),
        [key],
        ["_w"],
        before=1,
    )
    p = F.lag("mean").over(around([key]))
    pn = F.lag("_n").over(around([key]))
    cos = F.when((F.col("_n") < 1e-8) | (pn < 1e-8), 0.0).otherwise(F.try_divide(dot(F.col("mean"), p), F.col("_n") * pn))
    s = owned(tiled.withColumn("_c", F.when(p.isNotNull(), cos))).groupBy(key).agg(
        F.count(F.lit(1)).alias("_w"),
        F.count_distinct("_top").alias("dominant"),
        F.avg("_c").alias("similarity"),
    )
    j = lookup(frames, s, [key])
    expected = clip(3.0 * (F.col("_f") * seconds / 10.0), 2.0, 12.0)
    score = 0.5 * bell(F.col("dominant") / expected, 1.0, 3.0) + 0.5 * bell("similarity", 0.6, 6.0)
    none = (F.col("_f") < 4) | (F.col("_w") < 2)
    return j.select(
        key, "dominant", "similarity", F.when(none, 0.0).otherwise(clip(score)).alias("score")
    )


def segment_contrast(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    x: str = "x",
    vec: str = "vec",
    seconds: float = 1.0,
    target: float = 0.15,
) -> DataFrame:
    """Spread of segment means of ``x`` and agreement of segment means of ``vec``."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    placed = lookup(with_index(df.select(key, *order, x, vec), [key], order), n, [key])
    count = F.least(F.lit(8), F.greatest(F.lit(4), F.floor(F.col("_n") * seconds / 2.0)))
    length = F.floor(F.col("_n") / count)
    seg = placed.withColumn("_k", F.floor(F.try_divide(F.col("idx") - 1, length))).filter(F.col("_k") < count)
    means = seg.groupBy(key, "_k").agg(F.avg(x).alias("_x"), mean_vector(vec).alias("_v"))
    spread = means.groupBy(key).agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"))
    u = F.when(norm("_v") < 1e-8, scaled("_v", F.lit(0.0))).otherwise(scaled("_v", F.try_divide(F.lit(1.0), norm("_v"))))
    agree = mean_pairwise_cosine(means.select(key, u.alias("_u")), [key], "_u")
    r = F.col("_s") / (F.col("_m") + 1e-8)
    low = target * 0.3
    contrast = clip(F.when(r >= low, 0.5 + r * 2.0).otherwise(r / (low + 1e-8) * (0.5 + low * 2.0)))
    score = 0.5 * contrast + 0.5 * bell("agreement", 0.6, 6.0)
    return lookup(lookup(n, spread, [key]), agree.drop("n"), [key]).select(
        key,
        r.alias("contrast"),
        "agreement",
        F.when((F.col("_n") < 4) | (F.col("_m") < 1e-8), 0.0).otherwise(clip(score)).alias("score"),
    )


def assign_sections(placed: DataFrame, key: str, boundaries: DataFrame) -> DataFrame:
    """Adds ``section`` (0, 1, ...) to rows with ``idx``: boundaries passed so far."""
    marks = boundaries.select(key, "idx", F.lit(1).alias("_m"))
    joined = placed.join(marks, [key, "idx"], "left")
    return running_sum(joined, [key], F.coalesce("_m", F.lit(0)), "section").drop("_m")


def sections(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    vec: str = "vec",
    k: int = 16,
    min_gap: int = 2,
    seconds: float = 1.0,
    expected: float = 4.0,
    variety_target: float = 0.35,
) -> DataFrame:
    """Section count and variety against the profile's expectation."""
    b = section_boundaries(df, key, order, vec, k, min_gap)
    placed = with_index(df.select(key, *order, unit(vec).alias("_u"), vec), [key], order)
    labelled = assign_sections(placed, key, b)
    means = labelled.groupBy(key, "section").agg(mean_vector(vec).alias("_m"))
    agree = mean_pairwise_cosine(means.select(key, unit("_m").alias("_u")), [key], "_u")
    frames = df.groupBy(key).agg(F.count(F.lit(1)).alias("_f"))
    j = lookup(agree, frames, [key])
    want = F.greatest(expected * F.col("_f") * seconds / 30.0, F.lit(1.0))
    low = F.greatest(F.lit(1), F.floor(want * 0.5))

    def fill(n: Column) -> Column:
        return F.least(F.lit(1.0), 0.5 + 0.5 * F.least(n / want, F.lit(1.5)))

    count = F.when(F.col("n") >= low, fill(F.col("n"))).otherwise(F.col("n") / low * fill(low))
    d = 1.0 - F.col("agreement")
    near = variety_target * 0.3
    edge = min(1.0, 0.5 + near * 2.0)
    variety = F.when(d >= near, F.least(F.lit(1.0), 0.5 + d * 2.0)).otherwise(
        F.greatest(F.lit(0.0), d / (near + 1e-8) * edge)
    )
    return j.select(
        key,
        F.col("n").alias("sections"),
        clip(count).alias("count_score"),
        F.when(F.col("n") < 2, 0.25).otherwise(clip(variety)).alias("variety_score"),
    )


def edge_sections(
    df: DataFrame, key: str, order: Sequence[str], boundaries: DataFrame, x: str = "x", long: int = 1024
) -> DataFrame:
    """Are the first and last section quieter than the middle, or do they ramp?"""
    placed = with_index(df.select(key, *order, x), [key], order)
    s = assign_sections(placed, key, boundaries)
    spans = s.groupBy(key, "section").agg(
        F.min("idx").alias("_a"), F.count(F.lit(1)).alias("_len"), F.avg(F.col(x) * F.col(x)).alias("_ms")
    )
    last = spans.groupBy(key).agg(F.max("section").alias("_last"))
    spans = lookup(spans, last, [key])
    edges = spans.filter((F.col("section") == 0) | (F.col("section") == F.col("_last")))
    # Quarters of the edge sections only; the middle is not read again.
    q = F.floor(F.col("_len") / 4)
    pos = F.col("idx") - F.col("_a")
    rows = lookup(s, edges.select(key, "section", "_a", "_len"), [key, "section"], "inner")
    sq = F.col(x) * F.col(x)
    quarters = rows.groupBy(key, "section").agg(
        F.sqrt(F.avg(F.when(pos < q, sq))).alias("_start"),
        F.sqrt(F.avg(F.when(pos >= F.col("_len") - q, sq))).alias("_end"),
    )
    e = lookup(edges, quarters, [key, "section"])
    rms = F.sqrt("_ms")
    middle = spans.groupBy(key).agg(
        F.avg(F.when((F.col("section") > 0) & (F.col("section") < F.col("_last")), rms)).alias("_mid"),
        F.first("_last").alias("_last"),
    )
    first = e.filter("section = 0").select(
        key, rms.alias("_r0"), F.col("_len").alias("_n0"), F.col("_start").alias("_s0"), F.col("_end").alias("_e0")
    )
    final = e.filter("section = _last").select(
        key, rms.alias("_r1"), F.col("_len").alias("_n1"), F.col("_start").alias("_s1"), F.col("_end").alias("_e1")
    )
    j = lookup(lookup(middle, first, [key]), final, [key])
    intro = (F.try_divide("_r0", "_mid") < 0.8) | (
        (F.col("_n0") > long) & (F.col("_e0") > F.col("_s0") * 1.3)
    )
    outro = (F.try_divide("_r1", "_mid") < 0.8) | (
        (F.col("_n1") > long) & (F.col("_s1") > F.col("_e1") * 1.3)
    )
    differ = (F.abs(F.col("_r0") - F.col("_mid")) / (F.col("_mid") + 1e-8) > 0.3) | (
        F.abs(F.col("_r1") - F.col("_mid")) / (F.col("_mid") + 1e-8) > 0.3
    )
    half = lambda c: F.when(c, 0.5).otherwise(0.0)
    got = half(intro) + half(outro)
    none = (F.col("_last") < 2) | (F.col("_mid") < 1e-8)
    return j.select(
        key,
        (F.col("_last") + 1).alias("sections"),
        F.when(none, 0.25).when(got > 0, got).when(differ, 0.3).otherwise(0.0).alias("score"),
    )


def boundary_ratio(
    df: DataFrame, key: str, order: Sequence[str], boundaries: DataFrame, vec: str = "vec"
) -> DataFrame:
    """Mean step at the boundaries over the median step; none without boundaries."""
    hot = is_hot(df, [key])
    f = flux(df, key, order, vec, hot).filter(F.col("flux").isNotNull())
    # The step out of frame i is stored on frame i+1; past the end, the last step counts.
    n = f.groupBy(key).agg(F.max("idx").alias("_last"), F.count(F.lit(1)).alias("_n"))
    at = lookup(boundaries.select(key, "idx"), n, [key], "inner").select(
        key, F.least(F.col("idx") + 1, F.col("_last")).alias("idx")
    )
    hit = at.join(f, [key, "idx"]).groupBy(key).agg(F.avg("flux").alias("_b"))
    med = quantiles(f.select(key, "flux"), [key], "flux", {"_med": 0.5}, hot)
    r = F.try_divide("_b", "_med")
    j = lookup(lookup(lookup(df.select(key).distinct(), n, [key]), med, [key]), hit, [key])
    none = (F.coalesce("_n", F.lit(0)) < 2) | F.col("_b").isNull() | (F.col("_med") < 1e-10)
    return j.select(
        key, r.alias("ratio"), F.when(none, 0.25).otherwise(1.0 - F.least(r / 3.0, F.lit(1.0))).alias("score")
    )


# --- spectra ----------------------------------------------------------------


def band_rms(power, bands: Bands) -> Column:
    return F.array(*[F.sqrt(mean_of(band(power, lo, hi))) for lo, hi in bands])


def band_balance(df: DataFrame, key: str, bands: Bands, vec: str = "vec", target: float = 1.0) -> DataFrame:
    b = mean_power(df, key, vec).select(key, band_rms("power", bands).alias("_b"))
    b = b.withColumn("_m", mean_of(F.col("_b")))
    cv = F.try_divide(std_of(F.col("_b"), F.col("_m")), F.col("_m"))
    return b.select(
        key,
        cv.alias("cv"),
        F.when(F.col("_m") < 1e-10, 0.0).otherwise(clip(1.0 - F.abs(cv - target) / 1.5)).alias("score"),
    )


def band_entropy(df: DataFrame, key: str, bands: Bands, vec: str = "vec") -> DataFrame:
    """Median over frames, then over bands, of the normalised entropy inside a band."""

    def entropy(b: Column, bins: int) -> Column:
        s = total(b) + 1e-10
        e = -total(F.transform(b, lambda v: v / s * F.log2(v / s + 1e-12)))
        return e / (math.log2(bins) + 1e-10)

    hot = is_hot(df, [key])
    rows = df.select(
        key,
        F.posexplode(F.array(*[entropy(band(vec, lo, hi), hi - lo) for lo, hi in bands if hi - lo > 1])).alias(
            "_band", "_e"
        ),
    )
    per_band = quantiles(rows, [key, "_band"], "_e", {"_m": 0.5}, hot)
    s = per_band.groupBy(key).agg(F.percentile("_m", F.lit(0.5)).alias("entropy"))
    return s.withColumn("score", clip((0.9 - F.col("entropy")) / 0.6))


def band_contrast(df: DataFrame, key: str, bands: Bands, vec: str = "vec") -> DataFrame:
    """0.6 x spread of the bands' mean levels + 0.4 x mean spread inside frames."""
    e = df.select(key, band_rms(squares(vec), bands).alias("_b")).withColumn("_m", mean_of(F.col("_b")))
    frame_cv = std_of(F.col("_b"), F.col("_m")) / (F.col("_m") + 1e-10)
    s = e.select(key, "_b", frame_cv.alias("_cv")).groupBy(key).agg(
        mean_vector("_b").alias("_means"), F.avg("_cv").alias("_fcv")
    )
    s = s.withColumn("_m", mean_of(F.col("_means")))
    value = 0.6 * F.try_divide(std_of(F.col("_means"), F.col("_m")), F.col("_m")) + 0.4 * F.col("_fcv")
    none = (F.size("_means") < 3) | (F.col("_m") < 1e-10)
    return s.select(key, value.alias("contrast"), F.when(none, 0.0).otherwise(clip(value)).alias("score"))


def band_difference(
    df: DataFrame, key: str, bands: Bands, left: str = "left", right: str = "right"
) -> DataFrame:
    s = df.select(key, squares(left).alias("_l"), squares(right).alias("_r")).groupBy(key).agg(
        mean_vector("_l").alias("_l"), mean_vector("_r").alias("_r")
    )
    d = F.zip_with(
        band_rms("_l", bands), band_rms("_r", bands), lambda a, b: F.abs(a - b) / (a + b + 1e-10)
    )
    s = s.withColumn("_d", d).withColumn("mean_diff", mean_of(F.col("_d")))
    spread = std_of(F.col("_d"), F.col("mean_diff"))
    score = 0.6 * F.least(F.col("mean_diff") / 0.15, F.lit(1.0)) + 0.4 * F.least(spread / 0.10, F.lit(1.0))
    return s.select(key, "mean_diff", spread.alias("spread"), clip(score).alias("score"))


def spectral_tilt(
    df: DataFrame,
    key: str,
    vec: str = "vec",
    bin_hz: float = 50.0,
    min_hz: float = 50.0,
    target: float = -3.0,
    tolerance: float = 3.5,
) -> DataFrame:
    """Slope of the log spectrum per octave and the spread around it."""
    s = df.groupBy(key).agg(mean_vector(vec).alias("_s"))
    bins = s.select(key, F.posexplode("_s").alias("_i", "_v")).filter(F.col("_i") * bin_hz > min_hz)
    points = bins.select(
        key, F.log2(F.col("_i") * bin_hz).alias("_x"), F.ln(F.col("_v") + 1e-10).alias("_y")
    )
    r = points.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.regr_slope("_y", "_x").alias("_slope"),
        F.var_pop("_y").alias("_vy"),
        F.covar_pop("_x", "_y").alias("_cxy"),
    )
    tilt = F.col("_slope") * (20.0 / math.log(10.0))
    # Residual variance of a least-squares line: var(y) - slope * cov(x, y).
    spread = F.sqrt(F.greatest(F.col("_vy") - F.col("_slope") * F.col("_cxy"), F.lit(0.0)))
    fit = F.greatest(F.lit(0.0), 1.0 - F.abs(tilt - target) / tolerance)
    regular = F.greatest(F.lit(0.0), 1.0 - F.greatest(F.lit(0.0), (spread - 1.5) / 3.0))
    return r.select(
        key,
        tilt.alias("tilt"),
        spread.alias("irregularity"),
        F.when(F.col("_n") < 10, 0.0).otherwise(clip(0.7 * fit + 0.3 * regular)).alias("score"),
    )


def active_share(df: DataFrame, key: str, vec: str = "vec", db: float = -60.0) -> DataFrame:
    s = df.groupBy(key).agg(mean_vector(vec).alias("_s")).withColumn("_p", F.array_max("_s"))
    loud = F.filter("_s", lambda v: 20.0 * F.log10(F.try_divide(v, F.col("_p")) + 1e-10) > db)
    share = F.size(loud) / F.size("_s")
    return s.select(
        key, share.alias("share"), F.when(F.col("_p") < 1e-10, 0.0).otherwise(clip(share / 0.6)).alias("score")
    )


def band_share(df: DataFrame, key: str, from_bin: int, vec: str = "vec") -> DataFrame:
    """Energy at and above ``from_bin``; best at 0.2."""
    high = F.aggregate(
        F.slice(F.col(vec), F.lit(from_bin + 1), F.size(vec)), F.lit(0.0), lambda s, v: s + v * v
    )
    s = df.groupBy(key).agg(F.sum(high).alias("_h"), F.sum(dot(vec, vec)).alias("_t"))
    r = F.col("_h") / (F.col("_t") + 1e-10)
    return s.select(key, r.alias("share"), clip(bell(r, 0.2, 8.0)).alias("score"))


def band_ratio(
    df: DataFrame, key: str, inner: tuple[int, int], outer: tuple[int, int], vec: str = "vec"
) -> DataFrame:
    """Presence (inner band over everything, best at 0.35, at least 0.3) and harshness
    (inner over outer band, penalised above 0.15)."""
    sq = squares(vec)
    s = df.groupBy(key).agg(
        F.sum(total(band(sq, *inner))).alias("_i"),
        F.sum(total(band(sq, *outer))).alias("_o"),
        F.sum(total(sq)).alias("_t"),
    )
    p, h = F.try_divide("_i", "_t"), F.try_divide("_i", "_o")
    harsh = (
        F.when(h <= 0.15, 1.0)
        .when(h <= 0.25, 1.0 - (h - 0.15) / 0.10 * 0.3)
        .otherwise(F.greatest(0.7 - (h - 0.25) / 0.25 * 0.5, F.lit(0.1)))
    )
    return s.select(
        key,
        p.alias("share"),
        F.when(F.col("_t") < 1e-10, 0.3)
        .otherwise(clip(F.greatest(bell(p, 0.35, 8.0), F.lit(0.3))))
        .alias("presence"),
        F.when(F.col("_o") < 1e-10, 0.5).otherwise(clip(harsh)).alias("harshness"),
    )


def flatness(df: DataFrame, key: str, lo: int, hi: int, vec: str = "vec") -> DataFrame:
    """Geometric over arithmetic mean of the mean magnitudes in a band."""
    s = df.groupBy(key).agg(mean_vector(band(vec, lo, hi)).alias("_m"))
    mean = mean_of(F.col("_m"))
    geo = F.exp(mean_of(F.transform("_m", lambda v: F.ln(v + 1e-10))))
    f = F.try_divide(geo, mean)
    odd = F.exists("_m", lambda v: v < 0) | (mean < 1e-10)
    return s.select(
        key, f.alias("flatness"), F.when(odd, 0.5).otherwise(clip(1.0 - F.least(f / 0.3, F.lit(1.0)))).alias("score")
    )
