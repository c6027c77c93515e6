"""Pairwise preference and annotation (G)."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contest_analytics import config as C
from contest_analytics.functions.curves import as_col, logistic
from contest_analytics.functions.vectors import dot
from contest_analytics.scale import around, is_hot, lookup, ordered, owned, with_index

PAIR_TILE = 1024
#: Hex digits that hashes are counted by: 65,536 numbers come to the driver.
DIGITS = 4


def make_pairs(
    items: DataFrame, group: str, name: str, carry: Sequence[str] = (), same_group: bool = True
) -> DataFrame:
    """``(challenge, a, b)`` with a < b, plus ``<col>_a``/``<col>_b`` of ``carry``.

    The pairs are the result, so their number is what was asked for. Members of a
    group are numbered and matched tile against tile, which spreads a very large
    group over many tasks. Across groups, the challenge is kept only when equal.
    """
    keys = [group] if same_group else []
    if not same_group:
        items = items.withColumn("_all", F.lit(1))
        keys = ["_all"]
    placed = with_index(items.select(*{*keys, group, name, *carry}), keys, [name], "_i")
    row = F.floor((F.col("_i") - 1) / PAIR_TILE)
    left = placed.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        row.alias("_tile"),
        F.col("_i").alias("_ia"),
        F.col(group).alias("_ga"),
        F.col(name).alias("a"),
        *[F.col(c).alias(f"{c}_a") for c in carry],
    )
    right = placed.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.explode(F.sequence(F.lit(0).cast("long"), row)).alias("_tile"),
        F.col("_i").alias("_ib"),
        F.col(group).alias("_gb"),
        F.col(name).alias("b"),
        *[F.col(c).alias(f"{c}_b") for c in carry],
    )
    on = [*[f"_k_{k}" for k in keys], "_tile"]
    pairs = left.join(right, on).filter("_ia < _ib")
    challenge = F.when(F.col("_ga") == F.col("_gb"), F.col("_ga").cast("string")).otherwise("")
    return pairs.select(
        (F.col("_ga") if same_group else challenge).alias("challenge"),
        "a",
        "b",
        *[f"{c}_{s}" for c in carry for s in "ab"],
    )


def pair_id(a, b) -> Column:
    """Same id for (a, b) and (b, a)."""
    x, y = as_col(a).cast("string"), as_col(b).cast("string")
    return F.substring(F.sha2(F.concat_ws("\n", F.least(x, y), F.greatest(x, y)), 256), 1, 12)


def pending_pairs(pairs: DataFrame, done: DataFrame, n: int | None = None) -> DataFrame:
    left = pairs.join(done.select("pair_id"), "pair_id", "left_anti")
    return left if n is None else left.orderBy("pair_id").limit(n)


def content_seed(df: DataFrame, name: str) -> str:
    """A seed that depends on the set of names, not on their order."""
    part = F.conv(F.substring(F.sha2(F.col(name).cast("string"), 256), 1, 15), 16, 10).cast("long")
    row = df.agg(F.bit_xor(part).alias("x"), F.count(F.lit(1)).alias("n")).first()
    return f"{row['x']}:{row['n']}"


def stable_shuffle(df: DataFrame, seed: str, unique: str) -> DataFrame:
    """Adds ``position`` 1..n of a reproducible order over all rows."""
    mark = F.sha2(F.concat(F.lit(seed), F.col(unique).cast("string")), 256)
    return with_index(df.withColumn("_mark", mark), [], ["_mark", unique], "position").drop("_mark")


def orient(annotations: DataFrame, embeddings: DataFrame, key="key", vec="vec") -> DataFrame:
    """All annotations with ``preferred_key``, ``rejected_key`` and ``drop_reason``."""
    a, b, choice = F.col("a"), F.col("b"), F.col("preferred")
    named = annotations.withColumns(
        {
            "preferred_key": F.when(choice == "a", a).when(choice == "b", b),
            "rejected_key": F.when(choice == "a", b).when(choice == "b", a),
        }
    )
    for side in ("preferred", "rejected"):
        e = embeddings.select(F.col(key).alias(f"{side}_key"), F.col(vec).alias(f"{side}_vec"))
        named = named.join(e, f"{side}_key", "left")
    reason = (
        F.when(choice == "skip", "skip")
        .when(a.isNull() | b.isNull(), "missing_item")
        .when(F.col("preferred_key").isNull(), "unknown_choice")
        .when(F.col("preferred_vec").isNull(), "missing_preferred")
        .when(F.col("rejected_vec").isNull(), "missing_rejected")
    )
    return named.withColumn("drop_reason", reason)


def oriented_pairs(
    annotations: DataFrame, embeddings: DataFrame, key="key", vec="vec"
) -> tuple[DataFrame, DataFrame]:
    """Usable pairs, and the number of dropped annotations per reason."""
    all_rows = orient(annotations, embeddings, key, vec)
    good = all_rows.filter(F.col("drop_reason").isNull()).drop("drop_reason")
    dropped = all_rows.filter(F.col("drop_reason").isNotNull()).groupBy("drop_reason").agg(
        F.count(F.lit(1)).alias("n")
    )
    return good, dropped


def require_pairs(pairs: DataFrame, minimum: int = 10, advised: int = 50) -> int:
    n = pairs.count()
    if n < minimum:
        raise ValueError(f"need at least {minimum} valid pairs, got {n}")
    if n < advised:
        warnings.warn(f"only {n} valid pairs; {advised} or more are advised", stacklevel=2)
    return n


def split_pairs(
    df: DataFrame, fraction: float = 0.2, seed: str = "42", unique: str = "pair_id"
) -> DataFrame:
    """Adds ``is_validation``: the first max(1, floor(n x fraction)) rows in hash order.

    Rows are not ordered for it, only the hash of the last validation row is looked up: by counts
    of the hashes' first digits, then among the hashes that begin like it.
    """
    shown = df.withColumn("_mark", F.sha2(F.concat(F.lit(seed), F.col(unique).cast("string")), 256))
    # Rows without an id come first.
    begin = F.coalesce(F.substring("_mark", 1, DIGITS), F.lit(""))
    counts = sorted(shown.groupBy(begin.alias("b")).count().collect())
    if not counts:
        return df.withColumn("is_validation", F.lit(False))
    left = max(1, int(sum(n for _, n in counts) * fraction))
    for start, n in counts:
        if left <= n:
            break
        left -= n
    for mark, n in sorted(shown.filter(begin == start).groupBy(F.coalesce("_mark", F.lit("")).alias("m")).count().collect()):
        if left <= n:
            break
        left -= n
    here = F.coalesce("_mark", F.lit(""))
    if left == n:
        return shown.withColumn("is_validation", here <= mark).drop("_mark")
    # Copies of one id on both sides of the border: as many of them as there is place for.
    copies = with_index(shown.filter(here == mark), [], [unique], "_place")
    rest = shown.filter(here != mark).withColumn("is_validation", here < mark)
    copies = copies.withColumn("is_validation", F.col("_place") <= left).drop("_place")
    return rest.unionByName(copies).drop("_mark")


def fit_preference(
    pairs: DataFrame, reg: float = 0.01, iterations: int = 100
) -> LogisticRegressionModel:
    """Linear Bradley-Terry scores: P(a beats b) = sigmoid(w . (a - b))."""
    diff = F.zip_with("preferred_vec", "rejected_vec", lambda x, y: x - y)
    mirrored = pairs.select(diff.alias("d")).select(
        F.explode(
            F.array(
                F.struct(F.lit(1.0).alias("label"), F.col("d").alias("d")),
                F.struct(F.lit(0.0).alias("label"), F.transform("d", lambda v: -v).alias("d")),
            )
        ).alias("r")
    )
    train = mirrored.select("r.label", array_to_vector("r.d").alias("features"))
    return LogisticRegression(
        fitIntercept=False, standardization=False, regParam=reg, maxIter=iterations
    ).fit(train)


def model_weights(model: LogisticRegressionModel) -> list[float]:
    return [float(v) for v in model.coefficients]


def fit_certificate(pairs: DataFrame, weights: Sequence[float], reg: float = 0.01, tolerance: float = 1e-4) -> DataFrame:
    """One row ``(n, dims, slope, optimal)``: is the loss that ``fit_preference`` minimises flat at ``weights``?

    ``slope`` is the largest entry of its gradient, mean((sigmoid(w.d) - 1) d) + reg w. The loss is
    strictly convex, so a flat place is the one minimum.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    diff = pairs.select(F.zip_with("preferred_vec", "rejected_vec", lambda x, y: x - y).alias("d"))
    pull = diff.withColumn("_p", logistic(dot("d", w)) - 1.0)
    means = pull.agg(
        F.count(F.lit(1)).alias("n"),
        vector_to_array(Summarizer.mean(array_to_vector(F.transform("d", lambda v: v * F.col("_p"))))).alias("_g"),
    )
    slope = F.array_max(F.zip_with("_g", w, lambda g, x: F.abs(g + reg * x)))
    return means.select("n", F.size("_g").alias("dims"), slope.alias("slope"), (slope <= tolerance).alias("optimal"))


def preference_score(df: DataFrame, weights: Sequence[float] | None, vec: str = "vec") -> DataFrame:
    """Adds ``preference``; 0.5 without a model or a vector."""
    if not weights:
        return df.withColumn("preference", F.lit(0.5))
    w = F.array(*[F.lit(float(x)) for x in weights])
    return df.withColumn(
        "preference", F.when(F.col(vec).isNull(), 0.5).otherwise(logistic(dot(F.col(vec), w)))
    )


def pairwise_metrics(scored: DataFrame, sp="score_preferred", sr="score_rejected") -> DataFrame:
    d = F.col(sp) - F.col(sr)
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((d > 0).cast("double")).alias("accuracy"),
        F.avg(F.log1p(F.exp(-d))).alias("log_loss"),
    )


def weighted_vote(
    votes: DataFrame,
    reliability: DataFrame | None = None,
    pair="pair",
    annotator="annotator",
    choice="choice",
    threshold: float = C.VOTE_SHARE,
) -> DataFrame:
    """``(pair, winner, share_a)``; winner null without a clear majority."""
    if reliability is None:
        weighed = votes.withColumn("_w", F.lit(1.0))
    else:
        weighed = lookup(
            votes, reliability.select(annotator, F.col("reliability").alias("_r")), [annotator]
        ).withColumn("_w", F.coalesce("_r", F.lit(1.0)))
    # Unlike max_by or a collected list, two conditional sums combine map-side.
    sums = weighed.groupBy(pair).agg(
        F.sum(F.when(F.col(choice) == "a", F.col("_w")).otherwise(0.0)).alias("_a"),
        F.sum(F.when(F.col(choice) == "b", F.col("_w")).otherwise(0.0)).alias("_b"),
    )
    total = F.col("_a") + F.col("_b")
    share = F.when(total >= 1e-8, F.col("_a") / total)
    return sums.select(
        pair,
        F.when(share > threshold, "a")
        .when(F.when(total >= 1e-8, F.col("_b") / total) > threshold, "b")
        .alias("winner"),
        share.alias("share_a"),
    )


def vote_agreement(
    votes: DataFrame, reliability: DataFrame | None = None, pair="pair", choice="choice"
) -> DataFrame:
    """Votes on resolved pairs with ``agreed``; unresolved pairs are left out."""
    resolved = weighted_vote(votes, reliability, pair=pair, choice=choice).filter(
        F.col("winner").isNotNull()
    )
    return lookup(votes, resolved.select(pair, "winner"), [pair], "inner").withColumn(
        "agreed", F.col(choice) == F.col("winner")
    )


def annotator_reliability(
    resolved: DataFrame,
    annotator: str = "annotator",
    order: Sequence[str] = ("ts",),
    agreed: str = "agreed",
    alpha: float = C.RELIABILITY_ALPHA,
    low: float = C.RELIABILITY_MIN,
    chunk: int = 1024,
) -> DataFrame:
    """``(annotator, reliability, votes)``: r <- max(alpha*agree + (1-alpha)*r, low), from 1.

    One step is r -> max(m*r + b, c), and such steps compose to the same form.
    Chunks of 1024 votes are folded to one (m, b, c) each and a second short fold
    joins the chunks, so no array grows with an annotator's history.
    """
    placed = with_index(resolved.select(annotator, *order, agreed), [annotator], list(order))
    keep = 1.0 - alpha

    def then(f: Column, g: Column) -> Column:
        return F.struct(
            (g["m"] * f["m"]).alias("m"),
            (g["m"] * f["b"] + g["b"]).alias("b"),
            F.greatest(g["m"] * f["c"] + g["b"], g["c"]).alias("c"),
        )

    def step(place: str) -> Column:
        gain = F.when(F.col(agreed), alpha).otherwise(0.0)
        return F.struct(
            F.col(place).alias("i"),
            F.lit(keep).alias("m"),
            gain.alias("b"),
            F.lit(low).alias("c"),
        )

    same = F.struct(
        F.lit(1.0).alias("m"), F.lit(0.0).alias("b"), F.lit(float("-inf")).alias("c")
    )

    def fold(items: Column) -> Column:
        return F.aggregate(F.array_sort(items), same, then)

    chunks = (
        placed.withColumn("_k", F.floor((F.col("idx") - 1) / chunk))
        .groupBy(annotator, "_k")
        .agg(fold(F.collect_list(step("idx"))).alias("f"), F.count(F.lit(1)).alias("_n"))
    )
    whole = chunks.groupBy(annotator).agg(
        fold(F.collect_list(F.struct(F.col("_k").alias("i"), "f.m", "f.b", "f.c"))).alias("f"),
        F.sum("_n").alias("votes"),
    )
    value = F.greatest(F.col("f.m") + F.col("f.b"), F.col("f.c"))
    return whole.select(annotator, value.alias("reliability"), "votes")


def uncertain_pairs(
    scores: DataFrame, round_key: str, uid: str = "uid", score: str = "score", k: int = 3
) -> DataFrame:
    """Per round, the ``k`` pairs with the closest scores: ``(round, a, b, uncertainty)``.

    In score order, a pair more than ``k`` places apart encloses ``k`` pairs that
    are at least as close and come first, so only ``k`` neighbours are looked at.
    """
    filled = scores.select(
        round_key, uid, F.coalesce(F.col(score), F.lit(0.5)).alias("_s")
    )
    tiled = ordered(filled, [round_key], ["_s", uid], after=k)
    w = around([round_key])
    near = F.array_compact(
        F.array(
            *[
                F.when(
                    F.lead("_s", d).over(w).isNotNull(),
                    F.struct(F.lead(uid, d).over(w).alias("u"), F.lead("_s", d).over(w).alias("s")),
                )
                for d in range(1, k + 1)
            ]
        )
    )
    pairs = owned(tiled.withColumn("_near", near)).select(
        round_key, uid, "_s", F.explode("_near").alias("_o")
    )
    named = pairs.select(
        round_key,
        F.least(F.col(uid), F.col("_o.u")).alias("a"),
        F.greatest(F.col(uid), F.col("_o.u")).alias("b"),
        (1.0 - F.abs(F.col("_s") - F.col("_o.s"))).alias("uncertainty"),
    )
    best = W.partitionBy(round_key).orderBy(F.round("uncertainty", 9).desc(), "a", "b")
    return named.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def retrain_due(
    annotations: DataFrame,
    now: int,
    last_run: int,
    last_count: int,
    ts: str = "ts",
    min_total: int = 10,
    min_new: int = 5,
    cooldown: int = 7200,
) -> DataFrame:
    """One row: total, new since the last run, due, and what blocks it."""
    t = annotations.agg(F.count(F.lit(1)).alias("total"))
    new = F.col("total") - last_count
    reason = (
        F.when(F.col("total") < min_total, "too_few_total")
        .when(new < min_new, "too_few_new")
        .when(F.lit(now - last_run) < cooldown, "cooldown")
    )
    return t.select(
        "total", new.alias("new_pairs"), reason.alias("blocked_by"), reason.isNull().alias("due")
    )
