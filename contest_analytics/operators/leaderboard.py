"""Smoothed leaderboards, ranking and weight distribution (E).

Folds over a contributor's events are linear, so they are sums over positions:
each event weighs alpha * (1-alpha)^(events after it). The position comes from
``scale.with_index``, which keeps a very active contributor out of a single task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contest_analytics import config as C
from contest_analytics.functions.curves import clip, sanitize_score
from contest_analytics.operators.lookups import match_identity
from contest_analytics.operators.greedy import spaced
from contest_analytics.scale import (
    FACTS,
    are_hot,
    around,
    facts,
    is_hot,
    key_sizes,
    lookup,
    ordered,
    owned,
    quantiles,
    with_index,
)


def ema(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    x: str,
    alpha: float = C.EMA_ALPHA,
    seed: float = C.EMA_SEED,
    hot: bool | None = None,
) -> DataFrame:
    """``(keys, ema, rounds)`` after all events of each key. ``order`` must be total."""
    backwards = [F.col(o).desc() for o in order]
    placed = with_index(df.select(*keys, *order, x), keys, backwards, "_after", hot)
    decay = F.pow(F.lit(1.0 - alpha), F.col("_after") - 1)
    summed = placed.groupBy(*keys).agg(
        F.sum(alpha * sanitize_score(x) * decay).alias("_sum"), F.count(F.lit(1)).alias("rounds")
    )
    left = F.pow(F.lit(1.0 - alpha), F.col("rounds")) * seed
    return summed.select(*keys, (F.col("_sum") + left).alias("ema"), "rounds")


# Positions per chunk of a trajectory, at most. Inside a chunk weights are scaled from its
# first event, so keep^-positions must stay a normal double: at most 10^100.
TRAJECTORY_CHUNK = 256
SCALE_LIMIT = math.log(1e100)
# A chunk that keeps less than this of the state before it needs no longer memory than two
# chunks. Beyond this many positions there is one chunk at most.
FORGOTTEN, LONGEST = 1e-9, 1 << 44


def _decayed(
    placed: DataFrame, keys: Sequence[str], idx: str, value: Column, keep: float, name: str, span: int = 1
) -> DataFrame:
    """Adds ``name``: the sum over the key's rows up to this one of value * keep^(rows after).

    ``idx`` is a dense 1-based position. A prefix sum inside each chunk, plus the decayed
    state at the chunk's start. The states at chunk ends are again such a sum, with
    keep^(chunk length) for ``keep``, so they are found in the same way, until a chunk forgets
    what came before it. No window holds more than one chunk.
    """
    if keep <= 0.0:
        return placed.withColumn(name, value)
    rate = -math.log(keep) if keep < 1.0 else 0.0
    n = TRAJECTORY_CHUNK if rate == 0.0 else max(2, min(TRAJECTORY_CHUNK, int(SCALE_LIMIT / rate)))
    left = keep**n
    chunk, pos, part, start = (f"_{name}_{c}" for c in ("chunk", "pos", "part", "start"))
    decay = F.pow(F.lit(keep), F.col(pos))
    cut = placed.withColumn(chunk, F.floor((F.col(idx) - 1) / n)).withColumn(pos, F.pmod(F.col(idx) - 1, F.lit(n)) + 1)
    inside = W.partitionBy(*keys, chunk).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    cut = cut.withColumn(part, F.sum(value / decay).over(inside) * decay)
    ends = cut.filter(F.col(pos) == n).select(*keys, (F.col(chunk) + 1).alias(chunk), F.col(part).alias(start))
    if left < FORGOTTEN:
        before = ends.select(*keys, (F.col(chunk) + 1).alias(chunk), (F.col(start) * left).alias(start))
        starts = ends.unionByName(before).groupBy(*keys, chunk).agg(F.sum(start).alias(start))
    elif span * n < LONGEST:
        starts = _decayed(ends, keys, chunk, F.col(start), left, f"{name}_", span * n).select(
            *keys, chunk, F.col(f"{name}_").alias(start)
        )
    else:
        starts = ends
    joined = lookup(cut, starts, [*keys, chunk])
    state = F.col(part) + F.coalesce(F.col(start), F.lit(0.0)) * decay
    return joined.withColumn(name, state).drop(chunk, pos, part, start)


def ema_trajectory(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    x: str,
    alpha: float = C.EMA_ALPHA,
    seed: float = C.EMA_SEED,
    hot: bool | None = None,
) -> DataFrame:
    """All rows plus ``ema``, the state after each of them, for any ``alpha`` from 0 to 1."""
    keep = 1.0 - alpha
    placed = with_index(df, keys, order, hot=hot)
    summed = _decayed(placed, keys, "idx", alpha * sanitize_score(x), keep, "ema")
    return summed.withColumn("ema", F.col("ema") + seed * F.pow(F.lit(keep), F.col("idx")))


def with_nonresponders(
    assigned: DataFrame, responses: DataFrame, keys: Sequence[str], score: str = "score"
) -> DataFrame:
    """Responses plus a zero score for every assigned key that did not respond."""
    silent = assigned.select(*keys).distinct().join(responses.select(*keys), list(keys), "left_anti")
    return responses.select(*keys, score).unionByName(silent.withColumn(score, F.lit(0.0)))


def identity_segments(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], identity: str, hot: bool | None = None
) -> DataFrame:
    """Adds ``changed``: the identity differs from the key's previous row."""
    tiled = ordered(df, keys, order, before=1, hot=hot)
    previous = F.lag(identity).over(around(keys))
    return owned(tiled.withColumn("changed", previous.isNotNull() & (previous != F.col(identity))))


def ema_with_resets(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    identity: str,
    x: str,
    alpha: float = C.EMA_ALPHA,
) -> DataFrame:
    """``(keys, ema, rounds, identity, resets)``: the fold restarts at each change."""
    hot = is_hot(df, keys)
    marked = identity_segments(df, keys, order, identity, hot)
    # Only the rows after the last change matter; find it with one small aggregate.
    cut = marked.groupBy(*keys).agg(
        F.max(F.when(F.col("changed"), F.col("idx"))).alias("_cut"),
        F.count_if("changed").alias("resets"),
        F.max("idx").alias("_last"),
        F.max_by(identity, "idx").alias(identity),
    )
    tail = lookup(marked.drop(identity), cut, keys).filter(
        F.col("_cut").isNull() | (F.col("idx") >= F.col("_cut"))
    )
    decay = F.pow(F.lit(1.0 - alpha), F.col("_last") - F.col("idx"))
    return tail.groupBy(*keys).agg(
        F.sum(alpha * sanitize_score(x) * decay).alias("ema"),
        F.count(F.lit(1)).alias("rounds"),
        F.first(identity).alias(identity),
        F.first("resets").alias("resets"),
    )


def prune_stale(board: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    return board.join(registry.select(key), key, "left_semi")


def population_quality(
    df: DataFrame,
    contest: Sequence[str],
    round_key: str,
    x: str,
    alpha: float = C.POPULATION_ALPHA,
    start: float = C.POPULATION_START,
) -> DataFrame:
    """Per contest and round: the median score and the smoothed quality after it."""
    scored = df.withColumn("_x", sanitize_score(x))
    hot_round, hot_contest = are_hot(df, contest, [round_key])
    medians = quantiles(scored, [*contest, round_key], "_x", {"median": 0.5}, hot_round)
    out = ema_trajectory(medians, contest, [round_key], "median", alpha, start, hot_contest)
    return out.withColumn("quality", clip("ema")).drop("ema", "idx")


def power_weight(value, p: float = C.POWER) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v > 0, F.pow(v, F.lit(p))).otherwise(0.0)


def ranked_board(board: DataFrame, contest: Sequence[str], key: str, hot=None) -> DataFrame:
    """Adds ``rank`` by score descending, key ascending."""
    return with_index(board, contest, [F.col("ema").desc(), F.col(key)], "rank", hot)


def tiered_weights(
    board: DataFrame,
    contest: Sequence[str],
    key: str = "contributor",
    k: int = C.ELITE_K,
    pool: float = C.ELITE_POOL,
    p: float = C.POWER,
    hot: bool | None = None,
) -> DataFrame:
    """Adds ``rank``, ``tier`` and ``weight``.

    Zero scores sort last, so a rank <= k with a positive score is elite in both
    senses the contest uses. Tier totals are two sums per contest, joined back.
    """
    # A large contest is ranked in runs: its rows are then joined where they are.
    number = FACTS + 1
    if hot is None:
        hot, number = key_sizes(board, contest)
    elif hot:
        number = board.select(*contest).distinct().count()
    ranked = ranked_board(board, contest, key, hot).withColumn(
        "tier", F.when(F.col("rank") <= k, "elite").otherwise("rest")
    )
    ranked = ranked.withColumn("_raw", power_weight("ema", p))
    sums = ranked.groupBy(*contest).agg(
        F.sum(F.when(F.col("tier") == "elite", F.col("_raw"))).alias("_elite"),
        F.sum(F.when(F.col("tier") == "rest", F.col("_raw"))).alias("_rest"),
    )
    # Ranked in one window, the rows are together by contest already.
    joined = facts(ranked, sums, contest, number if hot else FACTS + 1)
    rest = F.coalesce(F.col("_rest"), F.lit(0.0))
    share = (
        F.when(F.col("tier") == "rest", 1.0 - pool).when(rest > 0, pool).otherwise(1.0)
    )
    total = F.when(F.col("tier") == "elite", F.col("_elite")).otherwise(rest)
    return joined.withColumn(
        "weight", F.when(total > 0, F.col("_raw") / total * share).otherwise(0.0)
    ).drop("_raw", "_elite", "_rest")


def snapshot(board: DataFrame, contest: Sequence[str], key: str = "contributor", **kw) -> DataFrame:
    """The published board: rank, tier, rounds, score and weight to six places."""
    return tiered_weights(board, contest, key, **kw).select(
        *contest,
        key,
        "rank",
        "tier",
        "rounds",
        (F.round("ema", 6) + 0.0).alias("ema"),
        (F.round("weight", 6) + 0.0).alias("weight"),
    )


def summary(
    board: DataFrame, contest: Sequence[str], key: str = "contributor", **kw
) -> DataFrame:
    w = tiered_weights(board, contest, key, **kw)
    weighted = F.when(F.col("ema") > 0, F.col("weight"))
    return w.groupBy(*contest).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("weight") > 0).alias("with_weight"),
        F.count_if(F.col("tier") == "elite").alias("elite_count"),
        F.round(
            F.coalesce(F.sum(F.when(F.col("tier") == "elite", F.col("weight"))), F.lit(0.0)), 4
        ).alias("elite_share"),
        F.avg("ema").alias("ema_mean"),
        F.max("ema").alias("ema_max"),
        F.coalesce(F.avg(weighted), F.lit(0.0)).alias("weight_mean"),
        F.coalesce(F.max(weighted), F.lit(0.0)).alias("weight_max"),
    )


def normalize_weights(df: DataFrame, partition: Sequence[str], w: str = "w") -> DataFrame:
    """Adds ``share``: sums to 1 per partition; uniform when nothing is positive."""
    pos = F.greatest(F.col(w), F.lit(0.0))
    sums = df.groupBy(*partition).agg(
        F.sum(pos).alias("_total"), F.count(F.lit(1)).alias("_n")
    )
    joined = facts(df, sums, partition, df.select(*partition).distinct().count())
    return joined.withColumn(
        "share",
        F.when(F.col("_total") > 0, pos / F.col("_total")).otherwise(1.0 / F.col("_n")),
    ).drop("_total", "_n")


def cap_weights(
    df: DataFrame, partition: Sequence[str], key: str = "key", w: str = "w", limit: float = 0.1
) -> DataFrame:
    """Adds ``share``: sums to 1, none above ``limit``.

    At most 1/limit entries can exceed the limit, so the cutoff follows from the
    largest ``ceil(1/limit)+1`` entries, the total and the count of a partition: a
    bounded top list per partition, not a sort of the whole partition.
    """
    eps = 1e-7
    top_n = int(1 / limit) + 2
    best = W.partitionBy(*partition).orderBy(F.col(w).desc(), F.col(key))
    top = (
        df.select(*partition, key, w)
        .withColumn("_r", F.row_number().over(best))
        .filter(F.col("_r") <= top_n)
    )
    tops = top.groupBy(*partition).agg(
        F.reverse(F.array_sort(F.collect_list(F.col(w)))).alias("_top")
    )
    sums = df.groupBy(*partition).agg(
        F.sum(w).alias("_total"), F.count(F.lit(1)).alias("_n"), F.max(w).alias("_max")
    )
    known = lookup(sums, tops, partition)
    # For the r-th largest share e_r: everything above it is lifted down to e_r, and
    # its part of the remaining mass is e_r / ((r-1) e_r + sum of shares up to it).
    # Entries at or above the limit number k = the first r (from the top) that fails.
    shares = F.transform(F.col("_top"), lambda v: F.try_divide(v, F.col("_total")))
    positions = F.sequence(F.lit(1), F.size("_top"))
    above = lambda r: F.aggregate(
        F.slice(F.col("_shares"), F.lit(1), r - 1), F.lit(0.0), lambda s, v: s + v
    )
    over = F.filter(
        positions,
        lambda r: F.element_at(F.col("_shares"), r)
        / ((r - 1) * F.element_at(F.col("_shares"), r) + (1.0 - above(r)) + eps)
        >= limit,
    )
    known = known.withColumn("_shares", shares).withColumn("_k", F.size(over))
    below = 1.0 - F.aggregate(
        F.slice("_shares", F.lit(1), F.col("_k")), F.lit(0.0), lambda s, v: s + v
    )
    cutoff = F.try_divide(limit * below - eps, 1.0 - limit * F.col("_k")) * F.col("_total")
    known = known.withColumn(
        "_mode",
        F.when((F.col("_total") == 0) | (F.col("_n") * limit <= 1), "uniform")
        .when(F.try_divide("_max", "_total") <= limit, "plain")
        .otherwise("cut"),
    ).withColumn("_cut", F.when(F.col("_mode") == "cut", cutoff))
    # Next to nothing below the limit: every entry is cut down to the same value.
    known = known.withColumn(
        "_mode", F.when(F.col("_cut") < 0, "uniform").otherwise(F.col("_mode"))
    )
    number = df.select(*partition).distinct().count()
    joined = facts(df, known.select(*partition, "_mode", "_cut", "_n", "_total"), partition, number)
    # What is left after the cut: the cutoff may lie below entries that are not among the k.
    capped = F.when(F.col("_mode") == "cut", F.least(F.col(w), F.col("_cut"))).otherwise(F.col(w))
    left = (
        joined.filter(F.col("_mode") == "cut")
        .groupBy(*partition)
        .agg(F.sum(F.least(F.col(w), F.col("_cut"))).alias("_left"))
    )
    return (
        facts(joined, left, partition, number)
        .withColumn(
            "share",
            F.when(F.col("_mode") == "uniform", 1.0 / F.col("_n")).otherwise(
                F.try_divide(capped, F.coalesce("_left", "_total"))
            ),
        )
        .drop("_mode", "_cut", "_n", "_total", "_left")
    )


def reserve_share(
    df: DataFrame,
    partition: Sequence[str],
    key: str = "key",
    w: str = "w",
    reserved_key=0,
    fraction: float = 0.05,
) -> DataFrame:
    if fraction <= 0:
        return df
    f = min(fraction, 1.0)
    others = df.filter(F.col(key) != reserved_key).withColumn(w, F.col(w) * (1.0 - f))
    kind = df.schema[key].dataType
    added = df.select(*partition).distinct().select(
        *partition, F.lit(reserved_key).cast(kind).alias(key), F.lit(f).alias(w)
    )
    return others.select(*partition, key, w).unionByName(added)


def smooth_weights(
    df: DataFrame,
    publication: str = "publication",
    key: str = "key",
    w: str = "w",
    n: int = 5,
) -> DataFrame:
    """Moving average over the last ``n`` publications (absent = 0), then shares.

    Each weight is added to the ``n`` publications it takes part in, so nothing is
    densified and no window orders a key's history. Publications are few (one per
    cadence), so their numbering is a small table.
    """
    pubs = with_index(df.select(publication).distinct(), [], [publication], "_p")
    number = pubs.count()
    numbered = facts(df.filter(F.col(w) != 0), pubs, [publication], number)
    spread = numbered.select(
        key,
        w,
        F.explode(F.sequence(F.col("_p"), F.col("_p") + (n - 1))).alias("_p"),
    )
    sums = spread.groupBy("_p", key).agg(F.sum(w).alias("_s"))
    avg = facts(sums, pubs, ["_p"], number, "inner").select(
        publication, key, (F.col("_s") / F.least(F.col("_p"), F.lit(n))).alias("smoothed")
    )
    totals = avg.groupBy(publication).agg(F.sum("smoothed").alias("_t"))
    return (
        facts(avg, totals, [publication], number)
        .withColumn("share", F.try_divide("smoothed", "_t"))
        .drop("_t")
    )


def densify(
    weights: DataFrame, nodes: DataFrame, partition: Sequence[str], key: str, w: str = "w"
) -> DataFrame:
    """Every registered key per partition, absent = 0, scaled to sum 1.

    Unregistered keys are dropped; a partition without weight gives no rows.
    """
    known = weights.join(nodes.select(key), key)
    totals = known.groupBy(*partition).agg(F.sum(w).alias("_t")).filter(F.col("_t") > 0)
    # The result is partition x node by definition. Spread it over buckets of
    # nodes, so that the join has a key and no task builds all of it.
    buckets = max(1, -(-nodes.count() // 4096))
    ids = nodes.select(key, F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_b"))
    spread = totals.withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long")))
    )
    grid = spread.join(ids, "_b").drop("_b")
    on = [*partition, key]
    summed = known.groupBy(*on).agg(F.sum(w).alias("_w"))
    return grid.join(summed, on, "left").select(
        *on, (F.coalesce(F.col("_w"), F.lit(0.0)) / F.col("_t")).alias("share")
    )


def min_gap_select(
    df: DataFrame,
    partition: str,
    block: str,
    gap: int = C.MIN_GAP_BLOCKS,
    strict: bool = False,
) -> DataFrame:
    """``(partition, block)`` of the accepted publications.

    A block is accepted when at least ``gap`` blocks (``strict``: more) passed
    since the last accepted one. A publisher of any lifetime is cut into tiles, see
    :func:`~contest_analytics.operators.greedy.spaced`.
    """
    return spaced(df, partition, block, gap + 1 if strict else gap)


def event_summary(pings: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(participant, available, ok, latency)`` rows to one row per round."""
    return pings.groupBy(*key).agg(
        F.count_distinct("participant").alias("participants"),
        F.count_distinct(F.when(F.col("available"), F.col("participant"))).alias("available"),
        F.count_distinct(F.when(F.col("ok"), F.col("participant"))).alias("successful"),
        F.max("latency").alias("duration"),
    )


def round_stats(rounds: DataFrame, order: Sequence[str], n: int = 100) -> DataFrame:
    """Totals over the last ``n`` rounds; the top-n is taken per partition first."""
    last = rounds.orderBy(*[F.col(o).desc() for o in order]).limit(n)
    return last.agg(
        F.count(F.lit(1)).alias("total_rounds"),
        F.count_if("completed").alias("completed_rounds"),
        F.coalesce(F.avg(F.when(F.col("completed"), F.col("responses"))), F.lit(0.0)).alias(
            "avg_responses"
        ),
        F.coalesce(F.avg(F.when(F.col("completed"), F.col("duration"))), F.lit(0.0)).alias(
            "avg_duration"
        ),
        F.count_distinct("genre").alias("distinct_genres"),
    )


def reliability_stats(requests: DataFrame, key: str = "uid") -> DataFrame:
    ok = F.col("ok")
    won = F.count_if(ok)
    total = F.count_if(ok) + F.count_if(~ok)
    return requests.groupBy(key).agg(
        won.alias("success_count"),
        F.count_if(~ok).alias("failure_count"),
        F.when(total > 0, won / total).otherwise(1.0).alias("success_rate"),
        (
            F.coalesce(F.sum(F.when(ok, F.col("latency"))), F.lit(0.0))
            / F.greatest(won, F.lit(1))
        ).alias("avg_latency"),
        F.max(F.when(ok, F.col("ts"))).alias("last_success"),
        F.max(F.when(~ok, F.col("ts"))).alias("last_failure"),
    )


def routing_table(board: DataFrame, stats: DataFrame, nodes: DataFrame, key="uid") -> DataFrame:
    """Eligible contributors and their load-adjusted score."""
    joined = board.join(nodes.filter("serving").select(key), key, "left_semi").join(
        stats.select(key, "success_rate", "total_requests", "active"), key, "left"
    )
    active = F.coalesce(F.col("active"), F.lit(0))
    seasoned = F.coalesce(F.col("total_requests"), F.lit(0)) >= 3
    quality = F.col("ema") * F.when(
        seasoned, F.pow("success_rate", F.lit(C.ROUTE_FAILURE_POWER))
    ).otherwise(1.0)
    return joined.filter(
        (F.col("ema") >= C.ROUTE_MIN_EMA) & (active < C.ROUTE_MAX_ACTIVE)
    ).select(key, (quality / (1.0 + active * C.ROUTE_LOAD_PENALTY)).alias("effective"))


def route_candidates(
    requests: DataFrame,
    board: DataFrame,
    stats: DataFrame,
    nodes: DataFrame,
    tried: DataFrame | None = None,
    key: str = "uid",
    retries: int = C.ROUTE_RETRIES,
) -> DataFrame:
    """``(request, attempt, uid, effective)``: best contributors not tried yet.

    The order of contributors is the same for every request, so a request needs
    only the first ``retries + number it has tried`` of it. That short list is
    found once; requests never meet the whole board.
    """
    table = routing_table(board, stats, nodes, key)
    depth = retries
    if tried is not None:
        widest = tried.groupBy("request").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"))
        depth += int(widest.first()[0] or 0)
    best = table.orderBy(F.col("effective").desc(), F.col(key)).limit(depth)
    menu = best.agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("effective")).alias("neg"), F.col(key).alias(key)))
        ).alias("_menu")
    ).withColumn("_one", F.lit(1))
    asks = requests.select("request").withColumn("_one", F.lit(1)).join(menu, "_one").drop("_one")
    if tried is None:
        asks = asks.withColumn("_tried", F.array().cast("array<bigint>"))
    else:
        sets = tried.groupBy("request").agg(F.collect_set(F.col(key).cast("long")).alias("_tried"))
        asks = asks.join(sets, "request", "left").withColumn(
            "_tried", F.coalesce("_tried", F.array().cast("array<bigint>"))
        )
    left = F.slice(
        F.filter(F.col("_menu"), lambda m: ~F.array_contains(F.col("_tried"), m[key].cast("long"))),
        1,
        retries,
    )
    return asks.select("request", F.posexplode(left).alias("_i", "_m")).select(
        "request",
        (F.col("_i") + 1).alias("attempt"),
        F.col(f"_m.{key}").alias(key),
        (-F.col("_m.neg")).alias("effective"),
    )


def top_k_serving(board: DataFrame, nodes: DataFrame, k: int, seed: str, key="uid") -> DataFrame:
    """Best ``k`` serving contributors; without any score, ``k`` by hash order."""
    serving = nodes.filter("serving").select(key)
    pool = serving.join(board.select(key, "ema"), key, "left").withColumn(
        "ema", F.coalesce("ema", F.lit(0.0))
    )
    # Proven contributors sort first, so one top-2k list holds both answers.
    proven = F.col("ema") > 0
    mark = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    best = (
        pool.withColumn("_proven", proven)
        .withColumn("_mark", F.when(proven, "").otherwise(mark))
        .orderBy(F.col("_proven").desc(), F.col("ema").desc(), F.col("_mark"), F.col(key))
        .limit(k)
    )
    any_proven = F.max("_proven").over(W.partitionBy())  # over at most k rows
    return (
        best.withColumn("_any", any_proven)
        .filter(F.col("_proven") == F.col("_any"))
        .select(key, "ema")
    )


def fastest_response(df: DataFrame, request="request", key="contributor", t="elapsed") -> DataFrame:
    """One row per request: the valid response with the least time, then least key."""
    valid = df.filter(F.col("valid"))
    return valid.groupBy(request).agg(F.min(F.struct(t, key)).alias("_b")).select(
        request, F.col(f"_b.{key}").alias(key), F.col(f"_b.{t}").alias(t)
    )


def top_n_per_request(
    df: DataFrame, request="request", key="contributor", score="score", n_col="wanted"
) -> DataFrame:
    """Rows ranked within the requested number, with delivered and wanted counts."""
    w = W.partitionBy(request).orderBy(F.col(score).desc(), F.col(key))
    kept = df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col(n_col))
    counts = kept.groupBy(request).agg(F.count(F.lit(1)).alias("delivered"))
    return lookup(kept, counts, [request])


def merge_peer_scores(
    incoming: DataFrame, seen: DataFrame, registry: DataFrame, since, self_id, order=("ts", "id")
) -> DataFrame:
    """New valid peer scores, each id once; feed the result to :func:`ema`."""
    fresh = incoming.filter(
        (F.col("ts") >= since)
        & (F.col("source") != self_id)
        & F.col("uid").isNotNull()
        & F.col("score").isNotNull()
    )
    once = fresh.dropDuplicates(["id"]).join(seen.select("id"), "id", "left_anti")
    return match_identity(once, registry)


def errors_last_hour(
    df: DataFrame, key: str, seconds: str, is_error: str, unique: str, span: int = 3600
) -> DataFrame:
    """Adds ``errors``: the key's errors later than ``span`` seconds ago, per event.

    Rows are cut into buckets as long as the span and copied into the next one, so
    a frame never needs more than two buckets of a key.
    """
    bucket = F.floor(F.col(seconds) / span)
    copies = F.explode(
        F.array(
            F.struct(bucket.alias("b"), F.lit(True).alias("own")),
            F.struct((bucket + 1).alias("b"), F.lit(False).alias("own")),
        )
    )
    spread = df.withColumn("_c", copies).select(
        *df.columns, F.col("_c.b").alias("_b"), F.col("_c.own").alias("_own")
    )
    spread = spread.filter(F.col("_own") | F.col(is_error))
    w = W.partitionBy(key, "_b").orderBy(seconds).rangeBetween(-(span - 1), 0)
    return (
        spread.withColumn("errors", F.count_if(F.col(is_error)).over(w))
        .filter("_own")
        .drop("_b", "_own")
    )


def top_by_incentive(nodes: DataFrame, n: int, key: str = "uid") -> DataFrame:
    return nodes.filter("serving").orderBy(F.col("incentive").desc(), F.col(key)).limit(n)
