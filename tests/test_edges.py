"""Silent, constant, single-row and empty series go through every statistic."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from contest_analytics.functions import curves
from contest_analytics.operators import gates
from contest_analytics.operators import leaderboard as lb
from contest_analytics.operators import lookups as lk
from contest_analytics.operators import series_values as sv
from contest_analytics.operators import series_vectors as ss

BANDS = [(0, 4), (4, 8), (8, 12)]

SERIES = [("zero", [0.0] * 20), ("flat", [3.0] * 20), ("one", [1.0]), ("two", [1.0, 2.0])]

VALUES = {
    "level": lambda d: sv.level(d, "s"),
    "clipping": lambda d: sv.clipping(d, "s", ["i"]),
    "dynamic_range": lambda d: sv.dynamic_range(d, "s"),
    "event_density": lambda d: sv.event_density(d, "s"),
    "interval_regularity": lambda d: sv.interval_regularity(d, "s", unique="i"),
    "sliding_loudness": lambda d: sv.sliding_loudness(d, "s", ["i"]),
    "block_jitter": lambda d: sv.block_jitter(d, "s", ["i"]),
    "step_expressiveness": lambda d: sv.step_expressiveness(d, "s", ["i"]),
    "interval_mix": lambda d: sv.interval_mix(d, "s", ["i"]),
    "contour": lambda d: sv.contour(d, "s", ["i"]),
    "half_decay": lambda d: sv.half_decay(d, "s", ["i"]),
    "entropy_motif": lambda d: sv.entropy_motif(d, "s", ["i"]),
    "arc_fit": lambda d: sv.arc_fit(d, "s", ["i"]),
    "two_channel": lambda d: sv.two_channel(d, "s"),
    "quartile_contrast": lambda d: sv.quartile_contrast(d, "s", unique="i"),
    "cv_consistency": lambda d: sv.cv_consistency(d, "s"),
    "small_move_share": lambda d: sv.small_move_share(d, "s", ["i"]),
    "active_expressiveness": lambda d: sv.active_expressiveness(d, "s", ["i"]),
    "step_jitter": lambda d: sv.step_jitter(d, "s", ["i"]),
    "chunk_repetition": lambda d: ss.chunk_repetition(d, "s", ["i"], chunk=4),
}

VECTORS = {
    "discontinuity": lambda d: ss.discontinuity(d, "s", ["i"]),
    "flux_consistency": lambda d: ss.flux_consistency(d, "s", ["i"]),
    "self_similarity_share": lambda d: ss.self_similarity_share(d, "s", ["i"]),
    "holes": lambda d: ss.holes(d, "s"),
    "half_similarity": lambda d: ss.half_similarity(d, "s", ["i"]),
    "template_clarity": lambda d: ss.template_clarity(ss.classify_template(d), "s"),
    "transition_quality": lambda d: ss.transition_quality(ss.classify_template(d), "s", ["i"]),
    "profile_argmax": lambda d: ss.profile_argmax(d, "s"),
    "phrase_coherence": lambda d: ss.phrase_coherence(d, "s", ["i"], beats=4),
    "progression": lambda d: ss.progression(d, "s", ["i"]),
    "segment_contrast": lambda d: ss.segment_contrast(d, "s", ["i"]),
    "sections": lambda d: ss.sections(d, "s", ["i"], k=4),
    "edge_sections": lambda d: ss.edge_sections(d, "s", ["i"], marks(d)),
    "boundary_ratio": lambda d: ss.boundary_ratio(d, "s", ["i"], marks(d)),
    "band_balance": lambda d: ss.band_balance(d, "s", BANDS),
    "band_entropy": lambda d: ss.band_entropy(d, "s", BANDS),
    "band_contrast": lambda d: ss.band_contrast(d, "s", BANDS),
    "band_difference": lambda d: ss.band_difference(
        d.withColumn("left", F.col("vec")).withColumn("right", F.col("vec")), "s", BANDS
    ),
    "spectral_tilt": lambda d: ss.spectral_tilt(d, "s"),
    "active_share": lambda d: ss.active_share(d, "s"),
    "band_share": lambda d: ss.band_share(d, "s", 6),
    "band_ratio": lambda d: ss.band_ratio(d, "s", (2, 4), (0, 8)),
    "flatness": lambda d: ss.flatness(d, "s", 0, 6),
}


def marks(df):
    return df.filter("i in (5, 12)").select("s", (F.col("i") + 1).cast("long").alias("idx"))


def check(out, names):
    rows = out.collect()
    assert sorted(r["s"] for r in rows) == sorted(names)
    for r in rows:
        for c in ("score", "bonus", "presence", "transitions", "count_score"):
            if c in r and r[c] is not None:
                assert 0.0 <= r[c] <= 1.0


@pytest.mark.parametrize("name", sorted(VALUES))
def test_values(spark, name):
    rows = [(s, i, float(i), v, v) for s, vs in SERIES for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "s string, i int, t double, x double, y double")
    out = VALUES[name](df)
    pitch = name in {"contour", "entropy_motif", "interval_mix"}
    voiced = name in {"step_jitter"}
    names = [s for s, vs in SERIES if not ((pitch or voiced) and s == "zero")]
    check(out, names)


@pytest.mark.parametrize("name", sorted(VECTORS))
def test_vectors(spark, name):
    rows = [(s, i, v, [v] * 12) for s, vs in SERIES for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "s string, i int, x double, vec array<double>")
    check(VECTORS[name](df), [s for s, _ in SERIES])


def test_missing_values_stay_missing(spark):
    row = spark.range(1).select(
        curves.clip(F.lit(None).cast("double")).alias("a"),
        curves.sanitize_score(F.lit(None).cast("double")).alias("b"),
        gates.duration_penalty(F.lit(3.0), F.lit(0.0)).alias("c"),
        gates.speed_score(F.lit(None).cast("double"), F.lit(5.0)).alias("d"),
        lk.tempo_match(F.lit(0.0), F.lit(0.0)).alias("e"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"]) == (None, None, 1.0, 0.5, 0.5)


def test_gate_breakpoints(spark):
    pairs = [(10.0, 10.0, 1.0), (12.0, 10.0, 1.0), (13.5, 10.0, 0.5), (15.0, 10.0, 0.0), (4.0, 10.0, 0.0)]
    df = spark.createDataFrame(pairs, "a double, r double, want double")
    for r in df.withColumn("got", gates.duration_penalty("a", "r")).collect():
        assert r["got"] == pytest.approx(r["want"])
    speeds = [(5.0, 10.0, 1.0), (10.0, 10.0, 1.0), (30.0, 10.0, 0.3), (60.0, 10.0, 0.0), (45.0, 10.0, 0.15)]
    df = spark.createDataFrame(speeds, "t double, d double, want double")
    for r in df.withColumn("got", gates.speed_score("t", "d")).collect():
        assert r["got"] == pytest.approx(r["want"])


def test_empty_boards(spark):
    none = spark.createDataFrame([], "contest string, contributor int, ema double, rounds int")
    assert lb.snapshot(none, ["contest"]).count() == 0
    zero = spark.createDataFrame([("c", 1, 0.0, 3)], none.schema)
    row = lb.snapshot(zero, ["contest"]).first()
    assert (row["rank"], row["tier"], row["weight"]) == (1, "elite", 0.0)
    uniform = lb.normalize_weights(
        spark.createDataFrame([("p", 1, -1.0), ("p", 2, 0.0)], "p string, key int, w double"), ["p"]
    )
    assert [r["share"] for r in uniform.collect()] == [0.5, 0.5]


@pytest.mark.parametrize("alpha", [1e-5, 1e-4, 0.2, 0.95, 1.0])
@pytest.mark.parametrize("plan", ["plain", "hot"])
def test_trajectory_ends_where_the_fold_ends(spark, request, plan, alpha):
    if plan == "hot":
        spark.conf.set("contest_analytics.hotRows", "5000")
    try:
        events = spark.range(40_000).selectExpr("1 as key", "id as n", "pmod(hash(id), 1000) / 1e3 as x")
        path = lb.ema_trajectory(events, ["key"], ["n"], "x", alpha, 0.3)
        last = path.filter("n = 39999").first()["ema"]
        fold = lb.ema(events, ["key"], ["n"], "x", alpha, 0.3).first()["ema"]
        assert last == pytest.approx(fold, abs=1e-12)
        third = path.filter("n = 2").first()
        want = 0.3
        for row in events.filter("n <= 2").orderBy("n").collect():
            want = (1 - alpha) * want + alpha * row.x
        assert third["ema"] == pytest.approx(want, abs=1e-12)
    finally:
        spark.conf.unset("contest_analytics.hotRows")


def test_top_n_has_no_cap(spark):
    rows = spark.range(12).selectExpr("1 as request", "id as contributor", "id * 1e0 as score", "8 as wanted")
    out = lb.top_n_per_request(rows).collect()
    assert sorted(r.rank for r in out) == list(range(1, 9)) and {r.delivered for r in out} == {8}


def test_planning_measures_each_source_once(spark, sf_dir, monkeypatch):
    import __spark_entry__ as entry
    from contest_analytics import scale

    measured = []
    for module in (scale, lb):
        one = module.is_hot
        monkeypatch.setattr(module, "is_hot", lambda df, keys, f=one: measured.append(keys) or f(df, keys))
    for name in ("leaderboard_snapshot", "tiered_weights", "leaderboard_summary", "population_quality"):
        entry.queries()[name](spark, sf_dir)
    assert measured == []
