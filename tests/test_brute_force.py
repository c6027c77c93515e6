"""Operators that SQL expresses badly, against plain Python on small inputs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contest_analytics.operators import allocation, autocorrelation, boundaries, composite, embeddings, gates, greedy
from contest_analytics.operators import leaderboard as lb
from contest_analytics.operators import preference as pf
from contest_analytics.operators import series_values as sv
from contest_analytics.operators import series_vectors as ss


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_word_error_rate(spark):
    r = random.Random(1)
    words = ["a", "b", "c", "d"]
    rows = [
        (i, " ".join(r.choices(words, k=r.randint(0, 7))), " ".join(r.choices(words, k=r.randint(0, 7))))
        for i in range(60)
    ]
    out = gates.word_error_rate(spark.createDataFrame(rows, "i int, ref string, hyp string"))
    got = {x["i"]: x["wer"] for x in out.collect()}
    for i, ref, hyp in rows:
        n = len(ref.split())
        want = (0.0 if not hyp.split() else 1.0) if n == 0 else edit(ref.split(), hyp.split()) / n
        assert got[i] == pytest.approx(want)


def accepted(blocks, step):
    out = []
    for b in sorted(set(blocks)):
        if not out or b - out[-1] >= step:
            out.append(b)
    return out


def test_word_error_rate_of_long_pairs(spark, monkeypatch):
    """Pairs beyond the table take the other way, with the same result."""
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(60)}é" for _ in range(r.randrange(0, 180))) for _ in range(40)]
    rows = [(i, texts[i], texts[i - 1]) for i in range(40)] + [(40, None, "a"), (41, "a", None), (42, "", ""), (43, "a", "")]
    df = spark.createDataFrame(rows, "i int, ref string, hyp string").withColumn("words", F.lit(1))
    table = {x["i"]: x["wer"] for x in gates.word_error_rate(df).collect()}
    monkeypatch.setattr(gates, "TABLE_CELLS", 900)
    mixed = {x["i"]: x["wer"] for x in gates.word_error_rate(df).collect()}
    monkeypatch.setattr(gates, "TABLE_CELLS", -1)
    other = {x["i"]: x["wer"] for x in gates.word_error_rate(df).collect()}
    assert table == mixed == other and table[40] is None and table[41] is None and table[43] == 1.0
    for i in range(0, 40, 5):
        a, b = rows[i][1].split(), rows[i][2].split()
        assert table[i] == pytest.approx(edit(a, b) / len(a) if a else float(bool(b)))


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("span", [1, 600, 1 << 18])
def test_min_gap(spark, monkeypatch, strict, span):
    monkeypatch.setattr(greedy, "SPAN", span)
    monkeypatch.setattr(greedy, "GROUP", 4)
    r = random.Random(2)
    rows = [(p, r.randint(-500, 6000)) for p in range(4) for _ in range(200)] + [(9, 5), (9, 5), (9, None), (None, 3), (8, None)]
    out = lb.min_gap_select(spark.createDataFrame(rows, "p int, b long"), "p", "b", 115, strict)
    got = sorted(((x["p"], x["b"]) for x in out.collect()), key=str)
    want = [
        (p, b) for p in (0, 1, 2, 3, 9, None)
        for b in accepted([b for q, b in rows if q == p and b is not None], 116 if strict else 115)
    ]
    assert got == sorted(want, key=str)


def test_min_gap_of_a_long_life(spark):
    """A million blocks of one publisher, in many tiles."""
    blocks = spark.range(1_000_000).selectExpr("'one' as p", "id * 3 + pmod(xxhash64(id), 3) as b")
    held = {r["b"] for r in blocks.select("b").collect()}
    got = [r["b"] for r in lb.min_gap_select(blocks, "p", "b", 115).orderBy("b").collect()]
    assert got == accepted(held, 115) and max(held) > 10 * greedy.SPAN


def notes(values, apart=0.5):
    kept = [values[0]]
    for v in values[1:]:
        if abs(v - kept[-1]) >= apart:
            kept.append(v)
    return kept


@pytest.mark.parametrize("large", [False, True])
def test_thinned_series(spark, request, monkeypatch, large):
    if large:
        request.getfixturevalue("hot")
        monkeypatch.setattr(greedy, "GROUP", 5)
    r = random.Random(3)
    walks = {}
    for s in range(3):
        v, walk = 0.0, []
        for _ in range(900):
            v += r.gauss(0, 0.3 + 0.3 * s)
            walk.append(v)
        walks[s] = walk
    walks[3] = [i * 0.1 for i in range(700)]  # steady climb: every row is a new extreme
    walks[4] = [i * 0.003 for i in range(700)]  # so slow that the phase of the entry stays open
    walks[5] = [2.0] * 300
    walks[6] = [0.25 * (i % 3) for i in range(300)]  # differences of exactly one half
    walks[7] = [1.0]
    rows = [(s, i, v) for s, w in walks.items() for i, v in enumerate(w)]
    df = spark.createDataFrame(rows, "s int, i int, v double")
    out = greedy.thinned(df, "s", ["i"], "v").orderBy("s", "idx").collect()
    for s, walk in walks.items():
        got = [(x["idx"], x["note"]) for x in out if x["s"] == s]
        assert [v for _, v in got] == notes(walk) and all(walk[i - 1] == v for i, v in got)


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.one_of(st.integers(-6, 6).map(lambda n: n / 4), st.floats(-2, 2)), min_size=1, max_size=60),
    st.integers(1, 9),
    st.one_of(st.just(-np.inf), st.floats(-3, 3)),
)
def test_summaries_of_tiles_combine(values, size, entry):
    v = np.array(values)
    summary, at = None, 0
    while at < len(v):
        tile = greedy.Summary.of(v[at : at + size], at + 1, 0.5)
        summary = tile if summary is None else summary.then(tile, 0.5)
        at += size
    first = next((i for i, x in enumerate(values, 1) if abs(x - entry) >= 0.5), np.inf)
    exit_value = entry if first == np.inf else notes(values[first - 1 :])[-1]
    got = summary.enter(np.array([entry]), 0.5)
    assert (got[0][0], got[1][0]) == (first, exit_value)


def test_successors_of_long_rows():
    rng = np.random.default_rng(5)
    for scale in (0.001, 0.05, 3):
        v = np.cumsum(rng.normal(0, scale, 3000))
        ends = np.repeat([1000, 2100, 3000], [1000, 1100, 900])
        follow = greedy.successors(v, ends, 0.5)
        for i in range(0, 3000, 7):
            want = next((j for j in range(i + 1, ends[i]) if abs(v[j] - v[i]) >= 0.5), 3000)
            assert follow[i] == want


def plain_peaks(x, distance, prominence):
    tops, i, n = [], 1, len(x)
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if j < n - 1 and x[j + 1] < x[i]:
                tops.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    keep = dict.fromkeys(tops, True)
    for t in sorted(tops, key=lambda t: (x[t], t), reverse=True):
        if keep[t]:
            for u in tops:
                if u != t and abs(u - t) < distance:
                    keep[u] = False
    out = []
    for t in tops:
        if not keep[t]:
            continue
        lo = t
        left = x[t]
        while lo > 0 and x[lo - 1] <= x[t]:
            lo -= 1
            left = min(left, x[lo])
        hi, right = t, x[t]
        while hi < n - 1 and x[hi + 1] <= x[t]:
            hi += 1
            right = min(right, x[hi])
        if x[t] - max(left, right) >= prominence:
            out.append(t)
    return out


@pytest.mark.parametrize(("gap", "prominence", "levels"), [(1, 0.2, 4), (5, 0.3, 5), (4, 0.0, 9), (9, 0.45, 40)])
def test_peaks_across_tiles(spark, monkeypatch, gap, prominence, levels):
    """Plateaus, walks and chains of tops that are longer than a tile and a group of tiles."""
    monkeypatch.setattr(boundaries, "GROUP", 2)
    rng = np.random.default_rng(gap)
    size, lines = 2 * gap + 5, {}
    for s in range(6):
        steps = rng.integers(-1, 2, 400) if s < 3 else np.repeat(rng.integers(-2, 3, 40), 10)
        lines[s] = np.round(np.abs((np.cumsum(steps) % (2 * levels)) - levels) / levels, 6)
    lines[6] = np.arange(300) / 300 + 0.5 * (np.arange(300) % 3 == 0)  # tops in one long chain
    lines[7] = np.full(50, 0.25)
    rows = []
    for s, v in lines.items():
        marks = boundaries.marks_of(v)
        rows += [(s, i + 1, len(v), i // size, float(x), int(marks[i])) for i, x in enumerate(v)]
    line = spark.createDataFrame(rows, "s int, idx long, _size long, _tile long, v double, mark int")
    monkeypatch.setattr(boundaries, "TILE_ROWS", size)
    spark.conf.set("contest_analytics.tileRows", str(size))
    tops = boundaries._spread_out(boundaries._tops(line, "s"), "s", gap, "int")
    got = {(r["s"], r["idx"]) for r in boundaries._prominent(line, tops, "s", prominence, size, "int").collect()}
    spark.conf.unset("contest_analytics.tileRows")
    want = {(s, p + 1) for s, v in lines.items() for p in plain_peaks(v.tolist(), gap, prominence)}
    assert got == want and len(want) > 20


def plain_boundaries(vectors, k, gap, prominence):
    u = np.array([v / (np.linalg.norm(v) + 1e-8) for v in vectors])
    n = len(u)
    sim = u @ u.T
    k = min(k, n // 2)
    nov = np.zeros(n)
    for i in range(k, n - k):
        same = (sim[i - k : i, i - k : i].mean() + sim[i : i + k, i : i + k].mean()) / 2
        cross = (sim[i - k : i, i : i + k].mean() + sim[i : i + k, i - k : i].mean()) / 2
        nov[i] = max(same - cross, 0)
    w = max(3, k // 2)
    smooth = [
        sum(nov[j] if 0 <= j < n else 0 for j in range(i - w // 2, i - w // 2 + w)) / w
        for i in range(n)
    ]
    return [p + 1 for p in plain_peaks(smooth, gap, prominence) if p > 0]


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize("k", [3, 8])
def test_section_boundaries(spark, request, large, k):
    if large:
        request.getfixturevalue("hot")
    rng = np.random.default_rng(4)
    rows, data = [], {}
    for s, n in enumerate([5, 40, 200]):
        base = np.repeat(rng.random((n // 9 + 1, 6)), 9, axis=0)[:n]
        data[s] = base + 0.3 * rng.random((n, 6))
        rows += [(s, i, [float(x) for x in v]) for i, v in enumerate(data[s])]
    df = spark.createDataFrame(rows, "s int, i int, vec array<double>")
    out = ss.section_boundaries(df, "s", ["i"], k=k, min_gap=5, prominence=0.01).collect()
    for s, v in data.items():
        got = sorted(x["idx"] for x in out if x["s"] == s)
        assert got == plain_boundaries(v, k, 5, 0.01)


def test_frechet_of_itself_is_small_and_of_a_cluster_larger(spark):
    rng = np.random.default_rng(5)
    wide = rng.normal(size=(50, 8))
    tight = np.ones(8) + 0.01 * rng.normal(size=(50, 8))
    rows = [("wide", i, [float(x) for x in v]) for i, v in enumerate(wide)]
    rows += [("tight", i, [float(x) for x in v]) for i, v in enumerate(tight)]
    rows += [("few", i, [float(x) for x in v]) for i, v in enumerate(wide[:9])]
    df = spark.createDataFrame(rows, "who string, i int, vec array<double>")
    ref = embeddings.fit_distribution(df.filter("who = 'wide'"))
    u = wide / np.linalg.norm(wide, axis=1, keepdims=True)
    row = ref.first()
    assert np.allclose(row["mean"], u.mean(0)) and np.allclose(
        row["cov"], np.cov(u, rowvar=False) + 1e-6 * np.eye(8)
    )
    got = {r["who"]: r["distance"] for r in embeddings.frechet_distance(df, ref, "who", ["i"]).collect()}
    assert got["wide"] == pytest.approx(0.0, abs=1e-6)
    assert got["tight"] > 0.5
    assert got["few"] is None
    none = embeddings.frechet_distance(df, ref.limit(0), "who", ["i"]).collect()
    assert all(r["distance"] is None for r in none)


def test_frechet_matches_eigenvalues_of_the_product():
    rng = np.random.default_rng(6)
    a, b = (np.cov(rng.normal(size=(30, 5)), rowvar=False) for _ in range(2))
    roots = np.sqrt(np.linalg.eigvals(a @ b).real.clip(0)).sum()
    m = rng.normal(size=5)
    want = float(m @ m + np.trace(a) + np.trace(b) - 2 * roots)
    assert embeddings.frechet(m, a, np.zeros(5), b) == pytest.approx(want)


def test_preference_is_learned(spark):
    rng = np.random.default_rng(7)
    taste = rng.normal(size=6)
    rows = []
    for i in range(300):
        a, b = rng.normal(size=6), rng.normal(size=6)
        if a @ taste < b @ taste:
            a, b = b, a
        rows.append((f"{i:04d}", [float(x) for x in a], [float(x) for x in b]))
    df = spark.createDataFrame(
        rows, "pair_id string, preferred_vec array<double>, rejected_vec array<double>"
    )
    split = pf.split_pairs(df)
    assert split.filter("is_validation").count() == 60
    w = pf.model_weights(pf.fit_preference(split.filter("not is_validation")))
    scored = pf.preference_score(split.filter("is_validation"), w, "preferred_vec")
    scored = scored.withColumnRenamed("preference", "score_preferred")
    scored = pf.preference_score(scored, w, "rejected_vec").withColumnRenamed(
        "preference", "score_rejected"
    )
    assert pf.pairwise_metrics(scored).first()["accuracy"] > 0.9
    assert pf.preference_score(df.limit(1), None, "preferred_vec").first()["preference"] == 0.5


def test_too_few_pairs(spark):
    with pytest.raises(ValueError):
        pf.require_pairs(spark.range(9))
    with pytest.warns(UserWarning):
        assert pf.require_pairs(spark.range(20)) == 20


def capped(w, limit, eps=1e-7):
    """Entries below the limit once all above them are lifted down to them set the cutoff."""
    total = sum(w)
    if total == 0 or len(w) * limit <= 1:
        return [1 / len(w)] * len(w)
    if max(w) / total <= limit:
        return [x / total for x in w]
    shares = [x / total for x in w]
    lifted = {e: sum(min(e, x) for x in shares) + eps for e in shares}
    below = [e for e in shares if e / lifted[e] < limit]
    cut = total * (limit * sum(below) - eps) / (1 - limit * (len(w) - len(below)))
    if cut < 0:
        return [1 / len(w)] * len(w)
    return [min(x, cut) / sum(min(y, cut) for y in w) for x in w]


UNDER_CUT = [99.0, 8.147, 15.082, 22.785, 27.738, 27.055, 70.841, 96.078, 0.0, 1.0, 1.0]


@settings(max_examples=6, deadline=None)
@example([UNDER_CUT], 0.1)
@example([[76.0 if x == 0 else x for x in UNDER_CUT]], 0.1)
@given(
    st.lists(
        st.lists(st.floats(0, 100).map(lambda x: round(x, 3)), min_size=1, max_size=30),
        min_size=1,
        max_size=4,
    ),
    st.sampled_from([0.05, 0.1, 0.3]),
)
def test_caps(spark, groups, limit):
    rows = [(p, i, w) for p, ws in enumerate(groups) for i, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "p int, key int, w double")
    got = {(x["p"], x["key"]): x["share"] for x in lb.cap_weights(df, ["p"], limit=limit).collect()}
    for p, ws in enumerate(groups):
        mine = [got[(p, i)] for i in range(len(ws))]
        assert sum(mine) == pytest.approx(1.0)
        if len(ws) * limit > 1 and sum(ws) > 0 and np.count_nonzero(ws) * limit > 1:
            assert max(mine) <= limit + 1e-5
        if abs(np.count_nonzero(ws) * limit - 1) > 1e-9:
            assert mine == pytest.approx(capped(ws, limit), abs=1e-8)


def test_cap_when_nothing_is_below(spark):
    rows = [("p", i, 0.0) for i in range(10)] + [("p", 10, 1.0)]
    out = lb.cap_weights(spark.createDataFrame(rows, "p string, key int, w double"), ["p"], limit=0.1)
    assert [r["share"] for r in out.collect()] == pytest.approx([1 / 11] * 11)


@settings(max_examples=4, deadline=None)
@given(st.integers(1, 40), st.integers(1, 7))
def test_allocation_properties(spark, n, members):
    ids = spark.range(n).withColumnRenamed("id", "uid")
    parts = allocation.partition_ids(ids, "uid", members, "1080")
    if n >= members:
        row = allocation.audit_partition(parts, ids, "uid").first()
        assert row["disjoint"] and row["complete"] and row["balanced"]
    who = spark.createDataFrame([(i, 100 + i) for i in range(members)], "member long, uid long")
    pids = parts.withColumnRenamed("uid", "id")
    rows = allocation.assignments(pids, who, members, members, pids, "id").collect()
    for m in range(members):
        assert sorted(r["id"] for r in rows if r["member"] == m) == list(range(n))


@settings(max_examples=4, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=25))
def test_tiers_share_everything(spark, scores):
    rows = [("c", i, float(s), 1) for i, s in enumerate(scores)]
    board = spark.createDataFrame(rows, "contest string, contributor int, ema double, rounds int")
    out = lb.tiered_weights(board, ["contest"]).collect()
    positive = [r for r in out if r["ema"] > 0 and r["ema"] ** 2 > 0]
    if positive:
        assert sum(r["weight"] for r in out) == pytest.approx(1.0)
    ranks = sorted(out, key=lambda r: r["rank"])
    assert [r["ema"] for r in ranks] == sorted((r["ema"] for r in out), reverse=True)


def test_missing_phase_scores_zero(spark):
    rows = [(1, 0.5, 1.0, 1.0, 1.0, 1.0), (2, None, 1.0, 1.0, 1.0, 1.0), (3, 0.9, 1.0, None, 1.0, 1.0)]
    df = spark.createDataFrame(
        rows,
        "i int, composite double, duration_penalty double, artifact_penalty double,"
        " fad_penalty double, fingerprint_penalty double",
    )
    got = {r["i"]: r["final_reward"] for r in composite.final_reward(df, bonuses=()).collect()}
    assert got == {1: 0.5, 2: 0.0, 3: 0.0}


def test_key_and_pair_are_order_free(spark):
    df = spark.createDataFrame([("x", "y"), ("y", "x")], "a string, b string")
    ids = {r[0] for r in df.select(pf.pair_id("a", "b")).collect()}
    assert len(ids) == 1 and len(ids.pop()) == 12


def test_row_order_and_partitions_do_not_matter(spark):
    rows = [(k, i, (i * 37 % 11) / 11) for k in range(5) for i in range(40)]
    a = spark.createDataFrame(rows, "k int, i int, x double")
    b = a.orderBy(F.rand(1)).repartition(7)
    one, two = (
        {r["k"]: round(r["ema"], 12) for r in lb.ema(d, ["k"], ["i"], "x").collect()} for d in (a, b)
    )
    assert one == two
    state = 0.0
    for i in range(40):
        state = 0.2 * (i * 37 % 11) / 11 + 0.8 * state
    assert one[3] == pytest.approx(state)
    assert math.isclose(sum(one.values()), 5 * one[0], rel_tol=1e-9)


def test_lag_sums_of_long_series(spark, monkeypatch):
    """Whole series, and longer ones in strips, against the plain sums."""
    rng = np.random.default_rng(3)
    series = {s: rng.normal(size=(n, 1)) for s, n in enumerate([1, 2, 9, 64, 333, 1000])}
    rows = [(s, i, float(v[0]), v.tolist()) for s, x in series.items() for i, v in enumerate(x)]
    wide = {s: rng.normal(size=(n, 3)) for s, n in enumerate([5, 40, 257])}
    vectors = [(s, i, 0.0, v.tolist()) for s, x in wide.items() for i, v in enumerate(x)]

    def check(data, held, column):
        df = spark.createDataFrame(held, "s int, i int, x double, v array<double>")
        out = autocorrelation.lag_sums(df, "s", ["i"], column, lambda n: (1, n - 1))
        got = {(r["s"], r["lag"]): (r["_sum"], r["_n"]) for r in out.collect()}
        want = {
            (s, lag): (float((x[lag:] * x[: len(x) - lag]).sum()), len(x)) for s, x in data.items() for lag in range(1, len(x) - 1)
        }
        assert got.keys() == want.keys()
        assert all(got[k] == (pytest.approx(want[k][0], abs=1e-9), want[k][1]) for k in want)

    check(series, rows, "x")
    check(wide, vectors, "v")
    monkeypatch.setattr(autocorrelation, "STRIP", 128)
    spark.conf.set("contest_analytics.wholeSeries", "50")
    check(series, rows, "x")
    check(wide, vectors, "v")
    spark.conf.unset("contest_analytics.wholeSeries")
