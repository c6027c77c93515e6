"""Product codes and hard negatives against plain loops."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contest_analytics.llm import hard_negatives as hn
from contest_analytics.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, zone int, slice int, vec int, norm int"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    """Rows (id, vector, label), with extra columns whose names clash."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5) for r in rows], SCHEMA)


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """The same rule, one part and entry at a time."""
    kept = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and abs(x) < 131_072 for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    data = []
    for _, v, _ in kept:
        whole = [math.floor(256 * float(np.float32(x))) for x in v]
        data.append(whole + [0] * (parts * width - len(whole)))
    order = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0], data[n]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(data[n], p) for n in order] for p in range(parts)]

    def nearest(v, book):
        gaps = [sum((a - b) ** 2 for a, b in zip(v, w, strict=True)) for w in book]
        return min(range(len(book)), key=lambda e: (gaps[e], e)), min(gaps)

    for _ in range(rounds):
        for p, book in enumerate(books):
            held = [nearest(cut(v, p), book)[0] for v in data]
            for e in range(len(book)):
                own = [cut(v, p) for v, h in zip(data, held, strict=True) if h == e]
                if own:
                    book[e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for (i, _, y), v in zip(kept, data, strict=True):
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append([i, "".join(f"{e:02x}" for e, _ in found), sum(g for _, g in found), y])
    sums = {}
    for _, _, error, y in out:
        sums[y] = sums.get(y, 0) + error
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return sorted(((i, c, e, sums[y], digest) for i, c, e, y in out), key=repr)


def got_codes(frame, **options):
    out = vc.compress(frame, **options)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize(("dims", "block"), [(64, 16_384), (32, 50), (20, 7)])
def test_codes_by_plain_rule(spark, monkeypatch, dims, block):
    monkeypatch.setattr(vc, "ROWS", block)
    rng = np.random.default_rng(dims)
    data = rng.standard_normal((260, dims)).astype(np.float32) / 8
    data[100:190] = data[100]  # a third of the rows are equal
    data[190:220] += np.float32(3)  # far from the rest: whole nodes
    rows = [(int(i), v.tolist(), int(i) % 4 if i % 5 else None) for i, v in enumerate(data)]
    assert got_codes(table(spark, rows).repartition(3)) == plain_codes(rows)


def test_codes_of_odd_rows(spark):
    rows = [
        (3, [0.5, -0.25, 1.0], 1), (1, [0.001, -0.001], None), (1, [0.001, -0.001], None), (2, None, 1),
        (4, [NAN, 1.0], 1), (5, [1.0, INF], 1), (6, [None, 1.0], 1), (7, [], 2), (None, [0.75], 2), (8, [2e5], 2),
    ]
    assert got_codes(table(spark, rows)) == plain_codes([r for r in rows if r[0] not in (4, 5, 6, 8)])
    assert got_codes(table(spark, rows), parts=2, entries=2) == plain_codes(
        [r for r in rows if r[0] not in (4, 5, 6, 8)], parts=2, entries=2
    )
    assert got_codes(table(spark, [(2, None, 1)])) == [] and got_codes(table(spark, [])) == []
    with pytest.raises(ValueError):
        vc.compress(table(spark, rows), entries=257)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 90), st.integers(1, 40), st.integers(1, 5), st.sampled_from([2, 9, 3000]))
def test_walk_finds_the_nearest_entry(seed, rows, entries, width, spread):
    rng = np.random.default_rng(seed)
    parts = rng.integers(-spread, spread, (2, rows, width)).astype(np.int32)
    book = rng.integers(-spread, spread, (2, entries, width)).astype(np.int32)
    gaps = ((parts[:, :, None].astype(int) - book[:, None]) ** 2).sum(-1)
    trees = [vc.entry_tree(b) for b in book]
    codes = vc.codes_of(parts, trees, leaf=4)
    assert (codes == gaps.argmin(-1)).all()
    sums, sizes = vc.sums_of(parts, trees, entries, leaf=4)
    for p in range(2):
        for e in range(entries):
            own = parts[p, codes[p] == e].astype(int)
            assert sizes[p, e] == len(own) and (sums[p, e] == own.sum(axis=0)).all()


def test_nodes_far_apart_are_assigned_whole():
    """Clusters around the entries: most parts go with a node, without a distance of their own."""
    rng = np.random.default_rng(2)
    book = rng.integers(-4000, 4000, (1, 64, 4)).astype(np.int32)
    parts = (book[:, rng.integers(0, 64, 8192)] + rng.integers(-9, 9, (1, 8192, 4))).astype(np.int32)
    forest = vc.grow(parts)
    whole = sum(
        int(forest.sizes[level][tree, place].sum())
        for level, (tree, place, _) in vc.walk(parts, forest, [vc.entry_tree(book[0])])
        if level is not None
    )
    assert whole > 0.5 * 8192


def plain_negatives(rows, positives=5, negatives=3):
    best = {}
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not abs(x) < 131_072 for x in v):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in v]
        best[i] = min(best.get(i, (str(y), whole)), (str(y), whole))
    longest = max((len(w) for _, w in best.values()), default=0)
    names = sorted(best)
    data = np.array([best[i][1] + [0] * (longest - len(best[i][1])) for i in names], object).reshape(len(names), -1)
    out = []
    for a, i in enumerate(names):
        if i % 50:
            continue
        scores = [int(s) for s in data @ data[a]] if longest else [0] * len(names)
        order = sorted((n for n in range(len(names)) if n != a), key=lambda n: (-scores[n], names[n]))
        for p in [n for n in order if best[names[n]][0] == best[i][0]][:positives]:
            fits = [
                n for n in order
                if best[names[n]][0] != best[i][0] and 50 * scores[p] <= 100 * scores[n] <= 95 * scores[p]
            ]
            for rank, n in enumerate(fits[:negatives], 1):
                out.append((i, names[p], rank, names[n], scores[p], scores[n]))
    return sorted(out)


def got_negatives(frame):
    out = hn.mine(frame, F.col("vec_id") % 50 == 0, F.col("label"))
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert out.columns == names
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize(("sample", "cells", "block"), [(2000, 1 << 21, 4096), (8, 24 * 60, 3), (0, 24 * 5000, 2)])
def test_negatives_by_plain_rule(spark, monkeypatch, sample, cells, block):
    monkeypatch.setattr(hn, "CELLS", cells)
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn.frame, "__defaults__", (sample, 6))
    rng = np.random.default_rng(block)
    centres = rng.standard_normal((12, 24))
    data = (centres[rng.integers(0, 12, 900)] + rng.standard_normal((900, 24)) * 0.5).astype(np.float32)
    data[300:600] = data[300] * np.float32(0.5)  # a third of the rows are equal: ties
    data[7] = 0
    rows = [(int(i), v.tolist(), int(rng.integers(0, 5))) for i, v in enumerate(data)]
    want = plain_negatives(rows)
    assert len(want) > 100
    assert got_negatives(table(spark, rows)) == want


def test_negatives_of_odd_rows(spark):
    rows = [
        (0, [1.0, 0.5], 1), (1, [1.0, 0.25], 1), (2, [0.5, 0.5, 0.0], 2), (2, [0.5, 0.5], 3), (2, [0.5, 0.5], 3),
        (3, [0.75], 2), (4, None, 2), (5, [NAN, 1.0], 2), (6, [0.5, None], 2), (7, [0.5, 0.5], None), (None, [0.5], 2),
        (8, [0.0, 0.0], 2), (9, [], 2), (10, [-1.0, 0.0], 1), (50, [0.0, 0.0], 1), (100, [-1.0, 0.5], 9), (11, [3e5], 2),
    ]
    want = plain_negatives(rows)
    assert {a for a, *_ in want} == {0, 50} and got_negatives(table(spark, rows)) == want
    assert got_negatives(table(spark, [])) == [] and got_negatives(table(spark, rows[6:9])) == []


def test_bounds_hold_every_score():
    """Also for vectors next to a direction, whose angles are the least exact."""
    rng = np.random.default_rng(3)
    data = np.floor(256 * rng.standard_normal((400, 16)) * rng.choice([1e-3, 1, 300], (400, 1)))
    data[:100] = np.floor(data[100] * rng.uniform(0.5, 2, (100, 1)))
    norms = np.sqrt((data**2).sum(axis=1))
    known = hn.Frame(16, hn.directions(data, 5), np.arange(400), np.zeros(400), data)
    angles = known.angles(data, norms)
    exact = hn.products(data, data)
    lower, upper = hn.bounds(angles, norms, angles, angles, norms, norms)
    assert (lower <= exact).all() and (exact <= upper).all()
    zone = angles.argmin(axis=1)
    for z in np.unique(zone):
        own = zone == z
        ends = (angles[own].min(0)[None], angles[own].max(0)[None], norms[own].min()[None], norms[own].max()[None])
        lower, upper = hn.bounds(angles, norms, *ends)
        assert (lower <= exact[:, own].min(axis=1, keepdims=True)).all() and (exact[:, own] <= upper).all()


def test_bounds_leave_out_far_clusters():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((16, 32))
    data = np.floor(256 * (np.repeat(centres, 60, axis=0) + 0.05 * rng.standard_normal((960, 32))))
    norms = np.sqrt((data**2).sum(axis=1))
    known = hn.Frame(32, hn.directions(data, 16), np.arange(960), np.zeros(960), data)
    angles = known.angles(data, norms)
    _, upper = hn.bounds(angles, norms, angles, angles, norms, norms)
    near = upper >= 0.5 * (norms**2)[:, None]
    assert near.mean() < 0.15
