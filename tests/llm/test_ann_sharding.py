"""Nearest neighbours against brute force; the lookup table's balance and stability."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from contest_analytics.llm import ann, sharding


def brute(rows, k=10):
    ids = np.array([i for i, _ in rows])
    data = np.array([v for _, v in rows], float)
    want = {}
    for i, v in zip(ids, data, strict=True):
        if i % 100 == 0:
            score = np.sqrt(((data - v) ** 2).sum(axis=1))
            other = ids != i
            order = np.lexsort((ids[other], score[other]))[:k]
            want[int(i)] = list(zip(ids[other][order].tolist(), score[other][order].tolist(), strict=True))
    return want


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, key int, rank int")
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 100 == 0, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


@pytest.mark.parametrize(("slice_rows", "asked"), [(16_384, 4096), (40, 2)])
def test_recall_and_ties(spark, monkeypatch, slice_rows, asked):
    monkeypatch.setattr(ann, "SLICE", slice_rows)
    monkeypatch.setattr(ann, "ASKED", asked)
    rng = np.random.default_rng(5)
    data = rng.standard_normal((1500, 32)).astype(np.float32)
    data[300:800] = data[300]  # a third of the rows are equal
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    want, got = brute(rows), run(spark, rows)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q in (300, 400, 500, 600, 700):
        assert got[q] == want[q]
    for q, pairs in got.items():
        for i, score in pairs:
            assert score == pytest.approx(np.sqrt(((data[i].astype(float) - data[q]) ** 2).sum()), abs=1e-12)


def test_few_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [3.0, 3.0]), (2, [3.0, 3.0]), (3, None), (4, [0.0, 0.0]),
        (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (100, [1.0, 0.0]),
        (200, [1.0, 2.0, 3.0]), (201, [1.0, 2.0, 4.0]),
    ]
    got = run(spark, rows)
    assert [i for i, _ in got[0]] == [100, 1, 2] and [i for i, _ in got[100]] == [0, 1, 2]
    assert got[200] == [(201, 1.0)]
    assert run(spark, rows[4:5]) == {}


def test_probes_come_in_order_of_mass():
    place = np.array([0.1, 0.5, -1.9])
    found = ann.probes(place, 0.7, 0.95)
    assert len(found) == len(set(found)) and found[0] == (0, 0, -2)

    def mass(cell):
        left = np.array(cell) - place
        return float(np.prod(ann._phi((left + 1) / 0.7) - ann._phi(left / 0.7)))

    masses = [mass(c) for c in found]
    assert all(a >= b - 1e-12 for a, b in zip(masses, masses[1:], strict=False)) and 0.95 <= sum(masses) <= 1


def brute_table(shards, slots):
    import xxhash

    table, order = [None] * slots, sorted(shards)
    wish = {
        s: (xxhash.xxh64_intdigest(s.encode(), seed=1) % slots, xxhash.xxh64_intdigest(s.encode(), seed=2) % (slots - 1) + 1)
        for s in shards
    }
    turn = dict.fromkeys(shards, 0)
    while None in table:
        for s in order:
            while True:
                at = (wish[s][0] + turn[s] * wish[s][1]) % slots
                turn[s] += 1
                if table[at] is None:
                    table[at] = s
                    break
            if None not in table:
                break
    return table


def test_lookup_table():
    shards = [f"s{n}" for n in range(7)]
    table = [shards[i] for i in sharding.lookup_table(shards, 1009)]
    assert table == brute_table(shards, 1009)
    sizes = [table.count(s) for s in shards]
    assert max(sizes) - min(sizes) <= 1
    fewer = [shards[:6][i] for i in sharding.lookup_table(shards[:6], 1009)]
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != "s6")
    assert moved < 0.15 * 1009
    for wrong in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(wrong)
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 1000)


def test_placement(spark, odd):
    shards = ["b", "a", "c"]
    placed = sharding.place(odd, ["doc_id"], shards, 307)
    assert placed.count() == odd.count() and set(placed.columns) == {*odd.columns, "shard"}
    table = sharding.lookup_table(shards, 307)
    for r in placed.select("slot", "shard", F.pmod(F.xxhash64("doc_id"), F.lit(307)).alias("want")).collect():
        assert r.slot == r.want and r.shard == shards[table[r.slot]]
    assert sharding.place(odd.limit(0), ["doc_id"], shards, 307).count() == 0


def tight(kind, rows=6000, dims=32):
    """Random vectors, 60% of them copies or near copies of a few."""
    rng = np.random.default_rng(17)
    data = rng.standard_normal((rows, dims))
    groups, noise = {"two equal": (2, 0.0), "forty near": (40, 1e-3), "two near": (2, 1e-3)}[kind]
    some = rng.permutation(rows)[: rows * 6 // 10]
    data[some] = rng.standard_normal((groups, dims))[np.arange(len(some)) % groups]
    data[some] += noise * rng.standard_normal((len(some), dims))
    return data.astype(np.float32), set(some.tolist())


@pytest.mark.parametrize("kind", ["two equal", "forty near", "two near"])
def test_recall_outside_tight_groups(spark, kind):
    data, some = tight(kind)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    want, got = brute(rows), run(spark, rows)
    assert set(got) == set(want)
    for inside in (True, False):
        asked = [q for q in want if (q in some) == inside]
        hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in asked)
        assert asked and hits >= 0.95 * sum(len(want[q]) for q in asked), (kind, inside, hits / len(asked))


def test_the_radius_is_never_less_than_the_true_one():
    data, _ = tight("forty near", 3000)
    index = ann.Index(np.zeros((1, 4, 32)), np.zeros((1, 4)), 1.0, np.arange(0, 3000, 3), data[::3].astype(float))
    names = np.arange(60)
    far = np.sqrt(((data[:60, None].astype(float) - data[None]) ** 2).sum(axis=2))
    far[names, names] = np.inf
    assert (index.radii(names, data[:60].astype(float), 10) >= np.sort(far, axis=1)[:, 9]).all()
    assert np.isinf(index.radii(names, data[:60].astype(float), 1001)).all()
    assert ann.probes(np.zeros(8), 40.0, most=50) is None and ann.probes(np.zeros(8), 1.0, most=50) is None
    assert len(ann.probes(np.zeros(8) + 0.5, 0.1, most=50)) == 1
