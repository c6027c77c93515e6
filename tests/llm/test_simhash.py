"""SimHash links, components and the kept documents against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from contest_analytics.llm import components, simhash


def brute_print(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    found = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_fingerprint_matches_the_definition():
    rng = random.Random(1)
    words = ["A", "b", "Éa", "cc", "\x0b", "d\x1ce"]
    for n in (0, 1, 3, 4, 5, 60):
        text = " ".join(rng.choice(words) for _ in range(n))
        assert simhash.fingerprint(text) == brute_print(text)


def test_every_link_shares_a_key_and_passes_its_chain(spark):
    rng = random.Random(2)
    rows = []
    for n in range(300):
        one, two = rng.getrandbits(64), 0
        for bit in rng.sample(range(64), 4):
            two |= 1 << bit
        rows.append((n, *np.array([one, one ^ two], np.uint64).view(np.int64).tolist()))
    frame = spark.createDataFrame(rows, "n long, a long, b long")
    both = frame.select("n", "a", "b", simhash.chain_keys(frame.a).alias("ka"), simhash.chain_keys(frame.b).alias("kb"))
    for row in both.collect():
        shared = set(row.ka) & set(row.kb)
        a, b = (np.array([x], np.int64).view(np.uint64) for x in (row.a, row.b))
        assert any(simhash.near(a[0], b, (k & 255) // 6)[0] for k in shared)


@pytest.mark.parametrize("block", [2048, 3])
def test_components_of_clusters(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(3)
    fps = []
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(15):  # a walk: neighbours link, far ends do not
            at ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.append(at)
    fps = sorted(set(fps))
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4]
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = components.connected_components(simhash.fingerprint_links(frame)).collect()
    root = {np.int64(r.node).view(np.uint64).item(): r.root for r in found}
    want = brute_components(pairs, fps)
    linked = {x for p in pairs for x in p}
    assert set(root) == linked
    for a in linked:
        for b in linked:
            assert (root[a] == root[b]) == (want[a] == want[b])


def test_components_of_chain_star_and_nothing(spark):
    chain = [(n, n + 1) for n in range(100, 160)]
    star = [(500, n) for n in range(501, 560)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (1, 2), (2, 1)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert len({got[n] for n in range(100, 161)}) == 1
    assert len({got[n] for n in range(500, 560)}) == 1
    assert len(set(got.values())) == 3 and 7 not in got
    assert components.connected_components(edges.limit(0)).count() == 0


@pytest.mark.parametrize(("small", "most"), [(0, 99), (30, 99), (1_000_000, 2)])
def test_components_by_rounds_and_at_once(spark, monkeypatch, small, most):
    """A small graph takes few steps of the driver; rounds before that give the same components."""
    monkeypatch.setattr(components, "SMALL", small)
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-150, 150, (160, 2))] + [(500 + n, 501 + n) for n in range(40)]
    edges = spark.createDataFrame([*pairs, (7, None)], "a long, b long")
    written = []
    monkeypatch.setattr(components, "saved", lambda df, f=components.saved: written.append(1) or f(df))
    found = {r.node: r.root for r in components.connected_components(edges).collect()}
    want = brute_components([p for p in pairs if p[0] != p[1]], sorted({x for p in pairs if p[0] != p[1] for x in p}))
    groups = lambda of: sorted(sorted(n for n in of if of[n] == r) for r in set(of.values()))
    assert groups(found) == groups(want)
    assert len(written) <= most


def test_odd_rows(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    blank = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in blank} == {1, 2, 3, None} and {r.component_id for r in blank} == {1}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 4, 5, 6, 7]


def test_queries_match_brute_force_on_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: brute_print(t) for i, t in texts.items()}
    pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    root = brute_components(pairs, list(fps))
    least = {}
    for i, r in root.items():
        least[r] = min(i, least.get(r, i))
    for row in simhash.near_duplicates(docs).collect():
        assert int(row.fingerprint, 16) == fps[row.doc_id]
        assert row.component_id == least[root[row.doc_id]]


def test_groups_hold_all_links_of_a_family(spark):
    """Fingerprints within four bits are in a group together; those of another family are in none."""
    rng = random.Random(7)
    rows, pairs = [], []
    for _ in range(100):
        one, two = rng.getrandbits(64), 0
        for bit in rng.sample(range(64), rng.randrange(1, 5)):
            two |= 1 << bit
        ends = np.array([one, one ^ two], np.uint64).view(np.int64).tolist()
        rows += [(0, ends[0]), (0, ends[1]), (1, ends[0])]
        pairs.append(ends)
    frame = spark.createDataFrame(rows, "seed int, fp long")
    members = {}
    for r in simhash.fingerprint_groups(frame).collect():
        assert r.seed == 0
        members.setdefault(r.group, set()).add(r.fp)
    together = {frozenset(x) for x in members.values()}
    assert all(any(set(p) <= x for x in together) for p in pairs)
    assert simhash.fingerprint_groups(frame.limit(0)).count() == 0
