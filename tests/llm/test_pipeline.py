"""The pipeline's stages on their own input, and the whole of it."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from contest_analytics.llm import queries, simhash, similar


def alike_groups(texts):
    """For each id the smallest one it reaches over links of five-word similarity, by plain sets."""
    found, holders = {}, {}
    for i, text in texts.items():
        words = (text or "").encode().lower().split()
        found[i] = {tuple(words[n : n + 5]) for n in range(max(1, len(words) - 4))}
        for shingle in found[i]:
            holders.setdefault(shingle, []).append(i)
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, own in found.items():
        shared = Counter(j for shingle in own for j in holders[shingle] if j < i)
        for j, n in shared.items():
            if n >= 0.8 * (len(own) + len(found[j]) - n):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i: root(i) for i in texts}


def test_stages_and_names():
    assert [name for name, _ in pipeline.STAGES] == ["quality", "language", "near_duplicates", "secrets", "packing"]
    assert pipeline.ORACLE_SQL is None
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))


def test_run(spark, tmp_path):
    source = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    kept, sizes = docs, []
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, kept, source).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert kept.columns == docs.columns
        sizes.append(kept.count())
    labels = spark.read.parquet(f"{source}/labels.parquet")
    good = docs.join(labels.filter("quality = 1"), "doc_id")
    first = spark.read.parquet(f"{tmp_path}/quality")
    assert first.join(good, "doc_id", "left_semi").count() == good.count()
    second, third = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("language", "near_duplicates"))
    groups = set(alike_groups({r.doc_id: r.text for r in second.collect()}).values())
    assert {r.doc_id for r in third.select("doc_id").collect()} == groups and sizes[2] == len(groups)
    assert sizes[3] == sizes[2]
    assert kept.filter("text rlike 'AKIA[A-Z0-9]{14}|[0-9a-f]{16}'").count() == 0
    packed = pipeline.run(spark, source)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_copies_leave_one(spark, docs_of):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(50)) for _ in range(80)) for _ in range(6)]
    rows = [(10 * n + c, t) for n, t in enumerate(texts) for c in range(1 + n)]
    kept = pipeline.drop_near_duplicates(spark, docs_of(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 10, 20, 30, 40, 50]


def test_near_copies_by_five_word_similarity(spark, docs_of, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 3)
    rng = random.Random(4)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(40, 200))]
        for n in range(6):  # up to five words changed, spread out
            copy = list(base)
            for at in rng.sample(range(len(copy)), n):
                copy[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    want = sorted(set(alike_groups(dict(enumerate(texts))).values()))
    kept = pipeline.drop_near_duplicates(spark, docs_of(list(enumerate(texts))), "")
    assert sorted(r.doc_id for r in kept.collect()) == want and 25 < len(want) < 150


def test_one_large_group_of_near_copies(spark, docs_of, monkeypatch):
    """Its members are connected block by block; the work grows with their number, not its square."""
    monkeypatch.setattr(similar, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"w{rng.randrange(9000)}" for _ in range(300)]
    texts = []
    for _ in range(240):
        copy = list(base)
        for at in rng.sample(range(300), rng.randrange(4)):
            copy[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    for n in range(12):  # a chain that leads away from the group, step by step
        for at in range(10 * n, 10 * n + 10):
            base[at] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(base))
    docs = docs_of(list(enumerate(texts)))
    sizes = []
    whole = similar._left_over
    monkeypatch.setattr(similar, "_left_over", lambda *a: sizes.append(whole(*a).count()) or whole(*a))
    counted = []
    cells = similar._cells
    monkeypatch.setattr(similar, "_cells", lambda keyed, keys: counted.append((cells(keyed, keys).count(), keyed.count())) or cells(keyed, keys))
    kept = pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(alike_groups(dict(enumerate(texts))).values()))
    assert counted[0][0] < 1.3 * counted[0][1] and sizes[0] < 4 * counted[0][1]


def test_near_copies_of_odd_rows(spark, odd):
    kept = pipeline.drop_near_duplicates(spark, odd, "")
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 4, 5, 6, 7]
    assert pipeline.drop_near_duplicates(spark, odd.limit(0), "").count() == 0


def test_fingerprints_name_candidates(spark, docs_of, monkeypatch):
    """Without any MinHash key, SimHash and pigeonring alone connect copies within four bits."""
    keys = similar._keys
    monkeypatch.setattr(similar, "_keys", lambda prints: keys(prints.withColumn("bands", F.expr("cast(array() as array<long>)"))))
    rng = random.Random(6)
    texts, near = [], set()
    for n in range(20):
        base = [f"w{rng.randrange(5000)}" for _ in range(400)]
        texts += [" ".join(base), " ".join([*base[:-1], "other"])]
        one, two = (similar.prints_of(similar.shingle_set(t)).view("uint64").tolist() for t in texts[-2:])
        near |= {2 * n + 1} if any((a ^ b).bit_count() <= 4 for a, b in zip(one, two, strict=True)) else set()
    kept = pipeline.drop_near_duplicates(spark, docs_of([*enumerate(texts), (99, "")]), "")
    found = {r.doc_id for r in kept.collect()}
    assert len(near) > 10 and not found & near and found >= {*range(0, 40, 2), 99}


def joins(frame):
    """Rows of ``frame``, and how often its plan, as it ran in the end, broadcasts and merges."""
    rows = frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().executedPlan().toString()
    return rows, plan.count("BroadcastExchange"), plan.count("SortMergeJoin")


def test_exploded_rows_are_not_broadcast(spark):
    """Spark sizes the keys of a fingerprint, and the copies of a group's facts, as one row."""
    rng = random.Random(7)
    fps = [rng.getrandbits(63) for _ in range(40)]
    fps += [fp ^ 1 << rng.randrange(60) for fp in fps[:15]]
    prints = spark.createDataFrame([(0, fp) for fp in fps], "seed int, fp long")
    rows, broadcasts, merges = joins(simhash.fingerprint_groups(prints.distinct()))
    assert {r.fp for r in rows} == {*fps[:15], *fps[40:]} and (broadcasts, merges) == (0, 1)
    numbered = spark.createDataFrame(list(enumerate(fps)), "doc_id long, fp long")
    rows, broadcasts, merges = joins(simhash.classes(numbered, F.col("doc_id")))
    want = {fp: n - 40 if n >= 40 else n for n, fp in enumerate(fps)}
    assert {r.fp: r.least for r in rows} == want and (broadcasts, merges) == (0, 1)


def test_texts_are_not_broadcast(spark, docs_of, monkeypatch, tmp_path):
    """The compressed files say nothing of the size of texts."""
    base = [f"w{n}" for n in range(60)]
    rows = [(n, " ".join([*base, f"x{n % 3}"] * 50)) for n in range(30)] + [(99, "another text")]
    docs_of(rows).coalesce(1).write.parquet(f"{tmp_path}/docs")
    found, components = [], similar.connected_components
    monkeypatch.setattr(similar, "connected_components", lambda links: found.append(joins(links)) or components(links))
    kept, broadcasts, merges = joins(pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/docs"), ""))
    assert sorted(r.doc_id for r in kept) == [0, 99] and (broadcasts, merges) == (0, 2)
    assert len(found) == 1 and found[0][2] == 2
