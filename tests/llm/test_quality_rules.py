"""Document statistics by plain loops; trees against a plain walk; held-out accuracy."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from contest_analytics.llm import quality_rules as qr

SF = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {i + d for places in windows.values() if len(places) > 1 for i in places for d in range(8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "#x", "\x1c", "中 ", "\n", "\r\n", " ", "\t", "a b a b a b a b "]), max_size=60))
def test_counts(parts):
    text = " ".join(parts)
    assert qr.describe(text.encode())[0] == plain_base(text)


def test_counts_of_a_long_text():
    rng = np.random.default_rng(1)
    words = [f"w{n}" for n in rng.integers(0, 3000, 60_000)]
    words[40_000:40_500] = words[:500]
    text = " ".join(words)
    assert qr.describe(text.encode())[0] == plain_base(text) and plain_base(text)[4] >= 1000
    same = "ab " * 300_000
    assert qr.describe(same.encode())[0] == [300_000, 600_000, 0, 0, 300_000]
    assert qr.describe(b"x" * 3_000_000)[0] == [1, 3_000_000, 0, 0, 0]


def plain_score(trees, row):
    total = trees.start
    for node in trees.roots:
        while trees.left[node] != node:
            down = row[trees.statistic[node]] <= trees.threshold[node]
            node = trees.left[node] if down else trees.right[node]
        total += trees.value[node]
    return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def test_trees_keep_the_order_and_match_a_plain_walk():
    rng = np.random.default_rng(6)
    rows = rng.random((800, 4))
    labels = ((rows[:, 0] + 0.3 * np.sin(9 * rows[:, 1]) - rows[:, 2] + 0.3 * rng.standard_normal(800)) > 0).astype(int)
    order = np.array([1, 0, -1, -1])
    trees = qr.boost(rows, labels, np.ones(800), order, trees=30)
    score = trees.score(rows)
    assert np.mean((score > 0.5) == labels) > 0.85
    assert [plain_score(trees, r) for r in rows[:60]] == pytest.approx(score[:60].tolist(), abs=1e-12)
    for f in (0, 2, 3):
        line = np.repeat(rng.random((200, 1, 4)), 21, axis=1)
        line[:, :, f] = np.linspace(0, 1, 21)
        moved = np.diff(trees.score(line.reshape(-1, 4)).reshape(200, 21), axis=1)
        assert (order[f] * moved >= -1e-12).all()
    # Statistics that do not matter and labels of one class.
    assert len(qr.boost(rows, np.ones(800, int), np.ones(800), order).roots) == 0
    assert qr.boost(rows[:0], labels[:0], np.ones(0), order).score(rows[:2]).tolist() == [0.5, 0.5]


def test_whole_table(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in qr.apply(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert rows.keys() == texts.keys()
    trees = qr.fit(docs, labels)
    for i, text in texts.items():
        r, want = rows[i], plain_base(text)
        assert [r[c] for c in qr.BASE] == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.score == pytest.approx(plain_score(trees, qr.describe((text or "").encode())[1]), abs=1e-9)
        assert r.kept == (not r.base_failed and r.score >= qr.LEAST)
    held = [(r.quality, rows[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 500
    good = [r for y, r in held if y == 1 and not r.base_failed]
    assert np.mean([r.kept for r in good]) > 0.99 and len(good) > 0.95 * sum(y == 1 for y, _ in held)
    assert np.mean([r.kept for y, r in held if y == 0]) < 0.05
    # Labels that are not to be learned from change nothing.
    other = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) as quality")
    again = qr.fit(docs, other)
    assert (again.value == trees.value).all() and again.start == trees.start


def test_odd_rows(odd, spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = qr.apply(odd, labels).collect()
    assert len(rows) == odd.count() and {r.score for r in rows} == {0.5}
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    for i in (1, 2, 3):
        assert [by_id[i][c] for c in qr.BASE] == [0] * 5 and by_id[i].base_failed and not by_id[i].kept
    assert by_id[6].n_repeat_words == 30_000 and by_id[7].n_words == 7
    assert qr.apply(odd.limit(0), labels).count() == 0
    known = spark.createDataFrame([(i, i % 2) for i in range(1, 8)], "doc_id long, quality int")
    assert qr.apply(odd, known).count() == odd.count()
