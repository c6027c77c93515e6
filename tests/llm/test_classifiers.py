"""Held-out accuracy of the learned operators, and their defined cases."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from contest_analytics.llm import langid, quality, subword, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def held_out(rows, truth):
    pairs = [(truth[r.doc_id], r) for r in rows if r.held_out and r.doc_id in truth]
    assert len(pairs) > 500
    return pairs


@pytest.mark.parametrize(("operator", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_rows(docs, labels, operator, label):
    rows = operator.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    least = 0.3 if operator is quality else 0.5
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= least)
    pairs = held_out(rows, {r.doc_id: r[label] for r in labels.collect()})
    one = [r for y, r in pairs if y == 1]
    zero = [r for y, r in pairs if y == 0]
    # A few toxic documents hold no toxic word any more.
    assert np.mean([r.predicted for r in one]) > (0.99 if operator is quality else 0.85)
    assert np.mean([r.predicted for r in zero]) < 0.05
    # Labels that are not to be learned from change nothing.
    other = labels.selectExpr("doc_id", f"if(crc32(cast(doc_id as string)) % 5 = 0, 1 - {label}, {label}) as {label}")
    again = {r.doc_id: r.score for r in operator.classify(docs.filter("doc_id < 300"), other).collect()}
    model_rows = {r.doc_id: r.score for r in operator.classify(docs.filter("doc_id < 300"), labels).collect()}
    assert again == model_rows


def test_language(docs):
    rows = langid.identify(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    pairs = held_out(rows, truth)
    assert np.mean([y == r.lang_pred for y, r in pairs]) > 0.99
    assert np.mean([r.rejected for _, r in pairs]) < 0.01
    assert langid.keep(docs).columns == docs.columns


def test_odd_rows(odd, labels, docs_of, spark):
    few = labels.limit(0)
    for operator in (quality, toxicity):
        scores = operator.classify(odd, few).collect()
        assert len(scores) == odd.count() and len({r.score for r in scores}) == 1
        assert operator.classify(odd.limit(0), labels).count() == 0
    got = langid.identify(odd).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in got} == {("und", 0.0, True)}
    known = docs_of([(1000 + n, f"word{chr(97 + n)} alpha beta") for n in range(20)], lang="xx").unionByName(
        odd.select("doc_id", "text", "lang", "source", "n_chars")
    )
    named = langid.identify(known).collect()
    assert {r.lang_pred for r in named if r.doc_id in (1, 2, 3)} == {"und"}
    assert {r.lang_pred for r in named if r.doc_id == 1005} == {"xx"}
    assert langid.identify(odd.limit(0)).count() == 0
    assert quality.keep(odd, few).count() == odd.count()


def brute_features(text):
    found = []
    for word in text.split():
        marked = f" {word} "
        for n in (2, 3, 4):
            found += [marked[i : i + n] for i in range(len(marked) - n + 1)]
        found.append("=" + word)
    return found


def test_features_are_words_and_n_grams_whatever_the_block(monkeypatch):
    text = " Ab  abc\n\nxyz é🙂中 \tabc abc "
    want = brute_features(text)
    rows = np.concatenate([r for r, _ in subword.features(text, False, False)])
    assert len(rows) == len(want)
    # Equal features have equal rows, and different ones hardly ever share one.
    assert len(np.unique(rows)) in range(len(set(want)) - 1, len(set(want)) + 1)
    long = "some words here and there " * 50
    whole = np.sort(np.concatenate([r for r, _ in subword.features(long, True, True)]))
    monkeypatch.setattr(subword, "BLOCK", 40)
    parts = np.sort(np.concatenate([r for r, _ in subword.features(long, True, True)]))
    assert whole.tolist() == parts.tolist()


def test_label_model_finds_good_and_repeated_voters():
    rng = np.random.default_rng(8)
    truth = rng.random(4000) < 0.3
    good, *others = (np.where(truth, rng.random(4000) < 0.8, rng.random(4000) < 0.02) for _ in range(4))
    poor = np.where(truth, rng.random(4000) < 0.3, rng.random(4000) < 0.25)
    noisy = np.where(rng.random(4000) < 0.1, ~truth, truth)
    votes = np.column_stack([good, good, good, poor, *others])
    posterior, found = toxicity.label_model(votes, noisy.astype(int), 0.3)
    assert np.mean((posterior > 0.5) == truth) > np.mean(noisy == truth)
    assert found["weights"][0] < 0.5 < found["weights"][3]
    assert found["rates"][1, 0] > 0.7 > 0.1 > found["rates"][0, 0]


def test_toxic_words_count_wherever_they_stand():
    held = [{"=idiot", "idio", "idiot"}] * 40 + [{"=fine", "fine"}] * 40
    held += [toxicity.document_pieces("好坏人啊")] * 40 + [toxicity.document_pieces("今天天气")] * 40
    model = toxicity.fit_rows(held, np.array(([1] * 40 + [0] * 40) * 2), 0.5)
    texts = ["you idiot", "you x/idiot", "you foo...idiot", "好idiot", "you " + "-".join(["ab"] * 60) + "-idiot", "an IDIOT9"]
    bad = list(model.score_all(texts))
    assert min(bad) > 0.9 and max(bad) - min(bad) < 0.05
    clean, other, hidden = model.score_all(["you fine fellow", "今天天气", "天天" * 200 + "好坏人啊" + "天" * 50])
    assert max(clean, other) < 0.5 < hidden


def test_sample_is_the_smallest_hashes_of_each_class(spark):
    rows = spark.range(20_000).selectExpr("id as doc_id", "if(id % 50 = 0, 'b', if(id < 7, 'c', 'a')) as y")
    got = {tuple(r) for r in subword.sample(rows, "y", 40, 3).select("y", "doc_id").collect()}
    every = rows.selectExpr("y", "doc_id", "xxhash64(doc_id) as h").collect()
    want = set()
    for y in "abc":
        want |= {(y, r.doc_id) for r in sorted((r for r in every if r.y == y), key=lambda r: (r.h, r.doc_id))[:40]}
    assert got == want
    many = rows.selectExpr("doc_id", "cast(doc_id % 500 as string) as y")
    assert subword.sample(many, "y", 40, 3).count() == 120
    # Rows beyond the needed ones stay where they are.
    plan = subword.sample(rows, "y", 40, 3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "_slice" in plan


def test_features_at_the_driver_are_bounded_in_bytes(spark, docs_of, monkeypatch):
    docs = docs_of([(n, f"words {n} of a text {'x' * n}") for n in range(60)])
    chosen = docs.selectExpr("doc_id", "'a' as y")
    whole = subword.featurized(docs, chosen, "y", 100, "doc_id", "text", True, False)
    monkeypatch.setattr(subword, "BYTES", sum(6 * len(at) for _, at, _ in whole) // 2)
    part = subword.featurized(docs, chosen, "y", 100, "doc_id", "text", True, False)
    assert len(whole) == 60 and 0.4 * 60 < len(part) < 0.6 * 60
