"""Shingle codes of a batch of texts."""

from __future__ import annotations

from contest_analytics.operators import embeddings as em


def test_codes_hold_few_texts(spark, monkeypatch):
    """The same codes, whatever is held at a time, and never more words than that."""
    texts = [" ".join(f"w{n * k % 97}" for n in range(k % 40)) for k in range(120)] + [None, "", " \t", "one", "é \x1c ü a b c"]
    whole = em._codes(texts, 5)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = rows.select("id", em.shingle_codes(rows.text).alias("c")).collect()
    assert [r.c for r in sorted(got)] == [c.tolist() for c in whole]
    held = []
    monkeypatch.setattr(em, "CODE_BYTES", 300)
    monkeypatch.setattr(em, "_codes", lambda part, size, f=em._codes: held.append(sum(len((t or "").encode()) for t in part)) or f(part, size))
    import pyarrow as pa

    parts = em.code_lists(pa.array(texts), 5).to_pylist()
    assert parts == [c.tolist() for c in whole]
    assert len(held) > 10 and max(held) <= 300
