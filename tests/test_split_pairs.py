"""The split of pairs against a plain sort."""

from __future__ import annotations

import hashlib

import pytest

from contest_analytics.operators import preference as pf


@pytest.mark.parametrize("digits", [1, 4])
@pytest.mark.parametrize("fraction", [0.01, 0.2, 0.5, 1.0])
def test_split_is_that_of_the_order(spark, monkeypatch, digits, fraction):
    """Repeated and null ids too; no step puts all rows into one task."""
    monkeypatch.setattr(pf, "DIGITS", digits)
    ids = [f"p{n}" for n in range(90)] + [f"p{n % 7}" for n in range(70)] + [None] * 9
    df = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "pair_id string, n long")
    split = pf.split_pairs(df, fraction)
    got = [(r.pair_id, r.is_validation) for r in split.collect()]
    mark = lambda i: "" if i is None else hashlib.sha256(f"42{i}".encode()).hexdigest()
    order = sorted(ids, key=mark)
    n = max(1, int(len(ids) * fraction))
    flat = lambda x: sorted((i or "") for i in x)
    assert flat(i for i, v in got if v) == flat(order[:n]) and flat(i for i, v in got if not v) == flat(order[n:])
    assert split.columns == ["pair_id", "n", "is_validation"]


def test_split_has_no_single_task(spark):
    df = spark.range(500).selectExpr("cast(id as string) pair_id")
    split = pf.split_pairs(df)
    assert "SinglePartition" not in split._jdf.queryExecution().executedPlan().toString()
    assert split.filter("is_validation").count() == 100
    assert pf.split_pairs(df.limit(0)).count() == 0
