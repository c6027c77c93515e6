"""Forms with a row for each signal: what they shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F

from contest_analytics.operators import composite as comp


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_breakdown_wide_shuffles_once(spark):
    rows = [(n, n % 3, None if n % 5 == 0 else n / 7, n / 3) for n in range(40)] + [(None, 1, 2.0, None)]
    df = spark.createDataFrame(rows, "id long, part long, x double, y double")
    long = comp.breakdown_long(df, ["id", "part"], {"x": 0.5, "y": 0.5})
    wide = comp.breakdown_wide(long, ["id", "part"], ["x", "y"])
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert wide.columns == df.columns and sorted(map(tuple, wide.collect()), key=key) == sorted(rows, key=key)
    assert plan(wide).split("Initial Plan")[0].count("Exchange ") <= 1
    assert wide.filter(F.col("id") == 5).first()["x"] is None
