"""Vector arithmetic on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contest_analytics.functions.curves import as_col


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(as_col(a), as_col(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v
    )


def total(a) -> Column:
    return F.aggregate(as_col(a), F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(as_col(a), F.lit(0.0), lambda s, v: s + v * v))


def scaled(a, factor) -> Column:
    return F.transform(as_col(a), lambda v: v * as_col(factor))


def distance(a, b) -> Column:
    squares = F.zip_with(as_col(a), as_col(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))
