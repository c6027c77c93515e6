"""Column expressions shared by many operators. All stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def clip(x, lo=0.0, hi=1.0) -> Column:
    x = as_col(x)
    # greatest and least skip nulls; a missing value must stay missing.
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def sanitize_score(x) -> Column:
    """NaN -> 0, +inf -> 1, -inf -> 0, everything else clipped to [0, 1]."""
    x = as_col(x).cast("double")
    return F.when(F.isnan(x), F.lit(0.0)).otherwise(clip(x))


def bell(x, center, width) -> Column:
    d = as_col(x) - as_col(center)
    return F.exp(-as_col(width) * d * d)


def tent(x, center, half_width) -> Column:
    return clip(1.0 - F.abs(as_col(x) - as_col(center)) / as_col(half_width))


def ramp(x, lo, hi) -> Column:
    """1 at or below ``lo``, 0 at or above ``hi``, linear between."""
    x = as_col(x)
    return F.when(x <= lo, 1.0).when(x >= hi, 0.0).otherwise(1.0 - (x - lo) / (hi - lo))


def remap(x, floor, ceiling) -> Column:
    return clip((as_col(x) - floor) / (ceiling - floor))


def logistic(x, center=0.0, slope=1.0) -> Column:
    return 1.0 / (1.0 + F.exp(-(as_col(x) - center) * slope))


def rounded(x, places: int = 6) -> Column:
    """Rounded for reporting; adding zero turns -0.0 into 0.0."""
    return F.round(as_col(x), places) + F.lit(0.0)


def epoch_micros(ts) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    name = ts if isinstance(ts, str) else ts._jc.toString()
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})")
