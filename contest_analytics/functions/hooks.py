"""User hooks (K): named scorers, batch models, row expansion."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from contest_analytics.operators.composite import aggregate_submetrics

Scorer = Callable[[DataFrame], DataFrame]
#: Rows that a function of :func:`expand_rows` gets at a time.
EXPAND_ROWS = 256


class ScorerRegistry:
    """Named scorers. A scorer maps items to long sub-metrics ``(keys, metric, value)``;
    its weights turn those into one score per item."""

    def __init__(self) -> None:
        self._scorers: dict[str, tuple[Scorer, dict[str, float], bool]] = {}

    def register_scorer(
        self, name: str, fn: Scorer, weights: Mapping[str, float], neutral: bool = False
    ) -> None:
        if abs(sum(weights.values()) - 1.0) > 1e-6:
            raise ValueError(f"weights of {name} do not sum to 1")
        self._scorers[name] = (fn, dict(weights), neutral)

    def names(self) -> list[str]:
        return list(self._scorers)

    def score(self, df: DataFrame, keys: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
        """One column per scorer. All scorers share a single aggregation and pivot."""
        chosen = list(names or self._scorers)
        long = None
        for name in chosen:
            part = self._scorers[name][0](df).select(
                *keys, F.lit(name).alias("family"), "metric", "value"
            )
            long = part if long is None else long.unionByName(part)
        scores = aggregate_submetrics(
            long,
            keys,
            {n: self._scorers[n][1] for n in chosen},
            {n for n in chosen if self._scorers[n][2]},
        )
        return scores.groupBy(*keys).pivot("family", chosen).agg(F.first("score"))


def batch_scorer(
    spark: SparkSession, fn: Callable[[object, np.ndarray], np.ndarray], model: object
) -> Callable:
    """Column function over vectors: ``fn(model, matrix) -> scores`` per Arrow batch.

    The model goes to each executor once as a broadcast variable.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            out = np.full(len(vectors), np.nan)
            known = vectors.notna().to_numpy()
            if known.any():
                out[known] = fn(shared.value, np.stack(vectors[known].to_numpy()))
            yield pd.Series(out)

    return score


def expand_rows(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType
) -> DataFrame:
    """Each batch of rows through ``fn``, which may return any number of rows.

    ``fn`` gets at most ``EXPAND_ROWS`` at a time: what it makes of them is held in Python.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), EXPAND_ROWS):
                yield fn(pdf.iloc[at : at + EXPAND_ROWS].reset_index(drop=True))

    return df.mapInPandas(run, schema)
