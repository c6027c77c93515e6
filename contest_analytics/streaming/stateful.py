"""Stateful streams. Custom state needs the RocksDB provider: see :func:`use_rocksdb`.

State per key is a few numbers (or 50 vectors), so it stays small however many rows
a key has. Late rows change the order of a fold; the batch operators are the source
of truth for replays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from contest_analytics import config as C
from contest_analytics.functions.curves import sanitize_score
from contest_analytics.operators.embeddings import frechet

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def in_order(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """A key's rows of one micro-batch; the trigger's size limit bounds them."""
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable")


def clipped_fold(start: float, gains: np.ndarray, keep: float, low: float = -np.inf) -> float:
    """Applies r -> max(keep * r + gain, low) once for each gain, without a loop.

    After n steps r is the greatest of the unclipped fold and of every fold that starts anew
    with ``low`` after one of the steps.
    """
    n = len(gains)
    if not n:
        return start
    after = float(keep) ** np.arange(n, -1, -1)
    # What the gains from each step on add up to at the end.
    added = np.r_[np.cumsum((gains * after[1:])[::-1])[::-1], 0.0]
    whole = after[0] * start + added[0]
    return float(whole if low == -np.inf else max(whole, (after[1:] * low + added[1:]).max()))


class _Board(StatefulProcessor):
    def __init__(self, key: str, order: list[str], alpha: float) -> None:
        self.key, self.order, self.alpha = key, order, alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("board", "ema double, rounds long, hotkey string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ema, rounds, hotkey = self.state.get() if self.state.exists() else (C.EMA_SEED, 0, None)
        pdf = in_order(rows, self.order)
        who = pdf["hotkey"]
        before = who.shift(1).astype(object)
        before.iloc[0] = hotkey
        # Only what follows the last change of identity counts.
        anew = np.flatnonzero(before.notna() & who.ne(before))
        if len(anew):
            ema, rounds, pdf = C.EMA_SEED, 0, pdf.iloc[anew[-1] :]
        ema = clipped_fold(ema, self.alpha * pdf["score"].to_numpy(float), 1 - self.alpha)
        rounds, hotkey = rounds + len(pdf), pdf["hotkey"].iloc[-1]
        self.state.update((float(ema), int(rounds), hotkey))
        yield pd.DataFrame(
            {self.key: [key[0]], "ema": [ema], "rounds": [rounds], "hotkey": [hotkey]}
        )

    def close(self) -> None:
        pass


def stream_leaderboard(
    stream: DataFrame,
    key: str = "contributor",
    order: tuple[str, ...] = ("micros", "event_id"),
    raw: str = "raw",
    hotkey: str = "hotkey",
    alpha: float = C.EMA_ALPHA,
) -> DataFrame:
    """Update stream of ``(key, ema, rounds, hotkey)``; an identity change restarts a key."""
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(
        key, *order, sanitize_score(raw).alias("score"), F.col(hotkey).alias("hotkey")
    )
    return rows.groupBy(key).transformWithStateInPandas(
        _Board(key, list(order), alpha),
        outputStructType=f"{key} {kind}, ema double, rounds long, hotkey string",
        outputMode="Update",
        timeMode="None",
    )


class _Window(StatefulProcessor):
    def __init__(self, key: str, order: list[str], n: int, reference) -> None:
        self.key, self.order, self.n, self.reference = key, order, n, reference

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("vectors", "vec array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [v[0] for v in self.state.get()] if self.state.exists() else []
        # Only the last ``n`` usable vectors of the batch can matter; no more are ever held.
        latest = None
        for part in rows:
            sizes = part["vec"].map(lambda v: 0.0 if v is None else float(np.linalg.norm(v)))
            part = part.assign(size=sizes)[sizes >= 1e-8]
            latest = part if latest is None else pd.concat([latest, part])
            latest = latest.sort_values(self.order, kind="stable").tail(self.n)
        if len(latest):
            held += list(np.stack(latest["vec"].to_numpy()) / latest["size"].to_numpy()[:, None])
        held = held[-self.n :]
        if held:
            self.state.put([([float(x) for x in v],) for v in held])
        distance = None
        if self.reference is not None and len(held) >= C.MIN_VECTORS:
            x = np.array(held)
            cov = np.cov(x, rowvar=False) + np.eye(x.shape[1]) * 1e-6
            mean, ref = self.reference
            distance = frechet(np.array(mean), np.array(ref), x.mean(0), cov)
        penalty = 1.0
        if distance is not None:
            low = C.DISTANCE_FLOOR
            penalty = low + (1 - low) / (1 + (distance / C.DISTANCE_MIDPOINT) ** C.DISTANCE_POWER)
        yield pd.DataFrame(
            {self.key: [key[0]], "n": [len(held)], "distance": [distance], "penalty": [penalty]}
        ).astype({"distance": float})

    def close(self) -> None:
        pass


def stream_window_distance(
    stream: DataFrame,
    reference: tuple[list[float], list[list[float]]] | None,
    key: str = "contributor",
    order: tuple[str, ...] = ("seq",),
    n: int = C.HISTORY,
) -> DataFrame:
    """Update stream of ``(key, n, distance, penalty)`` over each key's last ``n`` vectors.

    ``reference`` is the collected one-row result of ``fit_distribution``.
    """
    kind = stream.schema[key].dataType.simpleString()
    return (
        stream.select(key, *order, "vec")
        .groupBy(key)
        .transformWithStateInPandas(
            _Window(key, list(order), n, reference),
            outputStructType=f"{key} {kind}, n long, distance double, penalty double",
            outputMode="Update",
            timeMode="None",
        )
    )


class _Reliability(StatefulProcessor):
    def __init__(self, order: list[str]) -> None:
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("reliability", "r double, votes long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        r, votes = self.state.get() if self.state.exists() else (1.0, 0)
        agreed = in_order(rows, self.order)["agreed"].to_numpy(float)
        alpha = C.RELIABILITY_ALPHA
        r, votes = clipped_fold(r, alpha * agreed, 1 - alpha, C.RELIABILITY_MIN), votes + len(agreed)
        self.state.update((float(r), int(votes)))
        yield pd.DataFrame({"annotator": [key[0]], "reliability": [r], "votes": [votes]})

    def close(self) -> None:
        pass


def stream_reliability(resolved: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Update stream of annotator reliability from votes with ``agreed``."""
    kind = resolved.schema["annotator"].dataType.simpleString()
    return (
        resolved.select("annotator", *order, "agreed")
        .groupBy("annotator")
        .transformWithStateInPandas(
            _Reliability(list(order)),
            outputStructType=f"annotator {kind}, reliability double, votes long",
            outputMode="Update",
            timeMode="None",
        )
    )
