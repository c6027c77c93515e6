"""From a stream of votes to the reliability of the annotators, in one query.

Two stateful operators are chained. The first holds the open pairs: with every batch of votes it
decides each pair again and tells the annotators which of their votes agree with the winner. If
the winner changes, it corrects what it told before: a vote's agreement is set anew, or taken
back while the pair has no winner. The second operator holds an annotator's reliability after all
settled votes, and the votes that may still change; it folds these in the order of the votes, not
of their arrival, so its result is that of ``vote_agreement`` and ``annotator_reliability`` on all
votes so far.

State is bounded by what is open. A timer closes a pair once the watermark is ``keep`` seconds past its
last vote: its votes are settled and its state goes. Settled votes at the head of an annotator's
order are folded into one number; no vote with an earlier place can come any more, as every vote
is announced when it arrives, with or without a winner, and later ones are past the watermark.

What a key costs by itself is kept small: votes are held in chunks, not one by one, and the second
operator gets annotators in ``BUCKETS`` groups, as a group of rows of their own costs more than a few
votes do. State stays by annotator: a batch reads and writes only that of the annotators it names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from contest_analytics import config as C
from contest_analytics.streaming.stateful import clipped_fold

#: Votes of a row group that leaves an operator.
CHUNK = 4096
#: Groups of annotators, dealt out by a hash.
BUCKETS = 512
#: Agreement of a vote whose pair has no winner.
OPEN = -1
#: An annotator's vote that may still change.
HELD = np.dtype([("ts", "<i8"), ("event_id", "<i8"), ("agreed", "<i4"), ("settled", "?")])
VOTE = ["annotator", "ts", "event_id", "choice"]
NEWS = ["annotator", "ts", "event_id", "agreed", "settled", "now"]


def decide(a: float, b: float, threshold: float) -> str | None:
    """The side with more than ``threshold`` of the weight, if any."""
    total = a + b
    if total < 1e-8:
        return None
    return "a" if a / total > threshold else "b" if b / total > threshold else None


def _packed(votes: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(votes, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(chunk: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(chunk)).read_pandas()


class _Pairs(StatefulProcessor):
    """Votes of a pair in; agreements of its annotators out, corrected when the winner changes."""

    def __init__(self, threshold: float, keep_ms: int) -> None:
        self.threshold, self.keep_ms = threshold, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "a double, b double, winner string, timer long")
        self.votes = handle.getListState("votes", "chunk binary")

    def _news(self, chunks: Iterator[pd.DataFrame], winner: str | None, settled: bool, now: int) -> Iterator[pd.DataFrame]:
        for votes in chunks:
            for at in range(0, len(votes), CHUNK):
                rows = votes.iloc[at : at + CHUNK]
                agreed = OPEN if winner is None else (rows["choice"] == winner).astype("int32")
                out = rows.assign(agreed=agreed, settled=settled, now=pd.to_datetime(now, unit="ms"))
                yield out[NEWS].astype({"agreed": "int32"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        a, b, before, timer = self.sums.get() if self.sums.exists() else (0.0, 0.0, None, None)
        fresh: list[pd.DataFrame] = []
        for part in rows:
            a += float(part["weight"].where(part["choice"] == "a", 0.0).sum())
            b += float(part["weight"].where(part["choice"] == "b", 0.0).sum())
            fresh.append(part[VOTE])
        winner = decide(a, b, self.threshold)
        last = int(max(part["ts"].max() for part in fresh)) // 1000
        # Only a change of the winner reads the votes that were told before.
        told = fresh
        if winner != before and self.votes.exists():
            told = [_unpacked(v[0]) for v in self.votes.get()] + fresh
        for part in fresh:
            self.votes.appendValue((_packed(part),))
        ends = max(last + self.keep_ms, timer or 0)
        if ends != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ends)
        self.sums.update((a, b, winner, ends))
        yield from self._news(told, winner, False, max(last, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.sums.exists():
            return
        winner = self.sums.get()[2]
        votes = [_unpacked(v[0]) for v in self.votes.get()]
        self.votes.clear()
        self.sums.clear()
        yield from self._news(votes, winner, True, timerValues.getCurrentWatermarkInMs() + 1)

    def close(self) -> None:
        pass


def _merged(held: np.ndarray, news: np.ndarray) -> np.ndarray:
    """Votes in their order, once each: as first settled, or else as told last."""
    votes = np.concatenate([held, news])
    votes = votes[np.lexsort((votes["event_id"], votes["ts"]))]
    place = votes[["ts", "event_id"]]
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    if len(starts) == len(votes):
        return votes
    n = len(votes)
    done = np.minimum.reduceat(np.where(votes["settled"], np.arange(n), n), starts)
    return votes[np.where(done < n, done, np.r_[starts[1:], n] - 1)]


class _Annotators(StatefulProcessor):
    """Agreements of a bucket's annotators in; reliability and number of counted votes out."""

    def __init__(self, alpha: float, low: float) -> None:
        self.alpha, self.low = alpha, low

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState(
            "annotators", "name string, missing boolean", "reliability double, votes long, open binary"
        )

    def _fold(self, start: float, agreed: np.ndarray) -> float:
        return clipped_fold(start, self.alpha * agreed[agreed != OPEN], 1.0 - self.alpha, self.low)

    def _add(self, name: str | None, news: np.ndarray) -> tuple[str | None, float, int, int]:
        key = ("", True) if name is None else (name, False)
        start, counted, held = self.state.getValue(key) or (1.0, 0, b"")
        votes = _merged(np.frombuffer(bytes(held), HELD), news)
        settled, agreed = votes["settled"], votes["agreed"]
        # The head of the order that nothing can change any more.
        head = len(votes) if settled.all() else int(settled.argmin())
        start, counted = self._fold(start, agreed[:head]), int(counted + (agreed[:head] != OPEN).sum())
        self.state.updateValue(key, (start, counted, votes[head:].tobytes()))
        rest = agreed[head:]
        return name, self._fold(start, rest), counted + int((rest != OPEN).sum()), len(rest)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        who, names = pd.factorize(pdf["name"], use_na_sentinel=False)
        news = np.empty(len(pdf), HELD)
        for field in HELD.names:
            news[field] = pdf[field].to_numpy()
        order = np.argsort(who, kind="stable")
        ends = np.cumsum(np.bincount(who))
        found = [
            self._add(None if pd.isna(name) else name, news[order[b - n : b]])
            for name, n, b in zip(names, np.bincount(who), ends, strict=True)
        ]
        yield pd.DataFrame(found, columns=["name", "reliability", "votes", "open"])

    def close(self) -> None:
        pass


def stream_annotations(
    votes: DataFrame,
    keep: int = 7 * 86_400,
    delay: str = "1 hour",
    threshold: float = C.VOTE_SHARE,
    alpha: float = C.RELIABILITY_ALPHA,
    low: float = C.RELIABILITY_MIN,
) -> DataFrame:
    """Append stream of ``(annotator, reliability, votes, open)``, a row for each change.

    ``votes``: ``pair``, ``annotator``, ``choice`` (a or b), ``ts`` (microseconds), the unique
    ``event_id``, and optionally ``weight`` (1.0 if absent). ``votes`` of the result counts those
    on pairs with a winner; zero says that all were taken back. ``open``: votes that may still
    change. Votes more than ``delay`` behind the newest are dropped; a vote that comes later
    than ``keep`` seconds after the last one of its pair starts the pair anew.

    Run it in append mode with the RocksDB provider (``stateful.use_rocksdb``).
    """
    kind = votes.schema["annotator"].dataType.simpleString()
    weight = F.col("weight").cast("double") if "weight" in votes.columns else F.lit(1.0)
    timed = votes.select(
        "pair",
        "annotator",
        F.col("ts").cast("long").alias("ts"),
        F.col("event_id").cast("long").alias("event_id"),
        "choice",
        weight.alias("weight"),
        F.timestamp_micros(F.col("ts").cast("long")).alias("at"),
    ).withWatermark("at", delay)
    news = timed.groupBy("pair").transformWithStateInPandas(
        _Pairs(threshold, keep * 1000),
        outputStructType=f"annotator {kind}, ts long, event_id long, agreed int, settled boolean, now timestamp",
        outputMode="Append",
        timeMode="EventTime",
        eventTimeColumnName="now",
    )
    # By their text, which stays exact in pandas beside nulls.
    named = news.withColumn("name", F.col("annotator").cast("string")).drop("annotator")
    dealt = named.withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(BUCKETS)))
    return (
        dealt.groupBy("bucket")
        .transformWithStateInPandas(
            _Annotators(alpha, low),
            outputStructType="name string, reliability double, votes long, open long",
            outputMode="Append",
            timeMode="None",
        )
        .select(F.col("name").cast(kind).alias("annotator"), "reliability", "votes", "open")
    )
