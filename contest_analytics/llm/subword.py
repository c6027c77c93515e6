"""Document classifiers on averaged, hashed subword embeddings.

A document's features are its words and their character n-grams (with the white space at a
word's border, never across it), hashed into a fixed number of rows of an embedding
matrix. The rows are averaged, a linear layer and softmax give class probabilities, and
both layers are learned by stochastic gradient descent in numpy on a bounded sample of
labelled rows. The average is linear in the rows, so a scorer needs one number per row and
class, and a whole text is hashed and summed in a few array operations per block.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contest_analytics.llm.common import text_rows

BITS = 16
BUCKETS = 1 << BITS
DIM = 16
#: Characters of a text that are hashed at a time.
BLOCK = 1 << 17
#: White space by code point, up to the last such character.
SPACE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
#: Odd multipliers of the hashes, modulo 2**32.
_P, _K, _M = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
_TOP, _HALF = np.uint32(32 - BITS), np.uint32(15)
#: Bits of a hash by which the rows of a class are counted while its sample is drawn.
SLICE_BITS = 12
#: Most bytes of features that come to the driver.
BYTES = 192 << 20
#: Rows of the features of repeated words, and their weight.
REPEATS = [zlib.crc32(name) & (BUCKETS - 1) for name in (b"same", b"again")]
REPEAT_WEIGHT = 4
#: Shares of single features are small; their step is widened by this much.
SCALE = 50.0


def features(text: str | None, lower: bool, repeats: bool) -> Iterator[tuple[np.ndarray, int]]:
    """Rows of the embedding matrix, block by block, with the weight of each entry."""
    text = (text or "").lower() if lower else text or ""
    words: list[np.ndarray] = []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    at = 0
    while at < len(codes):
        part = codes[at : at + BLOCK]
        space = SPACE.take(part, mode="clip")
        if at + BLOCK < len(codes) and (gaps := np.flatnonzero(space)).size:
            # A block ends after white space, unless it is one long word.
            part, space = part[: gaps[-1] + 1], space[: gaps[-1] + 1]
        at += len(part)
        blank = np.ones(len(part) + 2, bool)
        blank[1:-1] = space
        # All white space is one letter, and none is zero, so that no n-gram hides a shorter one.
        letters = np.ones(len(blank), np.uint32)
        np.add(part, 2, out=letters[1:-1])
        letters[blank] = 1
        size = len(blank)
        # Two letters: not both white space. Longer ones: white space at the ends alone.
        grown = letters[:-1] * _P + letters[1:]
        mixed = (grown ^ (grown >> _HALF)) * _M
        yield (mixed * _K)[~(blank[:-1] & blank[1:])] >> _TOP, 1
        skip = np.zeros(size - 1, bool)
        for n in (3, 4):
            grown = grown[:-1] * _P + letters[n - 1 :]
            skip = skip[:-1] | blank[n - 2 : size - 1]
            yield ((grown ^ (grown >> _HALF)) * _K)[~skip] >> _TOP, 1
        # A word's hash is the sum of those of its letter pairs.
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        sums = np.cumsum(mixed, dtype=np.uint32)
        starts, stops = edge[::2], edge[1::2]
        hashes = sums[stops] - sums[starts] + mixed[starts]
        yield ((hashes ^ (hashes >> _HALF)) * _P) >> _TOP, 1
        words.append(hashes)
    if repeats and words:
        every = np.concatenate(words)
        same = int((every[:-1] == every[1:]).sum())
        pairs = np.sort((every[:-1] * _K) ^ every[1:])
        again = int((pairs[:-1] == pairs[1:]).sum())
        for row, n in zip(REPEATS, (same, again), strict=True):
            yield np.full(n, row, np.uint32), REPEAT_WEIGHT


@dataclass
class Model:
    """``rows``: per class but the first, each embedding row's share of the logit's distance
    to the first class's.

    ``lower``: words are lower-cased. ``repeats``: with the features of a word that follows
    itself and of a word pair that the document held before.
    """

    classes: list
    rows: np.ndarray
    bias: np.ndarray
    temperature: float
    lower: bool
    repeats: bool

    def logits(self, text: str | None) -> np.ndarray:
        total, weight = np.zeros(len(self.classes)), 0
        for rows, each in features(text, self.lower, self.repeats):
            for c, share in enumerate(self.rows, 1):
                total[c] += each * share.take(rows).sum(dtype=np.float64)
            weight += each * len(rows)
        return total / max(weight, 1) + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


def counts(text: str | None, lower: bool, repeats: bool) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of a text and how much of each there is."""
    full = np.zeros(BUCKETS, np.float32)
    for rows, each in features(text, lower, repeats):
        full += each * np.bincount(rows.astype(np.int64), minlength=BUCKETS).astype(np.float32)
    at = np.flatnonzero(full)
    return at, full[at]


def sample(rows: DataFrame, label: str, per_class: int, classes: int, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``label`` of at most ``per_class * classes`` rows, shared out among the classes.

    Up to ``classes`` classes have ``per_class`` rows each, more classes have fewer. A class's
    rows are those with the smallest hash of the id: the same for the same data. A count of
    hashes by their highest bits tells up to where rows are needed, so only these are shuffled.
    """
    bound = per_class * classes
    mark = F.xxhash64(id_col)
    marked = rows.select(id_col, label, F.shiftright(mark, 64 - SLICE_BITS).alias("_slice"))
    held = marked.groupBy(label, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(label).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    needed = held.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < per_class)
    # One row for each class, of which no more than ``bound`` can have a share.
    last = needed.groupBy(label).agg(F.max("_slice").alias("_last")).orderBy(label).limit(bound)
    few = marked.join(F.broadcast(last), label).filter(F.col("_slice") <= F.col("_last")).select(id_col, label)
    ranked = few.withColumn("_n", F.row_number().over(W.partitionBy(label).orderBy(mark, F.col(id_col))))
    return ranked.filter(F.col("_n") <= per_class).orderBy("_n", label).limit(bound).drop("_n")


def featurized(
    docs: DataFrame,
    chosen: DataFrame,
    label: str,
    bound: int,
    id_col: str,
    text_col: str,
    lower: bool,
    repeats: bool,
) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(label, rows, counts) of the chosen documents: at most ``bound`` of them, and ``BYTES`` bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_rows(batches):
            found = [counts(text, lower, repeats) for text in batch.column(1).to_pylist()]
            packed = [at.astype("<u2").tobytes() + n.astype("<f4").tobytes() for at, n in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["label", "packed"])

    # ``chosen`` has a fixed bound of rows, so it may be sent to every task.
    named = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), id_col)
    hashed = named.select(F.col(label).cast("string").alias("label"), "_text", F.xxhash64(id_col, "_text").alias("_h"))
    # Ids may repeat; the bound holds all the same.
    packed = hashed.mapInArrow(_with_rest(run), "label string, packed binary, h long").orderBy("h").limit(bound)
    so_far = F.sum(F.length("packed")).over(W.orderBy("h").rowsBetween(W.unboundedPreceding, 0))
    out = []
    for row in packed.withColumn("_bytes", so_far).filter(F.col("_bytes") <= BYTES).drop("_bytes").collect():
        n = len(row["packed"]) // 6
        at = np.frombuffer(row["packed"], "<u2", n).astype(np.int64)
        out.append((row["label"], at, np.frombuffer(row["packed"], "<f4", n, 2 * n)))
    return out


def _with_rest(run: Callable) -> Callable:
    """``run`` on the first two columns, with the third carried along as ``h``."""

    def both(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_rows(batches):
            for done in run([batch]):
                yield pa.RecordBatch.from_arrays([*done.columns, batch.column(2)], ["label", "packed", "h"])

    return both


def train(
    rows: list[tuple[str, np.ndarray, np.ndarray]],
    classes: list,
    prior: np.ndarray,
    lower: bool,
    repeats: bool,
    epochs: int = 8,
    rate: float = 0.5,
    seed: int = 7,
) -> Model:
    """Fits both layers on four fifths of ``rows`` and the temperature on the rest.

    Classes weigh alike while learning; ``prior``, the classes' shares, is added to the
    bias afterwards.
    """
    rng = np.random.default_rng(seed)
    k, place = len(classes), {c: i for i, c in enumerate(classes)}
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
    data = [(place[label], at, n / max(n.sum(), 1)) for label, at, n in rows]
    held = [d for i, d in enumerate(data) if i % 5 == 0] if len(data) >= 50 else []
    used = [d for i, d in enumerate(data) if i % 5] if held else data
    sizes = np.bincount([y for y, _, _ in used], minlength=k)
    weight = np.minimum(len(used) / (k * np.maximum(sizes, 1)), 5.0)
    steps, done = max(1, epochs * len(used)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(used)):
            y, at, share = used[i]
            step = rate * (1 - done / steps) * weight[y]
            own = embed[at]
            hidden = share @ own
            z = hidden @ out + bias
            error = np.exp(z - z.max())
            error /= error.sum()
            error[y] -= 1
            back = out @ error
            out -= step * np.outer(hidden, error)
            bias -= 0.1 * step * error
            # The rows of a document are distinct, so plain assignment adds each once.
            embed[at] = own - (SCALE * step * share)[:, None] * back
            done += 1
    shares = embed @ (out[:, 1:] - out[:, :1])
    bias = bias + np.log(np.maximum(prior, 1e-6) * k)
    model = Model(list(classes), np.ascontiguousarray(shares.T), bias, 1.0, lower, repeats)
    if held:
        logits = np.array([np.append(0, share @ shares[at]) + bias for _, at, share in held])
        truth = np.array([y for y, _, _ in held])

        def loss(t: float) -> float:
            model.temperature = t
            p = model.probabilities(logits)[np.arange(len(truth)), truth]
            return float(-np.log(np.maximum(p, 1e-12)) @ (prior * k)[truth])

        model.temperature = min(np.geomspace(0.25, 4.0, 33), key=loss)
    return model


def score_udf(
    model: Model, finish: Callable[[str | None, np.ndarray], tuple], schema: str
) -> Callable[[Column], Column]:
    """A column function text -> struct ``schema``; ``finish`` gets the text and its logits."""
    names = [part.split()[0] for part in schema.split(",")]

    @F.pandas_udf(schema)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([finish(t, model.logits(t)) for t in texts], columns=names)

    return score
