"""Quality rules: gradient-boosted trees over statistics of a document.

A document is described by counts that rules of thumb look at (words, symbols, repeated
lines and passages) and by shares made from them. Trees boosted on the logistic loss turn the
shares into a score. For chosen statistics the score may only fall: more symbols or more
repetition never make a document look better. A split that would break the order is not
taken, and the leaves below a split stay on their side of its middle.

The fitted trees are flattened into arrays of nodes (statistic, threshold, children, value), and
all rows of a batch go down all trees together, one level at a time. Two plain rules hold in
front: too few words, or too many of them in repeated passages.

One pass over the texts does everything; only the bounded sample that is learned from reaches
the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contest_analytics.llm.common import fold, text_rows
from contest_analytics.llm.subword import sample

#: Most labelled rows of a class that the trees are fitted on.
PER_CLASS = 1500
#: Documents with fewer words, or with a larger share (in hundredths) of words in repeated
#: passages of ``PASSAGE`` words, fail.
FEWEST, REPEATED, PASSAGE = 20, 30, 8
#: Least score of a document that is kept.
LEAST = 0.3
SYMBOLS = b"#*$%&|<>"
TREES, DEPTH, RATE, BINS = 60, 4, 0.2, 64
#: Pulls leaf values to zero; least curvature (about a quarter of the weight of its rows) of a leaf.
RIDGE, LIGHTEST = 1.0, 1.0

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that trees split on, and the direction in which the score must not rise.
STATISTICS = {
    "log_words": 0,
    "word_length": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "digit_share": -1,
    "other_punctuation": 0,
    "sentence_ends": 0,
    "wide_share": 0,
    "distinct_share": 0,
    "top_word_share": -1,
    "short_word_share": 0,
    "log_longest": 0,
    "words_a_line": 0,
}

_BYTES = np.arange(256)
_SPACE = np.isin(_BYTES, list(b" \t\n\v\f\r"))
_TAIL = (_BYTES & 0xC0) == 0x80
_SYMBOL = np.isin(_BYTES, list(SYMBOLS))
_UPPER, _LOWER = (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_END = np.isin(_BYTES, list(b".!?"))
_PUNCTUATION = (_BYTES > 32) & (_BYTES < 127) & ~(_UPPER | _LOWER | _DIGIT | _SYMBOL) & ~np.isin(_BYTES, list(b".,"))


def repeated_words(ids: np.ndarray, size: int = PASSAGE) -> int:
    """Words inside windows of ``size`` words that occur twice or more; ``ids`` number equal words alike.

    Windows of 1, 2, 4 ... words get the rank of the pair of halves they consist of, so equal
    ranks are equal windows. Once no window repeats, no longer one can.
    """
    if size & (size - 1):
        raise ValueError("the window must be a power of two")
    if len(ids) < size:
        return 0
    rank, width = ids.astype(np.int64), 1
    while True:
        _, rank, n = np.unique(rank, return_inverse=True, return_counts=True)
        if width == size:
            break
        if len(n) == len(rank):
            return 0
        rank = rank[: len(rank) - width] * len(n) + rank[width:]
        width *= 2
    starts = np.flatnonzero(n[rank] > 1)
    if not len(starts):
        return 0
    # Windows that overlap share words.
    return int(np.minimum(np.diff(starts), size).sum()) + size


def describe(text: bytes | None) -> tuple[list[int], list[float]]:
    """The counts ``BASE`` and the ``STATISTICS`` of one text in UTF-8."""
    text = text or b""
    words = text.split()
    n = len(words)
    of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = len(text) - int(of[_TAIL].sum())
    word_chars = points - int(of[_SPACE].sum())
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    dup_lines = len(lines) - len(set(lines))
    # Every new word gets the next number.
    known: dict[bytes, int] = {}
    fresh = count()
    ids = np.fromiter((known[w] if w in known else known.setdefault(w, next(fresh)) for w in words), np.int64, n)
    repeats = repeated_words(ids)
    symbols = int(of[_SYMBOL].sum())
    lengths = np.fromiter(map(len, known), np.int64, len(known))
    often = np.bincount(ids, minlength=len(known))
    chars, total, letters = max(word_chars, 1), max(n, 1), max(int(of[_UPPER | _LOWER].sum()), 1)
    shares = [
        np.log1p(n),
        word_chars / total,
        symbols / chars,
        dup_lines / max(len(lines), 1),
        repeats / total,
        int(of[_UPPER].sum()) / letters,
        int(of[_DIGIT].sum()) / chars,
        int(of[_PUNCTUATION].sum()) / chars,
        int(of[_END].sum()) / total,
        int(of[_BYTES >= 0xC0].sum()) / chars,
        len(known) / total,
        int(often.max(initial=0)) / total,
        int(often[lengths == 1].sum()) / total,
        np.log1p(int(lengths.max(initial=0))),
        np.log1p(n / max(len(lines), 1)),
    ]
    return [n, word_chars, symbols, dup_lines, repeats], [float(s) for s in shares]


def failed(base: np.ndarray) -> np.ndarray:
    """Which rows of ``BASE`` counts the plain rules reject."""
    n, repeats = base[:, 0], base[:, 4]
    return (n < FEWEST) | (100 * repeats > REPEATED * n)


@dataclass
class Trees:
    """All trees as arrays of nodes; a row goes left if its statistic is at most the threshold.

    A leaf is its own child. ``roots``: the first node of each tree; ``start``: the score's
    log odds before any tree.
    """

    statistic: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        at = np.broadcast_to(self.roots, (len(rows), len(self.roots)))
        place = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            down = rows[place, self.statistic[at]] <= self.threshold[at]
            at = np.where(down, self.left[at], self.right[at])
        odds = self.start + self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def _edges(rows: np.ndarray, bins: int) -> list[np.ndarray]:
    """Thresholds to try for each statistic: middles between neighbouring quantiles."""
    found = []
    for column in rows.T:
        points = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="nearest"))
        found.append((points[1:] + points[:-1]) / 2)
    return found


def boost(
    rows: np.ndarray,
    labels: np.ndarray,
    weights: np.ndarray,
    order: np.ndarray,
    trees: int = TREES,
    depth: int = DEPTH,
    rate: float = RATE,
    bins: int = BINS,
) -> Trees:
    """Newton boosting on histograms; ``order`` is the sign of each statistic's allowed effect.

    Rows of one class, or none, give no trees: every score is the smoothed share of label 1.
    """
    one = float((weights * labels).sum())
    start = float(np.log((one + 0.5) / (weights.sum() - one + 0.5)))
    nodes: list[list[float]] = []  # statistic, threshold, left, right, value
    roots: list[int] = []
    edges = _edges(rows, bins) if len(rows) else []
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, rows.T, strict=True)]) if len(rows) else rows
    odds = np.full(len(rows), start)

    def best_split(own: np.ndarray, slope: np.ndarray, curve: np.ndarray, low: float, high: float) -> tuple | None:
        g, h = slope[own].sum(), curve[own].sum()
        best = None
        for f, edge in enumerate(edges):
            if not len(edge):
                continue
            gl = np.cumsum(np.bincount(binned[own, f], slope[own], len(edge) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[own, f], curve[own], len(edge) + 1))[:-1]
            wl, wr = np.clip(-gl / (hl + RIDGE), low, high), np.clip((gl - g) / (h - hl + RIDGE), low, high)
            gain = -(gl * wl + 0.5 * (hl + RIDGE) * wl**2) - ((g - gl) * wr + 0.5 * (h - hl + RIDGE) * wr**2)
            fine = (hl >= LIGHTEST) & (h - hl >= LIGHTEST) & (order[f] * (wr - wl) >= 0)
            gain = np.where(fine, gain, -np.inf)
            at = int(gain.argmax())
            if np.isfinite(gain[at]) and (best is None or gain[at] > best[0] + 1e-12):
                best = (gain[at], f, at, wl[at], wr[at])
        whole = np.clip(-g / (h + RIDGE), low, high)
        stay = -(g * whole + 0.5 * (h + RIDGE) * whole**2)
        return best if best is not None and best[0] > stay + 1e-9 else None

    def build(own: np.ndarray, slope: np.ndarray, curve: np.ndarray, left: int, low: float, high: float) -> int:
        node = len(nodes)
        value = rate * float(np.clip(-slope[own].sum() / (curve[own].sum() + RIDGE), low, high))
        nodes.append([0, np.inf, node, node, value])
        split = best_split(own, slope, curve, low, high) if left else None
        if split is None:
            odds[own] += value
            return node
        _, f, at, wl, wr = split
        middle = (wl + wr) / 2
        ends = {0: ((low, high), (low, high)), -1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high))}[int(order[f])]
        goes = binned[own, f] <= at
        nodes[node][:2] = [f, float(edges[f][at])]
        nodes[node][2] = build(own[goes], slope, curve, left - 1, *ends[0])
        nodes[node][3] = build(own[~goes], slope, curve, left - 1, *ends[1])
        nodes[node][4] = 0.0
        return node

    if len(rows) and labels.min() != labels.max():
        everyone = np.arange(len(rows))
        for _ in range(trees):
            p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
            roots.append(build(everyone, weights * (p - labels), weights * np.maximum(p * (1 - p), 1e-6), depth, -np.inf, np.inf))
    table = np.array(nodes, float).reshape(-1, 5)
    statistic, left, right = (table[:, i].astype(np.int32) for i in (0, 2, 3))
    return Trees(statistic, table[:, 1], left, right, table[:, 4], np.array(roots, np.int32), depth, start)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    per_class: int = PER_CLASS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Trees:
    """Trees for ``label`` (0 or 1) from rows whose crc32(id) mod 5 is not 0.

    The sample has at most ``per_class`` rows of a label, weighted so that both have their share.
    """
    known = labels.select(F.col("doc_id").alias(id_col), F.col(label).cast("int").alias("_label")).filter(
        F.col(id_col).isNotNull() & F.col("_label").isin(0, 1) & (fold(id_col) != 0)
    )
    sizes = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    # The sample has a fixed bound of rows, so it may be sent to every task.
    chosen = sample(known, "_label", per_class, 2, id_col)
    named = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), id_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_rows(batches):
            found = pa.array([describe(t)[1] for t in batch.column(0).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([found, batch.column(1), batch.column(2)], ["found", "label", "h"])

    hashed = named.select(
        F.col("_text").cast("binary"), F.col("_label").alias("label"), F.xxhash64(id_col, "_text").alias("h")
    )
    few = hashed.mapInArrow(run, "found array<double>, label int, h long").orderBy("h").limit(2 * per_class).collect()
    y = np.array([r["label"] for r in few], int)
    held = np.maximum(np.bincount(y, minlength=2), 1)
    total = max(sum(sizes.values()), 1)
    weights = np.array([sizes.get(c, 0) / total * len(y) / held[c] for c in (0, 1)])[y]
    rows = np.array([r["found"] for r in few], float).reshape(len(few), len(STATISTICS))
    return boost(rows, y, weights, np.array(list(STATISTICS.values())))


def apply(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts ``BASE``, ``base_failed``, ``score`` and ``kept`` of every row.

    A row is kept if the plain rules do not reject it and its score is ``LEAST`` or more.

    Defined cases: null, empty and blank texts have no words and fail; null ids stay and are not
    learned from; without labels of both classes every score is their smoothed share; repeated
    rows stay; other columns are ignored; an empty table gives no rows. Words are parted by the
    six ASCII white-space characters alone; every other character belongs to a word.
    """
    trees = fit(docs, labels, id_col=id_col, text_col=text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_rows(batches):
            found = [describe(t) for t in batch.column(1).to_pylist()]
            base = np.array([b for b, _ in found], np.int64).reshape(-1, len(BASE))
            rows = np.array([s for _, s in found], float).reshape(len(found), len(STATISTICS))
            score, bad = trees.score(rows), failed(base)
            columns = [batch.column(0), *map(pa.array, base.T), pa.array(bad), pa.array(score), pa.array(~bad & (score >= LEAST))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *BASE, "base_failed", "score", "kept"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    counts = ", ".join(f"{c} long" for c in BASE)
    return slim.mapInArrow(run, f"doc_id long, {counts}, base_failed boolean, score double, kept boolean")
