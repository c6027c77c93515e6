"""Hard negatives by integer inner products, with angular triangle filtering.

An anchor's positives are its best rows of the same label; a hard negative is a row of
another label whose score is a given share of a positive's score: close, yet not so close that
it is likely a positive in disguise. Scores are exact inner products of scaled integer
vectors.

**Filtering.** Every row stores its norm and its angles to ``REFERENCES`` directions. For an
anchor at angle a and a row at angle t to the same direction, the angle between the two lies
between |a - t| and min(a + t, 2 pi - a - t). The tightest interval over all directions, as
cosines times both norms, bounds the score; a slack far above the rounding of angles and
cosines keeps it safe. Only pairs whose interval meets the anchor's window are scored. For
positives the window starts at the anchor's ``positives``-th best score in a bounded sample of
the table, which the whole table can only beat; for negatives it is the window of the positives'
scores, from the ``negatives``-th best of the sample on.

**Spark.** Rows belong to the zone of their nearest direction. A zone's ranges of angles and norms
are a table of fixed size, so whole zones are dropped for an anchor before anything is
shuffled. What is left of the stated anchors meets the rows in blocks: a zone is dealt to slices
and the anchors to blocks, both of bounded size, whatever labels they have; a task returns only
its best rows of an anchor and positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contest_analytics.llm.common import saved
from contest_analytics.llm.vector_codes import scaled

POSITIVES, NEGATIVES = 5, 3
#: Least and greatest score of a negative, in hundredths of the positive's.
LEAST, MOST = 50, 95
REFERENCES = 16
#: Rows, of the smallest hash of the id, that directions and first thresholds come from.
SAMPLE = 2000
#: Components of the rows of a slice, anchors of a block, and anchors that are bounded in one go.
CELLS, BLOCK, CHUNK = 1 << 21, 4096, 32
#: Above the rounding of stored angles (radians) and of a bound, as a share of both norms.
ANGLE_SLACK, SCORE_SLACK = 2e-6, 1e-9
#: Products up to this size are exact as doubles.
EXACT = 2.0**52


@dataclass
class Frame:
    """The directions (unit rows) and the sample: ids, labels and integer vectors."""

    width: int
    directions: np.ndarray
    names: np.ndarray
    labels: np.ndarray
    sample: np.ndarray

    def angles(self, vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Angles to the directions; a quarter turn for zero vectors, whose scores are all zero."""
        cosine = vectors @ self.directions.T / np.maximum(norms, 1e-300)[:, None]
        return np.arccos(np.clip(cosine, -1, 1)).astype(np.float32)


def directions(sample: np.ndarray, number: int = REFERENCES) -> np.ndarray:
    """Vectors of the sample, each as far as can be in angle from those before it."""
    norms = np.sqrt((sample * sample).sum(axis=1))
    unit = sample[norms > 0] / norms[norms > 0][:, None]
    if not len(unit):
        return np.zeros((1, sample.shape[1]))
    picked = [0]
    nearest = unit @ unit[0]
    while len(picked) < min(number, len(unit)):
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[picked[-1]])
    return unit[picked]


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products, (anchors, rows). Both come as whole doubles."""
    largest = np.sqrt((anchors**2).sum(axis=1).max(initial=0) * (rows**2).sum(axis=1).max(initial=0))
    if largest < EXACT:
        return (anchors @ rows.T).astype(np.int64)
    return anchors.astype(np.int64) @ rows.astype(np.int64).T


def bounds(
    angles: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray, small: np.ndarray, large: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each anchor with each row, (anchors, rows).

    A row may be a whole zone: its angles are between ``low`` and ``high`` (rows, directions)
    and its norm between ``small`` and ``large``.
    """
    near = np.zeros((len(angles), len(low)), np.float32)
    far = np.full_like(near, np.pi)
    for r in range(angles.shape[1]):
        own = angles[:, r, None]
        np.maximum(near, np.maximum(own - high[:, r], low[:, r] - own), out=near)
        # The widest angle at this direction: of those between low and high, the one nearest to pi - own.
        there = np.minimum(np.maximum(np.float32(np.pi) - own, low[:, r]), high[:, r])
        np.minimum(far, np.float32(np.pi) - np.abs(own + there - np.float32(np.pi)), out=far)
    top, bottom = np.cos(np.maximum(near - ANGLE_SLACK, 0)), np.cos(np.minimum(far + ANGLE_SLACK, np.pi))
    slack = SCORE_SLACK * norms[:, None] * large + 1
    upper = norms[:, None] * np.where(top > 0, large, small) * top + slack
    lower = norms[:, None] * np.where(bottom > 0, small, large) * bottom - slack
    return lower, upper


def windows(scores: np.ndarray, least: int = LEAST, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole negative score of each positive's score; empty if it is below zero."""
    return -(-least * scores // 100), most * scores // 100


def first(scores: np.ndarray, names: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores, ties to the smaller name."""
    if len(scores) > n:
        spots = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
    else:
        spots = np.arange(len(scores))
    return spots[np.lexsort((names[spots], -scores[spots]))[:n]]


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as doubles, filled with zeros to ``width``."""
    data = np.zeros((len(vectors), width))
    data[np.arange(width) < vectors.value_lengths().to_numpy()[:, None]] = vectors.flatten().to_numpy()
    return data


def _flat(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    column = table.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(list(rows), pa.list_(kind))


def clean(rows: DataFrame, label: Column, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id``, ``label`` (text) and ``vec`` (integers) of the rows that take part."""
    return rows.select(
        F.col(id_col).cast("long").alias("vec_id"), label.cast("string").alias("label"), scaled(F.col(vec_col)).alias("vec")
    ).filter("vec_id is not null and label is not null and vec is not null")


def one_of_each(rows: DataFrame) -> DataFrame:
    """Of the rows that share an id the one with the smallest label, then vector."""
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.label", "r.vec")


def frame(rows: DataFrame, sample: int = SAMPLE, references: int = REFERENCES) -> Frame:
    """Directions and thresholds' sample from :func:`clean` rows, before equal ids are merged."""
    width = max(1, rows.agg(F.max(F.size("vec"))).first()[0] or 0)
    first_rows = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "vec").limit(sample + 1).toArrow()
    names = np.asarray(_flat(first_rows, "vec_id").to_numpy())
    # The first row of an id is the one that stays; every id of the sample is whole or at its start.
    kept = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])[:sample] if len(names) else np.empty(0, np.int64)
    some = first_rows.take(pa.array(kept))
    vectors = _matrix(_flat(some, "vec"), width)
    labels = np.array(_flat(some, "label").to_pylist(), object)
    return Frame(width, directions(vectors, references), names[kept], labels, vectors)


def placed(rows: DataFrame, known: Frame) -> DataFrame:
    """``rows`` with ``norm``, ``angles`` to the directions and ``zone``, the nearest of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(2), known.width)
            norms = np.sqrt((vectors * vectors).sum(axis=1))
            angles = known.angles(vectors, norms)
            more = [pa.array(norms), _lists(angles, pa.float32()), pa.array(angles.argmin(axis=1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], ["vec_id", "label", "vec", "norm", "angles", "zone"])

    schema = "vec_id long, label string, vec array<int>, norm double, angles array<float>, zone int"
    return rows.select("vec_id", "label", "vec").mapInArrow(run, schema)


@dataclass
class Zones:
    """For each zone with rows: its number, its slices, and its ranges of angles and norms."""

    zone: np.ndarray
    slices: np.ndarray
    low: np.ndarray
    high: np.ndarray
    small: np.ndarray
    large: np.ndarray


def zones(rows: DataFrame, known: Frame) -> Zones:
    """At most one row for each direction: a fixed number, whatever the data."""
    number = len(known.directions)
    ends = [f(F.get("angles", F.lit(r))).alias(f"{n}{r}") for r in range(number) for n, f in (("low", F.min), ("high", F.max))]
    found = rows.groupBy("zone").agg(
        F.count(F.lit(1)).alias("n"), F.min("norm").alias("small"), F.max("norm").alias("large"), *ends
    ).collect()
    per_slice = max(1, CELLS // known.width)
    low, high = (np.array([[r[f"{n}{i}"] for i in range(number)] for r in found], np.float32).reshape(-1, number) for n in ("low", "high"))
    return Zones(
        np.array([r["zone"] for r in found], np.int64),
        np.array([ceil(r["n"] / per_slice) for r in found], np.int64),
        low,
        high,
        np.array([r["small"] for r in found], float),
        np.array([r["large"] for r in found], float),
    )


#: Decides the scores that an anchor needs: least and greatest, given its vector, label, id and positives.
Window = Callable[[np.ndarray, str, int, list], tuple[float, float]]


def _asked(anchors: DataFrame, known: Frame, held: Zones, blocks: int, window: Window, schema: str) -> DataFrame:
    """Every anchor in the cells it must visit, with the window ``least`` to ``most`` of its scores.

    ``anchors``: as :func:`placed`, further columns of ``schema`` last.
    """
    extra = [part.split()[0] for part in schema.split(", ") if part]
    names = ["vec_id", "label", "vec", "norm", "angles", *extra]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(2), known.width)
            angles = np.array(batch.column(4).to_pylist(), np.float32).reshape(batch.num_rows, -1)
            norms = batch.column(3).to_numpy()
            given = batch.column(5).to_pylist() if extra else [None] * batch.num_rows
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            ends = np.array([window(v, n, i, g) for v, n, i, g in zip(vectors, labels, ids, given, strict=True)], float).reshape(-1, 2)
            lower, upper = bounds(angles, norms, held.low, held.high, held.small, held.large)
            of, where = np.nonzero((lower <= ends[:, 1:]) & (upper >= ends[:, :1]))
            slices = held.slices[where]
            of, where = np.repeat(of, slices), np.repeat(where, slices)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(slices) - slices, slices)
            more = [held.zone[where], nth, ends[of, 0], ends[of, 1]]
            columns = [c.take(pa.array(of)) for c in batch.columns] + [pa.array(m) for m in more]
            yield pa.RecordBatch.from_arrays(columns, [*names, "zone", "slice", "least", "most"])

    full = "vec_id long, label string, vec array<int>, norm double, angles array<float>"
    cells = anchors.select(*names).mapInArrow(
        run, f"{full}{', ' if schema else ''}{schema}, zone long, slice long, least double, most double"
    )
    return cells.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))


def _dealt(rows: DataFrame, held: Zones, blocks: int) -> DataFrame:
    """Every row in its slice, once for each block of anchors."""
    number = F.lit(1).cast("long")
    for zone, n in zip(held.zone.tolist(), held.slices.tolist(), strict=True):
        number = F.when(F.col("zone") == zone, F.lit(n)).otherwise(number)
    return rows.select(
        "vec_id",
        "label",
        "vec",
        "norm",
        "angles",
        F.col("zone").cast("long").alias("zone"),
        F.pmod(F.xxhash64("vec_id"), number).alias("slice"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
    )


@dataclass
class Side:
    """One side of a cell as arrays; labels are numbered alike on both."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    angles: np.ndarray

    def at(self, spots: np.ndarray) -> Side:
        return Side(self.ids[spots], self.labels[spots], self.vectors[spots], self.norms[spots], self.angles[spots])


def _sides(anchors: pa.Table, rows: pa.Table, width: int) -> tuple[Side, Side]:
    labels = pa.concat_arrays([_flat(anchors, "label"), _flat(rows, "label")]).dictionary_encode().indices.to_numpy()
    out = []
    for table, own in ((anchors, labels[: len(anchors)]), (rows, labels[len(anchors) :])):
        angles = _flat(table, "angles").flatten().to_numpy().reshape(len(table), -1)
        ids, norms = _flat(table, "vec_id").to_numpy(), _flat(table, "norm").to_numpy()
        out.append(Side(ids, own, _matrix(_flat(table, "vec"), width), norms, angles))
    return out[0], out[1]


def scored(asked: Side, held: Side, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor with any: (its place, places of the rows, their scores) of all pairs whose
    bounds meet the anchor's window."""
    for at in range(0, len(asked.ids), CHUNK):
        mine = asked.at(np.arange(at, min(at + CHUNK, len(asked.ids))))
        lower, upper = bounds(mine.angles, mine.norms, held.angles, held.angles, held.norms, held.norms)
        meet = (lower <= most[at : at + CHUNK, None]) & (upper >= least[at : at + CHUNK, None])
        rows = np.flatnonzero(meet.any(axis=0))
        if len(rows):
            exact = products(mine.vectors, held.vectors[rows])
            for i in range(len(mine.ids)):
                own = meet[i, rows]
                if own.any():
                    yield at + i, rows[own], exact[i, own]


def _positives(width: int, number: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(anchors) and len(rows):
            asked, held = _sides(anchors, rows, width)
            least, most = _flat(anchors, "least").to_numpy(), _flat(anchors, "most").to_numpy()
            for label in np.intersect1d(asked.labels, held.labels):
                ours, theirs = np.flatnonzero(asked.labels == label), np.flatnonzero(held.labels == label)
                alike = held.at(theirs)
                for i, spots, scores in scored(asked.at(ours), alike, least[ours], most[ours]):
                    me = asked.ids[ours[i]]
                    names, other = alike.ids[spots], alike.ids[spots] != me
                    names, scores = names[other], scores[other]
                    best = first(scores, names, number)
                    out.append((np.full(len(best), me), names[best], scores[best]))
        return pa.table(dict(zip(("anchor_id", "positive_id", "positive_score"), _columns(out, 3), strict=True)))

    return run


def _negatives(width: int, number: int, least_share: int, most_share: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(anchors) and len(rows):
            asked, held = _sides(anchors, rows, width)
            least, most = _flat(anchors, "least").to_numpy(), _flat(anchors, "most").to_numpy()
            given = _flat(anchors, "positives").to_pylist()
            for i, spots, scores in scored(asked, held, least, most):
                other = held.labels[spots] != asked.labels[i]
                names, scores = held.ids[spots[other]], scores[other]
                of = np.array([p["positive_score"] for p in given[i]], np.int64)
                for p, low, high in zip(given[i], *windows(of, least_share, most_share), strict=True):
                    inside = np.flatnonzero((scores >= low) & (scores <= high))
                    best = inside[first(scores[inside], names[inside], number)]
                    n = len(best)
                    fixed = [np.full(n, x) for x in (asked.ids[i], p["positive_id"], p["positive_score"])]
                    out.append((*fixed, names[best], scores[best]))
        fields = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
        return pa.table(dict(zip(fields, _columns(out, 5), strict=True)))

    return run


def _columns(found: list[tuple[np.ndarray, ...]], number: int) -> list[np.ndarray]:
    if not found:
        return [np.empty(0, np.int64)] * number
    return [np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True)]


def _sample_floor(known: Frame, number: int) -> Window:
    """Scores from the ``number``-th best of the same label in the sample on: the table has no fewer."""

    def window(vector: np.ndarray, label: str, name: int, _: list) -> tuple[float, float]:
        own = (known.labels == label) & (known.names != name)
        scores = products(vector[None], known.sample[own])[0]
        return (float(np.sort(scores)[-number]) if len(scores) >= number else -np.inf), np.inf

    return window


def _positive_windows(known: Frame, number: int, least_share: int, most_share: int) -> Window:
    """The hull of the positives' windows, each from the ``number``-th best of the sample on."""

    def window(vector: np.ndarray, label: str, name: int, given: list) -> tuple[float, float]:
        of = np.array([p["positive_score"] for p in given], np.int64)
        scores = products(vector[None], known.sample[known.labels != label])[0]
        least, most = np.inf, -np.inf
        for low, high in zip(*windows(of, least_share, most_share), strict=True):
            inside = scores[(scores >= low) & (scores <= high)]
            floor = float(np.sort(inside)[-number]) if len(inside) >= number else float(low)
            if low <= high:
                least, most = min(least, floor), max(most, float(high))
        return least, most

    return window


def mine(
    rows: DataFrame,
    anchors: Column,
    label: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``anchors`` is a condition on ``vec_id``; every other row is a candidate. Positives are the
    ``positives`` best other rows of the anchor's label; for each of them the ``negatives`` best
    rows of other labels whose score is ``least`` to ``most`` hundredths of the positive's.
    Ties go to the smaller id. Scores are inner products of floor(256 * x).

    Defined cases: rows with a null id or label, or whose vector is null or holds a null, a number
    that is not finite, or one of 131,072 or more (a product would not fit in a long), take no
    part; of rows that share an id the one with the smallest label, then vector, stays; vectors
    shorter than the longest count as filled with zeros; zero vectors score zero with all;
    anchors without positives or without rows in a window have no rows; a positive's score below
    zero has an empty window; an empty table gives no rows; other columns are ignored.
    """
    fine = clean(rows, label, id_col, vec_col)
    known = frame(fine)
    held = saved(placed(one_of_each(fine), known))
    areas = zones(held, known)
    chosen = held.filter(anchors)
    blocks = max(1, ceil(chosen.count() / BLOCK))
    cell = ["zone", "slice", "block"]
    dealt = _dealt(held, areas, blocks)

    def meet(asked: DataFrame, solve: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        # Both sides stem from one table; new names for one of them tell their columns apart.
        other = dealt.toDF(*dealt.columns)
        return asked.groupBy(*cell).cogroup(other.groupBy(*cell)).applyInArrow(solve, schema)

    pairs = meet(
        _asked(chosen, known, areas, blocks, _sample_floor(known, positives), ""),
        _positives(known.width, positives),
        "anchor_id long, positive_id long, positive_score long",
    )
    best = W.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    top = pairs.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= positives).drop("_n")
    # At most ``positives`` structs for an anchor.
    given = saved(top.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")))
    full = chosen.join(given.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    kind = "positives array<struct<positive_id:long,positive_score:long>>"
    found = meet(
        _asked(full, known, areas, blocks, _positive_windows(known, negatives, least, most), kind),
        _negatives(known.width, negatives, least, most),
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
