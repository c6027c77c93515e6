"""Approximate nearest neighbours by p-stable hashing with several probes per table.

Each of ``TABLES`` hash tables has its own Gaussian projections; a vector's bucket is
the tuple of its projections' cells of width ``w``. A query looks into its own bucket
first and then into perturbed ones (one or more cells moved), in the order of the
estimated probability that a neighbour at the query's own radius lies there: a product, over
the projections, of the Gaussian mass of the cell around the query's own projection. It goes
on until the buckets visited hold ``SUCCESS`` of that mass. Candidates of all tables are
merged and ranked by their exact distance. One table finds a neighbour with probability
``SUCCESS`` at least, ``TABLES`` of them with 1 - (1 - SUCCESS) ** TABLES.

A query's radius is its distance to the ``k``-th nearest vector of a bounded sample of the
distinct vectors. The sample is part of the table, so the ``k``-th neighbour in all rows is
never farther, whatever copies and dense places the table has. ``w`` is fitted on the same
sample; every row is indexed. The number of projections follows the logarithm of the number
of distinct vectors, so a bucket's size does not grow with the data. Queries whose radius
takes in more buckets than ``most_buckets``, and those with fewer than ``k`` candidates
found, are compared with all rows, in blocks. Many buckets make a group of bounded size, where a query meets the vectors of all
its buckets there at once and keeps its ``k`` best; a bucket of many vectors is cut into
slices that go to groups of their own. Queries are dealt to blocks, so that no group has more
than about ``ASKED`` of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from math import ceil, erf, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contest_analytics.llm.common import saved, text_rows

TABLES = 4
#: Mass of a neighbour's likely places that a query visits in each table.
SUCCESS = 0.6
#: Distinct vectors that ``w`` is fitted on and that bound each query's radius.
SAMPLE = 2000
#: Rows a bucket should hold; rows of a group, and of a bucket's slice, about.
BUCKET, SLICE = 64, 16_384
#: Queries of a block, about.
ASKED = 4096
#: Moves a bucket's next slice to another group.
STRIDE = 7919
#: Cells of one projection that hold most rows.
CELLS = 2.5
#: Radius, in cells, up to which the cells that :func:`probes` looks at hold nearly all of the mass.
FARTHEST = 1.5
#: Buckets that a query may visit in each table, at most, before the exact way is taken.
VISITS = 65_536


@dataclass
class Index:
    """Projections (tables x projections x dimensions), shifts, cell width, and the sample
    with its ids."""

    planes: np.ndarray
    shifts: np.ndarray
    width: float
    names: np.ndarray
    sample: np.ndarray

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """Projections in units of a cell, (tables, rows, projections)."""
        at = np.einsum("tpd,nd->tnp", self.planes, vectors, optimize=True)
        return (at + self.shifts[:, None, :]) / self.width

    def radii(self, names: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
        """Distances to the ``k``-th other vector of the sample; infinite if it has fewer."""
        if len(self.sample) < k:
            return np.full(len(vectors), np.inf)
        norms = (vectors**2).sum(1)[:, None] + (self.sample**2).sum(1)[None]
        # What rounding may have taken away comes back, so this stays an upper bound.
        gaps = np.maximum(norms - 2 * vectors @ self.sample.T, 0) + 1e-12 * norms
        gaps[names[:, None] == self.names[None]] = np.inf
        return np.maximum(np.sqrt(np.partition(gaps, k - 1, axis=1)[:, k - 1]), 1e-9 * self.width)


def clean(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id`` and ``vec`` (doubles) of rows that take part; equal rows once."""
    vec = F.col(vec_col).cast("array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        rows.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))
        .filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & fine & F.exists("vec", lambda x: x != 0))
    )


def fit(distinct: DataFrame, rows: int, tables: int = TABLES, sample: int = SAMPLE, seed: int = 11) -> Index:
    """Cell width from the ``sample`` distinct vectors with the smallest hash of the id."""
    some = distinct.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    dims = max((len(v) for v in some["vec"]), default=1)
    some = some[[len(v) == dims for v in some["vec"]]]
    data = np.array(some["vec"].tolist()).reshape(-1, dims)
    projections = int(np.clip(round(log(max(rows, 2) / BUCKET, CELLS)), 4, 24))
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((tables, projections, dims))
    spread = float(np.median(np.einsum("tpd,nd->tpn", planes, data).std(axis=2))) if len(data) > 1 else 1.0
    width = max(2.0 * spread, 1e-9)
    shifts = rng.uniform(0, width, (tables, projections))
    return Index(planes, shifts, width, some["vec_id"].to_numpy(), data)


def most_buckets(rows: int) -> int:
    """Buckets of a table beyond which a query is as well compared with all rows."""
    return int(np.clip(rows // BUCKET, BUCKET, VISITS))


def _phi(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * (1 + erf(v / 2**0.5)) for v in x.ravel()]).reshape(x.shape)


def probes(
    place: np.ndarray, reach: float, success: float = SUCCESS, most: int | None = None
) -> list[tuple[int, ...]] | None:
    """Cells to visit for one query in one table, likeliest first.

    ``place``: the query's projections in units of a cell; ``reach``: the radius in the
    same unit. Stops once the visited cells' mass adds up to ``success``. None if that
    takes more than ``most`` cells.
    """
    if most is not None and not reach < FARTHEST:
        return None
    span = int(min(4, ceil(3 * reach) + 1))
    home = np.floor(place).astype(np.int64)
    moves = np.arange(-span, span + 1)
    left = home[:, None] + moves - place[:, None]
    mass = np.maximum(_phi((left + 1) / reach) - _phi(left / reach), 1e-12)
    order = np.argsort(-mass, axis=1, kind="stable")
    cost = -np.log(np.take_along_axis(mass, order, axis=1))
    start = (0,) * len(place)
    heap, seen, found, total = [(float(cost[:, 0].sum()), start)], {start}, [], 0.0
    while heap and total < success:
        if most is not None and len(found) == most:
            return None
        at, picks = heapq.heappop(heap)
        total += np.exp(-at)
        found.append(tuple(int(home[i] + moves[order[i, p]]) for i, p in enumerate(picks)))
        for i, p in enumerate(picks):
            if p + 1 < len(moves):
                later = (*picks[:i], p + 1, *picks[i + 1 :])
                if later not in seen:
                    seen.add(later)
                    heapq.heappush(heap, (at + float(cost[i, p + 1] - cost[i, p]), later))
    return found if most is None or total >= success else None


def _key(table: int, cell: tuple[int, ...]) -> int:
    """A 64-bit name of a bucket; a clash only adds candidates."""
    name = 0xCBF29CE484222325
    for part in (table, *cell):
        name = ((name ^ (part & 0xFFFFFFFF)) * 0x100000001B3) % (1 << 64)
    return name - (1 << 64) if name >= 1 << 63 else name


def _buckets(rows: DataFrame, index: Index) -> DataFrame:
    """``key``, ``vec_id``, ``vec``: each row with its bucket in every table."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own, cells in _placed(batches, index):
            home = np.floor(cells).astype(np.int64)
            keys = [_key(t, c) for t, table in enumerate(home.tolist()) for c in table]
            again = own.take(pa.array(np.tile(np.arange(len(own)), len(home))))
            columns = [pa.array(keys, pa.int64()), batch.column(0).take(again), batch.column(1).take(again)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "vec_id", "vec"])

    return rows.select("vec_id", "vec").mapInArrow(run, "key long, vec_id long, vec array<double>")


def _visits(rows: DataFrame, index: Index, groups: int, most: int, k: int) -> DataFrame:
    """``group``, ``vec_id``, ``vec``, ``keys``: the buckets that each query visits, by group.

    Queries that would visit more than ``most`` buckets of a table have no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own, cells in _placed(batches, index):
            of, where, keys = [], [], []
            asked = batch.take(own)
            vectors = np.array(asked.column(1).to_pylist())
            reach = index.radii(asked.column(0).to_numpy(), vectors, k) / index.width
            for n in range(len(own)):
                found: list[list[tuple[int, ...]]] = []
                for table in cells[:, n]:
                    if (near := probes(table, float(reach[n]), most=most)) is None:
                        break
                    found.append(near)
                if len(found) < len(cells):
                    continue
                visited = [_key(t, c) for t, near in enumerate(found) for c in near]
                by_group: dict[int, list[int]] = {}
                for key in visited:
                    by_group.setdefault(key % groups, []).append(key)
                of += [n] * len(by_group)
                where += by_group.keys()
                keys += by_group.values()
            again = own.take(pa.array(of, pa.int64()))
            columns = [pa.array(where, pa.int64()), batch.column(0).take(again), batch.column(1).take(again)]
            lists = pa.array(keys, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns, lists], ["group", "vec_id", "vec", "keys"])

    schema = "group long, vec_id long, vec array<double>, keys array<long>"
    return rows.select("vec_id", "vec").mapInArrow(run, schema)


def _placed(batches: Iterable[pa.RecordBatch], index: Index) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Slices of the batches, which of their rows have the index's length, and their cells."""
    for rows in text_rows(batches):
        vectors = rows.column(1).to_pylist()
        same = [i for i, v in enumerate(vectors) if len(v) == index.planes.shape[2]]
        if same:
            yield rows, pa.array(same, pa.int64()), index.cells(np.array([vectors[i] for i in same]))


def _best_visited(k: int, tables: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """For cogroups of visits and bucketed vectors: each query's ``k`` best pairs."""

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return NONE
        held = held.sort_values("key", kind="stable")
        at, names, data = held["key"].to_numpy(), held["vec_id"].to_numpy(), np.array(held["vec"].tolist())
        out = []
        for query, vector, keys in zip(asked["vec_id"], asked["vec"], asked["keys"], strict=True):
            keys = np.unique(keys)
            first, last = np.searchsorted(at, keys), np.searchsorted(at, keys, side="right")
            sizes = last - first
            if not sizes.any():
                continue
            # The places of all these runs of rows.
            spots = np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
            out.append(_closest(query, np.asarray(vector), names[spots], data[spots], k, tables))
        return pd.concat(out) if out else NONE

    return run


def _closest(query: int, vector: np.ndarray, names: np.ndarray, data: np.ndarray, k: int, copies: int) -> pd.DataFrame:
    other = names != query
    names, gap = names[other], data[other] - vector
    score = np.sqrt((gap * gap).sum(axis=1))
    # A row may come ``copies`` times, once from each table, with the same id and distance.
    most = k * copies
    top = _lowest(score, names, most) if len(score) > most else np.lexsort((names, score))
    best = pd.DataFrame({"query_id": query, "vec_id": names[top], "score": score[top]})
    return best.drop_duplicates().head(k)


NONE = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
    {"query_id": "int64", "vec_id": "int64", "score": "float64"}
)


def _best(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """For cogroups of queries and vectors, all against all: each query's ``k`` best pairs."""

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return NONE
        names, data = held["vec_id"].to_numpy(), np.array(held["vec"].tolist())
        every = zip(asked["vec_id"], asked["vec"], strict=True)
        return pd.concat([_closest(query, np.asarray(vector), names, data, k, 1) for query, vector in every])

    return run


def _lowest(score: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Places of the k lowest scores, ties to the smaller name."""
    limit = np.partition(score, k - 1)[k - 1]
    near = np.flatnonzero(score <= limit)
    return near[np.lexsort((names[near], score[near]))[:k]]


PAIRS = "query_id long, vec_id long, score double"


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _found(held: DataFrame, asked: DataFrame, index: Index, rows: int, k: int) -> DataFrame:
    """The best pairs of each query in each group of buckets."""
    groups = max(1, ceil(rows * len(index.planes) / SLICE))
    filed, visits = _buckets(held, index), saved(_visits(asked, index, groups, most_buckets(rows), k))
    big = (
        filed.groupBy("key")
        .agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("long").alias("slices"))
        .filter("slices > 1")
    )
    # A bucket takes more than one slice only if it holds SLICE rows: few, so this is small.
    big = saved(big)
    cut = F.coalesce(F.pmod(F.xxhash64("vec_id"), F.col("slices")), F.lit(0))
    left = filed.join(big, "key", "left").select(
        F.pmod(F.col("key") + cut * STRIDE, F.lit(groups)).alias("group"), "key", "vec_id", "vec"
    )
    more = (
        visits.select("vec_id", "vec", F.explode("keys").alias("key"))
        .join(big, "key")
        .select("vec_id", "vec", "key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("slices") - 1)).alias("s"))
        .select(
            F.pmod(F.col("key") + F.col("s") * STRIDE, F.lit(groups)).alias("group"),
            "vec_id",
            "vec",
            F.array("key").alias("keys"),
        )
    )
    # Queries of one place may be many: they are dealt to blocks, each with a copy of the rows.
    blocks = max(1, ceil(asked.count() / ASKED))
    right = visits.unionByName(more).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    held_in = _in_blocks(left, blocks)
    pairs = right.groupBy("group", "block").cogroup(held_in.groupBy("group", "block"))
    return pairs.applyInPandas(_best_visited(k, len(index.planes)), PAIRS).distinct()


def _in_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    return rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def _all_pairs(held: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The exact way: each query against all vectors of its length, in blocks."""
    sized = held.withColumn("size", F.size("vec"))
    sizes = sized.groupBy("size").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    left = sized.join(sizes, "size").select(
        "size", F.pmod(F.xxhash64("vec_id"), F.col("slices")).cast("int").alias("slice"), "vec_id", "vec"
    )
    copies = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    blocks = max(1, ceil(asked.count() / ASKED))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    right = asked.withColumn("size", F.size("vec")).join(sizes, "size").select("size", copies, "vec_id", "vec", block)
    # Both sides stem from one table; new names for one of them tell their columns apart.
    cell = ("size", "slice", "block")
    pairs = right.toDF(*right.columns).groupBy(*cell).cogroup(_in_blocks(left, blocks).groupBy(*cell))
    return pairs.applyInPandas(_best(k), PAIRS).distinct()


def nearest(
    rows: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", **options: float
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest rows found for each query.

    ``queries`` is a condition on ``vec_id``; every other row is a candidate. ``score`` is the
    Euclidean distance in doubles; nearest first, ties to the smaller id.

    Defined cases: rows with a null id, a null, zero or non-finite vector take no part;
    vectors of another length than the sample's longest are compared with their like only,
    exactly; equal rows count once, rows that share an id but not the vector stay; fewer
    candidates than ``k`` are all returned; an empty table gives no rows; other columns
    are ignored.
    """
    tables = int(options.get("tables", TABLES))
    vectors = saved(clean(rows, id_col, vec_col).distinct())
    # Only the k + 1 smallest ids of equal vectors can be among the k nearest of any query.
    equal = W.partitionBy("vec").orderBy("vec_id")
    numbered = saved(vectors.withColumn("_n", F.row_number().over(equal)).filter(F.col("_n") <= k + 1))
    held, distinct = numbered.drop("_n"), numbered.filter("_n = 1").select("vec_id", "vec")
    asked = vectors.filter(queries)
    total = held.count()
    if not total:
        return asked.select(
            F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")
        ).limit(0)
    index = fit(distinct, total, tables)
    found = _found(held, asked, index, total, k)
    near = saved(_ranked(found, k))
    # The exact way for queries that visited none or found too few: all rows of their length, in blocks.
    enough = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    short = asked.join(enough.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    some = saved(short)
    if some.isEmpty():
        whole = near
    else:
        answered = near.join(some.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
        whole = answered.unionByName(_ranked(_all_pairs(held, some, k), k))
    return whole.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
