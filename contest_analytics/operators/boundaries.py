"""Where a long series of vectors opens a new section: peaks of its checkerboard novelty.

Every step is one pass over tiles of bounded size, whatever the series:

* *novelty* from prefix sums of the vectors of a tile and a rim around it;
* *tops*: local maxima, and plateaus by their two ends, which may lie in different tiles;
* *distance*: tops that are the highest within the distance stay and drive out their
  neighbours. What lies between two of them cannot reach across, so the few tops that are
  left are decided stretch by stretch;
* *prominence*: a walk from a top to either side ends at the first value that is far enough
  below it, or above it. Walks that leave their tile skip tiles by their extremes, and look only
  into the one that holds both kinds of value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contest_analytics.functions.vectors import norm, scaled
from contest_analytics.scale import (
    OWN,
    TILE,
    TILE_ROWS,
    _conf_int,
    around,
    lookup,
    ordered,
    owned,
    plain,
    running_sum,
    shared_dir,
    tiles,
    with_index,
)

#: Marks of a row: a single top, a plateau's start after a rise, its end before a fall or a rise.
TOP, START, FALL, RISE = 1, 2, 3, 4
#: Tiles of a series whose walks are continued together.
GROUP = 64
SCHEMA = "idx long, _size long, _tile long, v double, mark int"


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows, filled with zeros to the longest; null vectors and components are zeros."""
    lists = vectors.combine_chunks() if vectors.num_chunks != 1 else vectors.chunk(0)
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    data = np.zeros((len(lists), sizes.max(initial=0)))
    data[np.arange(data.shape[1]) < sizes[:, None]] = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False))
    return data


def novelty_of(units: np.ndarray, first: int, n: int, k: int) -> np.ndarray:
    """Smoothed novelty of rows ``first`` .. of a series of ``n``, as far as the rows around are there.

    The block means of the similarity matrix need only the sums L and R of the ``k`` vectors before
    and after a row: (|L|^2 + |R|^2)/2 - L.R = |L - R|^2 / 2, over k^2.
    """
    k = min(k, n // 2)
    raw = np.zeros(len(units))
    if k >= 2:
        sums = np.concatenate([np.zeros((1, units.shape[1])), np.cumsum(units, axis=0)])
        at = np.arange(k, len(units) - k + 1)
        at = at[(at + first >= k) & (at + first < n - k)]
        gap = 2 * sums[at] - sums[at - k] - sums[at + k]
        raw[at] = (gap * gap).sum(axis=1) / (2.0 * k * k)
    wide = max(3, k // 2)
    padded = np.r_[np.zeros(wide // 2), raw, np.zeros(wide - wide // 2 - 1)]
    return np.lib.stride_tricks.sliding_window_view(padded, wide).sum(axis=1) / wide


def marks_of(v: np.ndarray) -> np.ndarray:
    """Marks of all rows; those without a neighbour on one side have none."""
    before = np.r_[np.nan, np.sign(np.diff(v))]
    after = np.r_[np.sign(np.diff(v)), np.nan]
    marks = np.zeros(len(v), np.int32)
    marks[(before > 0) & (after < 0)] = TOP
    marks[(before > 0) & (after == 0)] = START
    marks[(before == 0) & (after < 0)] = FALL
    marks[(before == 0) & (after > 0)] = RISE
    return marks


def _line(df: DataFrame, key: str, order: Sequence[str], vec: str, k: int) -> DataFrame:
    """``(key, idx, _size, _tile, v, mark)`` of every row: its novelty, and what it is to its neighbours."""
    unit = scaled(vec, 1.0 / (norm(vec) + 1e-8))
    placed = with_index(df.select(key, *order, unit.alias("_u")), [key], order).select(key, "idx", "_u")
    sizes = placed.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    rim = k + max(3, k // 2) + 1
    cut = tiles(lookup(placed, sizes, [key]), [key], rim, rim, True)
    field = df.schema[key]

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        idx, own = table["idx"].to_numpy(), table[OWN].to_numpy(zero_copy_only=False)
        n = int(table["_size"][0].as_py())
        v = novelty_of(_matrix(table["_u"]), int(idx[0]) - 1, n, k)
        marks = marks_of(v)
        held = table.filter(pa.array(own))
        columns = [held[key], held["idx"], held["_size"], held[TILE], pa.array(v[own]), pa.array(marks[own])]
        return pa.table(columns, names=[key, "idx", "_size", "_tile", "v", "mark"])

    return cut.groupBy(key, TILE).applyInArrow(solve, f"{key} {field.dataType.simpleString()}, {SCHEMA}")


def _tops(line: DataFrame, key: str) -> DataFrame:
    """``(key, idx, v)``: local maxima, and the middles of plateaus that are."""
    single = line.filter(F.col("mark") == TOP).select(key, "idx", "v")
    ends = line.filter(F.col("mark") > TOP).select(key, F.col("idx").alias("at"), "v", "mark")
    tiled = ordered(ends, [key], ["at"], after=1)
    w = around([key])
    paired = owned(tiled.withColumn("_next", F.lead("mark").over(w)).withColumn("_to", F.lead("at").over(w)))
    flat = paired.filter((F.col("mark") == START) & (F.col("_next") == FALL)).select(
        key, F.floor((F.col("at") + F.col("_to")) / 2).alias("idx"), "v"
    )
    return single.unionByName(flat)


def _spread_out(tops: DataFrame, key: str, gap: int, kind: str) -> DataFrame:
    """Tops that stay when, from the highest down (later ones first), each drives out those closer than ``gap``."""
    if gap <= 1:
        return tops
    reach = W.partitionBy(key, TILE).orderBy("idx").rangeBetween(1 - gap, gap - 1)
    cut = tiles(tops, [key], 2 * gap, 2 * gap, True)
    best = F.max(F.struct("v", "idx")).over(reach)
    led = cut.withColumn("_lead", best["idx"] == F.col("idx"))
    near = owned(led.withColumn("_near", F.max("_lead").over(reach)))
    shared_dir(tops.sparkSession)
    known = running_sum(near, [key], F.col("_lead").cast("long"), "_part").checkpoint()

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        at, v = pdf["idx"].to_numpy(), pdf["v"].to_numpy()
        stay: list[int] = []
        taken = np.empty(0, np.int64)
        for j in np.lexsort((at, v))[::-1]:
            spot = np.searchsorted(taken, at[j])
            close = [taken[s] for s in (spot - 1, spot) if 0 <= s < len(taken)]
            if all(abs(c - at[j]) >= gap for c in close):
                taken = np.insert(taken, spot, at[j])
                stay.append(j)
        return plain(pdf.iloc[stay][[key, "idx", "v"]], key)

    rest = known.filter(~F.col("_lead") & ~F.col("_near"))
    decided = rest.groupBy(key, "_part").applyInPandas(decide, f"{key} {kind}, idx long, v double")
    return known.filter("_lead").select(key, "idx", "v").unionByName(decided)


def falls(part: np.ndarray, top: float, prominence: float, complete: bool) -> int:
    """Walking away from a top: 1 it falls far enough, 0 it does not, -1 not visible."""
    at, step = 0, 64
    while at < len(part):
        piece = part[at : at + step]
        higher = piece > top
        low = top - piece >= prominence
        if higher.any() or low.any():
            return int(low.any() and (not higher.any() or low.argmax() < higher.argmax()))
        at, step = at + step, step * 2
    return 0 if complete else -1


def _prominent(line: DataFrame, tops: DataFrame, key: str, prominence: float, size: int, kind: str) -> DataFrame:
    """Tops that fall by ``prominence`` on both sides before the series rises above them."""
    spark = line.sparkSession
    told = f"{key} {kind}, idx long, v double, side int, _tile long, falls int"
    names = [key, "idx", "v", "side", "_tile", "falls"]
    mine = tops.withColumn("_tile", F.floor((F.col("idx") - 1) / size))

    def walk(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return plain(pd.DataFrame({n: [] for n in names}), key)
        rows = rows.sort_values("idx")
        v, first, n = rows["v"].to_numpy(), int(rows["idx"].iloc[0]), int(rows["_size"].iloc[0])
        out = []
        for k, idx, tile, top in asked[[key, "idx", "tile", "v"]].itertuples(index=False, name=None):
            at = idx - first
            for side, part, complete in ((0, v[:at][::-1], first == 1), (1, v[at + 1 :], first + len(v) - 1 == n)):
                out.append((k, idx, top, side, tile, falls(part, top, prominence, complete)))
        return plain(pd.DataFrame(out, columns=names), key)

    asked = mine.select(key, "idx", F.col("_tile"), "v").toDF(key, "idx", "tile", "v")
    shared_dir(spark)
    here = line.select(key, "_tile", "idx", "_size", "v").groupBy(key, "_tile").cogroup(asked.groupBy(key, "tile"))
    seen = here.applyInPandas(walk, told).checkpoint()
    open_ones = seen.filter("falls = -1").drop("falls")
    found = seen.filter("falls <> -1")
    if not open_ones.isEmpty():
        found = found.unionByName(_walk_on(line, open_ones, key, prominence, told, names))
    good = found.groupBy(key, "idx").agg(F.min("falls").alias("f"), F.count(F.lit(1)).alias("n"))
    return good.filter("f = 1 and n = 2").select(key, "idx")


def _walk_on(line: DataFrame, open_ones: DataFrame, key: str, prominence: float, told: str, names: list[str]) -> DataFrame:
    """The walks that left their tile, by the extremes of the others."""
    ends = line.groupBy(key, "_tile").agg(F.max("v").alias("high"), F.min("v").alias("low"))
    blocks = open_ones.select(key, F.floor(F.col("_tile") / GROUP).alias("block")).distinct()
    every = ends.join(blocks.withColumnRenamed(key, "_k"), F.col(key) == F.col("_k")).drop("_k")

    def skip(asked: pd.DataFrame, extremes: pd.DataFrame) -> pd.DataFrame:
        extremes = extremes.sort_values("_tile")
        tile, high, low = (extremes[c].to_numpy() for c in ("_tile", "high", "low"))
        out = []
        for k, idx, v, side, own in asked[names[:5]].itertuples(index=False, name=None):
            there = np.flatnonzero(tile < own)[::-1] if side == 0 else np.flatnonzero(tile > own)
            above, below = high[there] > v, v - low[there] >= prominence
            hit = np.flatnonzero(above | below)
            if not len(hit):
                out.append((k, idx, v, side, own, 0))
            else:
                both = above[hit[0]] and below[hit[0]]
                out.append((k, idx, v, side, int(tile[there[hit[0]]]), -1 if both else int(below[hit[0]])))
        return plain(pd.DataFrame(out, columns=names), key)

    dealt = open_ones.withColumn("block", F.floor(F.col("_tile") / GROUP))
    sent = dealt.groupBy(key, "block").cogroup(every.groupBy(key, "block")).applyInPandas(skip, told).checkpoint()

    def look(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values("idx")["v"].to_numpy()
        ends = [
            falls(v[::-1] if side == 0 else v, top, prominence, True) for top, side in zip(asked["v"], asked["side"], strict=True)
        ]
        return plain(asked.assign(falls=ends)[names], key) if len(asked) else plain(pd.DataFrame({n: [] for n in names}), key)

    unsure = sent.filter("falls = -1")
    looked = unsure.groupBy(key, "_tile").cogroup(line.groupBy(key, "_tile")).applyInPandas(look, told)
    return sent.filter("falls <> -1").unionByName(looked)


def section_boundaries(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    vec: str = "vec",
    k: int = 16,
    min_gap: int = 2,
    prominence: float = 0.05,
) -> DataFrame:
    """``(key, idx)`` of the frames that open a new section (never the first frame)."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    gap = math.ceil(min_gap)
    size = max(_conf_int(spark, "tileRows", TILE_ROWS), k + max(3, k // 2) + 1, 2 * gap, 1)
    shared_dir(spark)
    # Tiles are cut alike in every step, and the novelty is computed once.
    line = _line(df, key, order, vec, k).withColumn("_tile", F.floor((F.col("idx") - 1) / size)).checkpoint()
    tops = _spread_out(_tops(line, key), key, gap, kind)
    found = _prominent(line, tops, key, prominence, size, kind)
    # A small table that later steps read several times.
    return found.filter("idx > 1").checkpoint()
