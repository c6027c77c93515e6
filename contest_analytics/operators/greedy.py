"""The greedy thinning of a series: a row stays if it is ``apart`` or more from the last that stayed.

Which row follows a kept row depends on that row alone, so inside a tile every row has one
successor, found for all rows together by descending a table of range extremes; what stays is
what can be reached from the first kept row, found by pointer doubling.

A tile of a long series does not know the value it is entered with. Whatever it is, the first row
that stays is a new extreme of the tile: the first running maximum far enough above the entry,
or the first running minimum far enough below. So a tile is summed up by its running extremes,
each with the value that the scan leaves the tile with once that row has stayed. Two such
summaries in a row make one of the same form, so they are combined in groups, the groups are
walked in order, then the tiles of each group: a fixed number of passes, whatever the series.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contest_analytics.scale import TILE_ROWS, _conf_int, is_hot, lookup, plain, shared_dir, with_index

#: Tiles of a group.
GROUP = 64


def successors(v: np.ndarray, ends: np.ndarray, apart: float) -> np.ndarray:
    """For each row the next one, before ``ends``, that is ``apart`` or more away; ``len(v)`` if none."""
    n = len(v)
    tops, lows, width = [v], [v], 1
    while 2 * width <= n:
        tops.append(np.maximum(tops[-1][:-width], tops[-1][width:]))
        lows.append(np.minimum(lows[-1][:-width], lows[-1][width:]))
        width *= 2
    at = np.arange(1, n + 1)
    for level in range(len(tops) - 1, -1, -1):
        step = 1 << level
        spot = np.minimum(at, len(tops[level]) - 1)
        calm = (at + step <= ends) & (tops[level][spot] - v < apart) & (v - lows[level][spot] < apart)
        at = np.where(calm, at + step, at)
        # One stretch of each width, and of the greatest as many as there are.
        while level == len(tops) - 1 and calm.any():
            spot = np.minimum(at, len(tops[level]) - 1)
            calm = calm & (at + step <= ends) & (tops[level][spot] - v < apart) & (v - lows[level][spot] < apart)
            at = np.where(calm, at + step, at)
    return np.where(at < ends, at, n)


def reached(follow: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which rows the successors lead to from ``starts``, these included."""
    n = len(follow)
    jump = np.append(follow, n)
    seen = np.zeros(n + 1, bool)
    seen[starts] = True
    while (jump[:n] < n).any():
        seen[jump[np.flatnonzero(seen)]] = True
        jump = jump[jump]
    return seen[:n]


def last_of(follow: np.ndarray) -> np.ndarray:
    """The last row of the chain that starts at each row."""
    n = len(follow)
    end = np.where(follow < n, follow, np.arange(n))
    while True:
        later = end[end]
        if (later == end).all():
            return end
        end = later


class Summary:
    """Running maxima and minima of a stretch of rows: value, row number, and value at the exit."""

    def __init__(self, high: np.ndarray, low: np.ndarray) -> None:
        self.high, self.low = high, low  # (rows, 3), by row number

    @classmethod
    def of(cls, v: np.ndarray, first: int, apart: float) -> Summary:
        follow = successors(v, np.full(len(v), len(v)), apart)
        out = v[last_of(follow)]
        top, bottom = np.maximum.accumulate(v), np.minimum.accumulate(v)
        sides = []
        for record in (v > np.r_[-np.inf, top[:-1]], v < np.r_[np.inf, bottom[:-1]]):
            at = np.flatnonzero(record)
            sides.append(np.column_stack([v[at], at + first, out[at]]))
        return cls(*sides).trimmed(apart)

    def trimmed(self, apart: float) -> Summary:
        """Without extremes that come after rows no entry can be close to all of."""
        rows = np.concatenate([np.column_stack([self.high, np.ones(len(self.high))]), np.column_stack([self.low, np.zeros(len(self.low))])])
        rows = rows[np.argsort(rows[:, 1], kind="stable")]
        top = np.maximum.accumulate(np.where(rows[:, 3] == 1, rows[:, 0], -np.inf))
        bottom = np.minimum.accumulate(np.where(rows[:, 3] == 0, rows[:, 0], np.inf))
        # A margin, so that rounding never drops a row that some entry needs.
        wide = np.flatnonzero(top - bottom > 2.001 * apart)
        if not len(wide):
            return self
        last = rows[wide[0], 1]
        return Summary(self.high[self.high[:, 1] <= last], self.low[self.low[:, 1] <= last])

    def enter(self, e: np.ndarray, apart: float) -> tuple[np.ndarray, np.ndarray]:
        """For each entry value the number of the first row that stays (infinite if none) and the exit."""
        best, out = np.full(len(e), np.inf), e.copy()
        for side, sign in ((self.high, 1.0), (self.low, -1.0)):
            if not len(side):
                continue
            values = sign * side[:, 0]
            at = np.searchsorted(values, sign * e + apart)
            # The search rounds; the rule is on the difference itself.
            while True:
                back = (at > 0) & (values[np.maximum(at - 1, 0)] - sign * e >= apart)
                on = ~back & (at < len(values)) & (values[np.minimum(at, len(values) - 1)] - sign * e < apart)
                if not (back | on).any():
                    break
                at = at - back + on
            spot = np.minimum(at, len(values) - 1)
            sooner = (at < len(values)) & (side[spot, 1] < best)
            best, out = np.where(sooner, side[spot, 1], best), np.where(sooner, side[spot, 2], out)
        return best, out

    def then(self, later: Summary, apart: float) -> Summary:
        """The summary of this stretch and the one that follows it."""
        sides = []
        for mine, other, sign in ((self.high, later.high, 1.0), (self.low, later.low, -1.0)):
            moved = mine.copy()
            moved[:, 2] = later.enter(mine[:, 2], apart)[1]
            further = other[sign * other[:, 0] > sign * mine[-1, 0]] if len(mine) else other
            sides.append(np.concatenate([moved, further]))
        return Summary(*sides).trimmed(apart)

    def row(self) -> dict[str, list]:
        return {"high": self.high.ravel().tolist(), "low": self.low.ravel().tolist()}

    @classmethod
    def read(cls, row) -> Summary:
        return cls(*(np.asarray(x, float).reshape(-1, 3) for x in (row.high, row.low)))


def thinned(df: DataFrame, key: str, order: Sequence[str], s: str, apart: float = 0.5) -> DataFrame:
    """``(key, idx, note)``: the rows that stay; the first of a key does. ``s`` is not null."""
    kind = df.schema[key].dataType.simpleString()
    if is_hot(df, [key]):
        return _thinned_tiles(df, key, order, s, apart, kind)
    rows = df.select(key, *order, s).repartition(F.col(key)).sortWithinPartitions(key, *order).select(key, s)

    def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, count, last = None, 0, 0.0
        for pdf in batches:
            if not len(pdf):
                continue
            names, v = pdf[key].to_numpy(), pdf[s].to_numpy(float)
            cuts = np.flatnonzero(names[1:] != names[:-1]) + 1
            firsts, ends = np.r_[0, cuts], np.r_[cuts, len(v)]
            sizes = ends - firsts
            starts = firsts.copy()
            before = np.zeros(len(firsts), np.int64)
            if current is not None and names[0] == current:
                # The first key goes on: its last kept value is the one of the batch before.
                before[0] = count
                far = np.flatnonzero(np.abs(v[: ends[0]] - last) >= apart)
                starts = starts[1:] if not len(far) else np.r_[far[0], starts[1:]]
            kept = reached(successors(v, np.repeat(ends, sizes), apart), starts)
            place = np.arange(len(v)) - np.repeat(firsts, sizes) + 1 + np.repeat(before, sizes)
            yield pd.DataFrame({key: pdf[key].to_numpy()[kept], "idx": place[kept], "note": v[kept]})
            tail = np.flatnonzero(kept[firsts[-1] :])
            last = v[firsts[-1] + tail[-1]] if len(tail) else last
            current, count = names[-1], int(place[-1])

    return rows.mapInPandas(scan, f"{key} {kind}, idx long, note double")


def _thinned_tiles(df: DataFrame, key: str, order: Sequence[str], s: str, apart: float, kind: str) -> DataFrame:
    size = _conf_int(df.sparkSession, "tileRows", TILE_ROWS)
    placed = with_index(df.select(key, *order, s), [key], order, hot=True).select(
        key, "idx", F.col(s).alias("note"), F.floor((F.col("idx") - 1) / size).alias("_tile")
    )
    shape = "high array<double>, low array<double>"

    def sum_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        found = Summary.of(pdf["note"].to_numpy(float), int(pdf["idx"].iloc[0]), apart)
        return plain(pd.DataFrame([{key: pdf[key].iloc[0], "_tile": pdf["_tile"].iloc[0], **found.row()}]), key)

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_tile")
        whole = None
        for row in pdf.itertuples():
            one = Summary.read(row)
            whole = one if whole is None else whole.then(one, apart)
        return plain(pd.DataFrame([{key: pdf[key].iloc[0], "_group": pdf["_group"].iloc[0], **whole.row()}]), key)

    def walk(pdf: pd.DataFrame, by: str, start: float) -> pd.DataFrame:
        pdf = pdf.sort_values(by)
        entries, at = [], np.array([start])
        for row in pdf.itertuples():
            entries.append(at[0])
            at = Summary.read(row).enter(at, apart)[1]
        return plain(pd.DataFrame({key: pdf[key], by: pdf[by], "entry": entries}), key)

    def walk_groups(pdf: pd.DataFrame) -> pd.DataFrame:
        # Nothing has stayed before the first row, so it is far from everything.
        return walk(pdf.rename(columns={"_group": "group"}), "group", -np.inf)

    def walk_tiles(pdf: pd.DataFrame) -> pd.DataFrame:
        return walk(pdf.rename(columns={"_tile": "tile"}), "tile", float(pdf["entry"].iloc[0]))

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        v = pdf["note"].to_numpy(float)
        far = np.flatnonzero(np.abs(v - pdf["entry"].iloc[0]) >= apart)
        stay = reached(successors(v, np.full(len(v), len(v)), apart), far[:1])
        return plain(pdf.loc[stay, [key, "idx", "note"]], key)

    shared_dir(df.sparkSession)
    tiles = (
        placed.groupBy(key, "_tile")
        .applyInPandas(sum_up, f"{key} {kind}, _tile long, {shape}")
        .withColumn("_group", F.floor(F.col("_tile") / GROUP))
        .checkpoint()
    )
    groups = tiles.groupBy(key, "_group").applyInPandas(combine, f"{key} {kind}, _group long, {shape}")
    starts = groups.groupBy(key).applyInPandas(walk_groups, f"{key} {kind}, group long, entry double")
    entered = lookup(tiles, starts.withColumnRenamed("group", "_group"), [key, "_group"], "inner")
    entries = entered.groupBy(key, "_group").applyInPandas(walk_tiles, f"{key} {kind}, tile long, entry double")
    rows = lookup(placed, entries.withColumnRenamed("tile", "_tile"), [key, "_tile"], "inner")
    return rows.groupBy(key, "_tile").applyInPandas(keep, f"{key} {kind}, idx long, note double")


class Bars:
    """How a tile of sorted whole numbers passes on a bar, the least number that may be accepted.

    ``first``: numbers that can be the first accepted one, up to one that no bar from before the
    tile's first stretch of ``step`` can pass; ``out``: the bar after the tile for each of them.
    """

    def __init__(self, first: np.ndarray, out: np.ndarray) -> None:
        self.first, self.out = first, out

    @classmethod
    def of(cls, numbers: np.ndarray, start: int, step: int) -> Bars:
        needed = int(np.searchsorted(numbers, start + step)) + 1
        last = last_of(np.searchsorted(numbers, numbers + step))[:needed]
        return cls(numbers[:needed], numbers[last] + step)

    def enter(self, bar: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.first, bar)
        return np.where(at < len(self.first), self.out[np.minimum(at, len(self.out) - 1)], bar)

    def then(self, later: Bars, start: int, step: int) -> Bars:
        first, out = np.r_[self.first, later.first], np.r_[later.enter(self.out), later.out]
        needed = int(np.searchsorted(first, start + step)) + 1
        return Bars(first[:needed], out[:needed])


#: Numbers that a tile spans, rounded to whole steps.
SPAN = 1 << 18


def spaced(df: DataFrame, key: str, number: str, step: int) -> DataFrame:
    """``(key, number)``: the distinct whole numbers that are ``step`` or more above the last accepted one.

    The first number of a key is accepted; null numbers are none. A key's numbers are cut into
    tiles of ``SPAN`` (at least one step). As at most one number of any ``step`` in a row is
    accepted, a tile is entered with one of ``step`` bars, and its summary has one entry for
    each number among them. Summaries combine in groups; groups are walked, then their tiles.
    """
    if step < 1:
        raise ValueError("the step must be one or more")
    span = step * max(1, SPAN // step)
    kind = df.schema[key].dataType.simpleString()
    shared_dir(df.sparkSession)
    numbers = F.col(number).cast("long").alias(number)
    once = df.select(key, numbers).filter(F.col(number).isNotNull()).distinct().withColumn("_tile", F.floor(F.col(number) / span))
    shape = "first array<long>, out array<long>"

    def read(row) -> Bars:
        return Bars(np.asarray(row.first, np.int64), np.asarray(row.out, np.int64))

    def row_of(bars: Bars) -> dict[str, list]:
        return {"first": bars.first.tolist(), "out": bars.out.tolist()}

    def sum_up(pdf: pd.DataFrame) -> pd.DataFrame:
        tile = int(pdf["_tile"].iloc[0])
        found = Bars.of(np.sort(pdf[number].to_numpy(np.int64)), tile * span, step)
        return plain(pd.DataFrame([{key: pdf[key].iloc[0], "_tile": tile, **row_of(found)}]), key)

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_tile")
        whole, start = None, int(pdf["_tile"].iloc[0]) * span
        for row in pdf.itertuples():
            whole = read(row) if whole is None else whole.then(read(row), start, step)
        return plain(pd.DataFrame([{key: pdf[key].iloc[0], "_group": pdf["_group"].iloc[0], **row_of(whole)}]), key)

    def walk(pdf: pd.DataFrame, by: str, start: int) -> pd.DataFrame:
        pdf = pdf.sort_values(by)
        entries, at = [], np.array([start])
        for row in pdf.itertuples():
            entries.append(int(at[0]))
            at = read(row).enter(at)
        return plain(pd.DataFrame({key: pdf[key], by: pdf[by], "bar": entries}), key)

    def walk_groups(pdf: pd.DataFrame) -> pd.DataFrame:
        return walk(pdf.rename(columns={"_group": "group"}), "group", np.iinfo(np.int64).min)

    def walk_tiles(pdf: pd.DataFrame) -> pd.DataFrame:
        return walk(pdf.rename(columns={"_tile": "tile"}), "tile", int(pdf["bar"].iloc[0]))

    def accept(pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.sort(pdf[number].to_numpy(np.int64))
        start = np.flatnonzero(held >= pdf["bar"].iloc[0])[:1]
        stay = reached(np.searchsorted(held, held + step), start)
        return plain(pd.DataFrame({key: pdf[key].iloc[0], number: held[stay]}), key)

    tiles = (
        once.groupBy(key, "_tile")
        .applyInPandas(sum_up, f"{key} {kind}, _tile long, {shape}")
        .withColumn("_group", F.floor(F.col("_tile") / GROUP))
        .checkpoint()
    )
    groups = tiles.groupBy(key, "_group").applyInPandas(combine, f"{key} {kind}, _group long, {shape}")
    starts = groups.groupBy(key).applyInPandas(walk_groups, f"{key} {kind}, group long, bar long")

    def matched(left: DataFrame, right: DataFrame, place: str) -> DataFrame:
        a, b = left.alias("a"), right.toDF(key, place, "bar").alias("b")
        same = F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")) & (F.col(f"a.{place}") == F.col(f"b.{place}"))
        return a.join(b, same).select("a.*", "b.bar")

    entered = matched(tiles, starts, "_group")
    entries = entered.groupBy(key, "_group").applyInPandas(walk_tiles, f"{key} {kind}, tile long, bar long")
    rows = matched(once, entries, "_tile")
    return rows.groupBy(key, "_tile").applyInPandas(accept, f"{key} {kind}, {number} long")
