"""Sums of lagged products of a series, for all lags at once, by Fourier transforms.

The sums over i of x(i) x(i + lag) are the inverse transform of the squared spectrum of the
series, padded with as many zeros. A series that fits in a task is transformed there. A longer one
of N = rows x columns places is transformed in three passes, none of which holds more than a strip
of it: down the columns, then along the rows (forth, squared, and back again), then up the
columns. So the work grows as n log n, and the passes do not depend on the series.

For vectors the products are inner products: the spectra of the components add up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contest_analytics.scale import _conf_int, lookup, with_index

#: Numbers of a series (rows times components) that one task transforms whole; of a strip of a longer one.
WHOLE, STRIP = 1 << 21, 1 << 20

#: First lag and the one after the last, from the number of rows.
Span = Callable[[int], tuple[int, int]]


def sums_of(x: np.ndarray) -> np.ndarray:
    """Sums at lags 0 .. n - 1 of a series (rows, components)."""
    n = len(x)
    size = 1 << int(2 * n - 1).bit_length()
    spectrum = np.zeros(size // 2 + 1)
    for component in x.T:
        part = np.fft.rfft(component, size)
        spectrum += part.real**2 + part.imag**2
    return np.fft.irfft(spectrum, size)[:n]


def _matrix(values: pa.ChunkedArray) -> np.ndarray:
    """Numbers as a column; vectors as rows, filled with zeros to the longest. Nulls are zeros."""
    column = values.combine_chunks() if values.num_chunks != 1 else values.chunk(0)
    if not pa.types.is_list(column.type):
        return np.nan_to_num(column.to_numpy(zero_copy_only=False).astype(float))[:, None]
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    data = np.zeros((len(column), sizes.max(initial=0)))
    data[np.arange(data.shape[1]) < sizes[:, None]] = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False))
    return data


def lag_sums(df: DataFrame, key: str, order: Sequence[str], values: str, span: Span) -> DataFrame:
    """``(key, lag, _sum, _n)`` for the lags of ``span`` that are less than the number of rows."""
    is_vector = df.schema[values].dataType.typeName() == "array"
    width = F.coalesce(F.size(values), F.lit(0)) if is_vector else F.lit(1)
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.greatest(F.max(width), F.lit(1)).alias("_d"))
    limit = _conf_int(df.sparkSession, "wholeSeries", WHOLE)
    cells = F.col("_n") * F.col("_d")
    hot = not sizes.filter(cells > limit).isEmpty()
    placed = with_index(df.select(key, *order, values), [key], order, hot=hot).select(key, "idx", values)
    rows = lookup(placed, sizes, [key]) if hot else placed
    kind = df.schema[key].dataType.simpleString()

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        found = sums_of(_matrix(table[values]))
        low, high = span(len(found))
        lags = np.arange(max(low, 0), min(high, len(found)))
        name = pa.concat_arrays([table[key].chunk(0).slice(0, 1)]).take(pa.array(np.zeros(len(lags), np.int64)))
        columns = [name, pa.array(lags), pa.array(found[lags]), pa.array(np.full(len(lags), len(found)))]
        return pa.table(columns, names=[key, "lag", "_sum", "_n"])

    shape = f"{key} {kind}, lag long, _sum double, _n long"
    small = rows.filter(cells <= limit) if hot else rows
    out = small.groupBy(key).applyInArrow(whole, shape)
    return out.unionByName(_strips(rows.filter(cells > limit), key, kind, values, span)) if hot else out


class Grid:
    """The places of a long series: ``tall`` rows of ``wide`` columns, at least twice the series."""

    def __init__(self, n: int, components: int, strip: int) -> None:
        bits = int(2 * n - 1).bit_length()
        self.n, self.d = n, components
        self.tall, self.wide = 1 << bits // 2, 1 << bits - bits // 2
        self.size = self.tall * self.wide
        #: Columns of a strip of whole columns, and rows of a strip of whole rows.
        self.across = min(self.wide, max(1, strip // (self.tall * components)))
        self.down = min(self.tall, max(1, strip // (self.wide * components)))

    def turns(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """The factors between the transforms of columns and rows."""
        return np.exp(-2j * np.pi * ((rows[:, None] * columns[None]) % self.size) / self.size)


def _strips(df: DataFrame, key: str, kind: str, values: str, span: Span) -> DataFrame:
    facts, strip_size = f"{key} {kind}, _n long, _d int", STRIP
    # The width of a strip as in ``Grid``, from the facts of the series.
    bits = F.ceil(F.log2(2.0 * F.col("_n"))).cast("int")
    tall, wide = F.expr("shiftleft(1L, _bits div 2)"), F.expr("shiftleft(1L, _bits - _bits div 2)")
    across = F.least(F.col("_wide"), F.greatest(F.lit(1), F.floor(F.lit(strip_size) / (F.col("_tall") * F.col("_d")))))
    dealt = (
        df.withColumn("_bits", bits)
        .withColumns({"_tall": tall, "_wide": wide})
        .withColumn("_strip", F.floor(F.pmod(F.col("idx") - 1, F.col("_wide")) / across))
        .select(key, "_n", "_d", "_strip", "idx", values)
    )

    def grid_of(table: pa.Table) -> Grid:
        return Grid(table["_n"][0].as_py(), table["_d"][0].as_py(), strip_size)

    def sent(table: pa.Table, grid: Grid, targets: Iterator[tuple[int, int, np.ndarray]]) -> pa.Table:
        """Pieces (strip, where it starts in it, numbers) for the strips of the next pass."""
        rows = [(t, at, np.ascontiguousarray(piece).tobytes()) for t, at, piece in targets]
        first = pa.array(np.zeros(len(rows), np.int64))
        columns = [table[c].combine_chunks().take(first) for c in (key, "_n", "_d")]
        more = [pa.array([r[i] for r in rows], t) for i, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.binary()))]
        return pa.table([*columns, *more], names=[key, "_n", "_d", "_strip", "_at", "_piece"])

    def columns_down(table: pa.Table) -> pa.Table:
        grid, strip = grid_of(table), table["_strip"][0].as_py()
        place = table["idx"].to_numpy() - 1
        start = strip * grid.across
        wide = min(grid.across, grid.wide - start)
        x = np.zeros((grid.tall, wide, grid.d))
        data = _matrix(table[values])
        x[place // grid.wide, place % grid.wide - start, : data.shape[1]] = data
        y = np.fft.fft(x, axis=0) * grid.turns(np.arange(grid.tall), np.arange(start, start + wide))[:, :, None]
        return sent(table, grid, ((r, start, y[r * grid.down : (r + 1) * grid.down]) for r in range(-(-grid.tall // grid.down))))

    def rows_forth_and_back(table: pa.Table) -> pa.Table:
        grid, strip = grid_of(table), table["_strip"][0].as_py()
        start = strip * grid.down
        tall = min(grid.down, grid.tall - start)
        y = np.zeros((tall, grid.wide, grid.d), complex)
        for at, piece in zip(table["_at"].to_pylist(), table["_piece"].to_pylist(), strict=True):
            part = np.frombuffer(piece, complex).reshape(tall, -1, grid.d)
            y[:, at : at + part.shape[1]] = part
        spectrum = (np.abs(np.fft.fft(y, axis=1)) ** 2).sum(axis=2)
        z = np.fft.ifft(spectrum, axis=1) * np.conj(grid.turns(np.arange(start, start + tall), np.arange(grid.wide)))
        # Columns of numbers, not of vectors, from here on.
        across = Grid(grid.n, 1, strip_size).across
        return sent(table, grid, ((c, start, z[:, c * across : (c + 1) * across]) for c in range(-(-grid.wide // across))))

    def columns_up(table: pa.Table) -> pa.Table:
        grid, strip = grid_of(table), table["_strip"][0].as_py()
        across = Grid(grid.n, 1, strip_size).across
        start = strip * across
        wide = min(across, grid.wide - start)
        z = np.zeros((grid.tall, wide), complex)
        for at, piece in zip(table["_at"].to_pylist(), table["_piece"].to_pylist(), strict=True):
            part = np.frombuffer(piece, complex).reshape(-1, wide)
            z[at : at + len(part)] = part
        found = np.fft.ifft(z, axis=0).real
        lags = np.arange(grid.tall)[:, None] * grid.wide + np.arange(start, start + wide)[None]
        low, high = span(grid.n)
        keep = (lags >= max(low, 0)) & (lags < min(high, grid.n))
        name = table[key].combine_chunks().take(pa.array(np.zeros(int(keep.sum()), np.int64)))
        columns = [name, pa.array(lags[keep]), pa.array(found[keep]), pa.array(np.full(int(keep.sum()), grid.n))]
        return pa.table(columns, names=[key, "lag", "_sum", "_n"])

    pieces = f"{facts}, _strip long, _at long, _piece binary"
    down = dealt.groupBy(key, "_strip").applyInArrow(columns_down, pieces)
    back = down.groupBy(key, "_strip").applyInArrow(rows_forth_and_back, pieces)
    return back.groupBy(key, "_strip").applyInArrow(columns_up, f"{key} {kind}, lag long, _sum double, _n long")
