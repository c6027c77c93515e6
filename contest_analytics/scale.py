"""Skew-safe building blocks shared by the ordered and pairwise operators.

A window over a key sends every row of that key to one task. That is the best
plan while each key is small, and no plan at all when one key holds a third of
the table. Every helper below therefore measures the largest key first (one
map-side combined count over the key column) and picks between

* the plain window (one shuffle), and
* a range-partitioned plan that cuts long keys into runs of bounded size.

The limit is ``contest_analytics.hotRows`` in the session (default 1,000,000
rows per key); the tests set it to a handful of rows and expect equal results.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
TILE_ROWS = 65_536
#: Facts of one row for each key that may be sent to every task.
FACTS = 200_000

TILE = "_tile"
OWN = "_own"


def _conf_int(spark: SparkSession, name: str, default: int) -> int:
    return int(spark.conf.get(f"contest_analytics.{name}", str(default)))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a private one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="contest-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def key_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[bool, int]:
    """Whether some key holds more rows than one task should take, and the number of keys."""
    limit = _conf_int(df.sparkSession, "hotRows", HOT_ROWS)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.max("n"), F.count(F.lit(1))).first()
    return (row[0] or 0) > limit, row[1]


def is_hot(df: DataFrame, keys: Sequence[str]) -> bool:
    """True when some key holds more rows than one task should take."""
    return key_sizes(df, keys)[0]


def are_hot(df: DataFrame, outer: Sequence[str], inner: Sequence[str]) -> tuple[bool, bool]:
    """:func:`is_hot` for ``outer + inner`` in ``df``, and for ``outer`` in its groups.

    One action on the source answers both, so that an operator on grouped results need not
    compute them only to learn their size.
    """
    limit = _conf_int(df.sparkSession, "hotRows", HOT_ROWS)
    groups = df.groupBy(*outer, *inner).agg(F.count(F.lit(1)).alias("n"))
    keys = groups.groupBy(*outer).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("g"))
    row = keys.agg(F.max("n"), F.max("g")).first()
    return (row[0] or 0) > limit, (row[1] or 0) > limit


def lookup(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-key facts back. Keys are not null: a row without a key has no facts.

    Plain equality keeps the partitioning of an earlier window or aggregate on the
    same keys; a null-safe comparison would shuffle both sides again.
    ``small`` has one row per key. No broadcast hint: Spark broadcasts it while
    it is under the session's size threshold, and adaptive execution splits a
    skewed key of the large side otherwise.
    """
    renamed = small
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    return df.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def facts(df: DataFrame, small: DataFrame, keys: Sequence[str], number: int, how: str = "left") -> DataFrame:
    """:func:`lookup` of ``number`` facts: up to ``FACTS`` are sent to every task, so no row of ``df`` moves."""
    return lookup(df, F.broadcast(small) if number <= FACTS else small, keys, how)


def spread(df: DataFrame) -> DataFrame:
    """Gives a small input enough partitions for work that is heavy per row.

    A file of one row group is one task however many cores there are. An input of
    many splits is left alone: it is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() < min(2 * cores, 64)
    return df.repartition(cores) if few and cores > 1 else df


def broadcast_if_small(df: DataFrame, rows: int = FACTS) -> DataFrame:
    """``df`` with a broadcast hint when it has at most ``rows`` rows, else as it is.

    Meant for checkpointed results, whose size Spark cannot estimate: without the
    hint the other side would be shuffled before adaptive execution can tell.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    name: str = "idx",
    hot: bool | None = None,
) -> DataFrame:
    """Dense 1-based position of each row within its key.

    ``order`` must be total (end it with a unique column).
    """
    keys = list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    if hot is None:
        hot = is_hot(df, keys)
    if not hot:
        place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
        return df.withColumn(name, place.cast("long"))
    # Runs are contiguous slices of (key, order), so a hot key spans several. The
    # checkpoint pins the slices: both branches below must see the same ones.
    shared_dir(df.sparkSession)
    runs = (
        df.repartitionByRange(*[F.col(k) for k in keys], *order)
        .withColumn("__run", F.spark_partition_id())
        .checkpoint()
    )
    sizes = runs.groupBy(*keys, "__run").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy("__run").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "__run", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")
    )
    local = W.partitionBy(*keys, "__run").orderBy(*order)
    return (
        lookup(runs.withColumn(name, F.row_number().over(local)), offsets, [*keys, "__run"])
        .withColumn(name, F.col(name) + F.col("__off"))
        .drop("__run", "__off")
    )


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    before: int = 0,
    after: int = 0,
    hot: bool | None = None,
) -> DataFrame:
    """Rows ready for window functions that look ``before``/``after`` rows around.

    Adds ``idx`` (position within the key), ``_tile`` and ``_own``. Use
    :func:`around` as the window and keep only ``_own`` rows afterwards. A hot key
    is cut into tiles of bounded size; rows near a border are copied into the
    neighbouring tile with ``_own`` false, so every frame finds its rows.
    """
    if hot is None:
        hot = is_hot(df, keys)
    return tiles(with_index(df, keys, order, hot=hot), keys, before, after, hot)


def tiles(
    indexed: DataFrame, keys: Sequence[str], before: int, after: int, hot: bool
) -> DataFrame:
    """Cuts rows that already carry ``idx``; see :func:`ordered`."""
    if not hot:
        return indexed.withColumn(TILE, F.lit(0).cast("long")).withColumn(OWN, F.lit(True))
    size = max(_conf_int(indexed.sparkSession, "tileRows", TILE_ROWS), before, after, 1)
    tile = F.floor((F.col("idx") - 1) / size)
    pos = F.pmod(F.col("idx") - 1, F.lit(size))
    copies = [F.struct(tile.alias(TILE), F.lit(True).alias(OWN))]
    if before:
        copies.append(
            F.when(pos >= size - before, F.struct((tile + 1).alias(TILE), F.lit(False).alias(OWN)))
        )
    if after:
        copies.append(
            F.when(
                (pos < after) & (tile > 0),
                F.struct((tile - 1).alias(TILE), F.lit(False).alias(OWN)),
            )
        )
    spread = indexed.withColumn("_copy", F.explode(F.array_compact(F.array(*copies))))
    return spread.select(*indexed.columns, f"_copy.{TILE}", f"_copy.{OWN}")


def plain(pdf: pd.DataFrame, key: str) -> pd.DataFrame:
    """The frame with its key as plain objects: text columns of some pandas versions come in chunks."""
    return pdf.astype({key: object})


def around(keys: Sequence[str]) -> W:
    """Window over one tile of :func:`ordered` output."""
    return W.partitionBy(*keys, TILE).orderBy("idx")


def owned(df: DataFrame) -> DataFrame:
    return df.filter(F.col(OWN)).drop(TILE, OWN)


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float], hot: bool | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles per key, for keys of any size.

    Values are ranked by a sort that can spill and only the one or two rows around
    each quantile are aggregated. The percentile function would hold every distinct
    value of a group in memory.
    """
    slim = df.filter(F.col(value).isNotNull()).select(*keys, value)
    if hot is None:
        hot = is_hot(slim, keys)
    ranked = with_index(slim, keys, [value], name="__pos", hot=hot)
    size = F.count(F.lit(1)).alias("__n")
    if hot:
        ranked = lookup(ranked, slim.groupBy(*keys).agg(size), keys)
    else:
        ranked = ranked.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    parts, touched = [], F.lit(False)
    for name, q in points.items():
        at = (F.col("__n") - 1) * F.lit(float(q))
        lo, hi, frac = F.floor(at), F.ceil(at), at - F.floor(at)
        zero = F.col("__pos") - 1
        weight = F.when(zero == lo, 1 - frac).otherwise(0.0) + F.when(
            (zero == hi) & (hi > lo), frac
        ).otherwise(0.0)
        touched = touched | (zero == lo) | (zero == hi)
        parts.append(F.sum(F.col(value) * weight).alias(name))
    return ranked.filter(touched).groupBy(*keys).agg(*parts)


def block_cells(
    df: DataFrame, keys: Sequence[str], idx: str, payload: Sequence[str], block: int = 256
) -> DataFrame:
    """Unordered pairs of row blocks of the same key, ``left_block`` <= ``right_block``.

    ``idx`` is a dense 1-based position. A block is ``left_start`` (its first
    position) and one array per payload column, of at most ``block`` entries, so
    callers do all-against-all work in matrix form inside a task and emit only
    per-row or per-key sums, never row pairs. A key with many blocks is spread over
    cells of at most eight left and eight right blocks, so no group of the join has
    more than 64 products, whatever the key's size.
    """
    band = 8
    packed = (
        df.withColumn("_blk", F.floor((F.col(idx) - 1) / block))
        .groupBy(*keys, "_blk")
        .agg(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("_i"), *payload))).alias("_rows"))
    )

    def side(name: str) -> list[Column]:
        arrays = [F.col("_rows")[c].alias(f"{name}_{c}") for c in payload]
        return [F.col("_blk").alias(f"{name}_block"), F.col("_rows")[0]["_i"].alias(f"{name}_start"), *arrays]

    bands = df.groupBy(*keys).agg(F.floor((F.max(idx) - 1) / block / band).alias("_bands"))
    own = F.floor(F.col("_blk") / band)
    zero = F.lit(0).cast("long")
    left = lookup(packed, bands, keys, "inner").select(
        *keys, own.alias("_row"), F.explode(F.sequence(own, F.col("_bands"))).alias("_cell"), *side("left")
    )
    right = packed.select(*keys, F.explode(F.sequence(zero, own)).alias("_row"), own.alias("_cell"), *side("right"))
    pairs = left.join(right, [*keys, "_row", "_cell"]).filter("left_block <= right_block")
    return pairs.drop("_row", "_cell")


def running_sum(
    df: DataFrame, keys: Sequence[str], value: Column, name: str, idx: str = "idx"
) -> DataFrame:
    """Adds the running total of ``value`` in ``idx`` order, for keys of any size.

    A prefix sum inside each tile plus the total of the tiles before it; the second
    window sees one row per tile.
    """
    size = _conf_int(df.sparkSession, "tileRows", TILE_ROWS)
    cut = df.withColumn("__t", F.floor((F.col(idx) - 1) / size)).withColumn("__v", value)
    inside = W.partitionBy(*keys, "__t").orderBy(idx).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy("__t").rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "__t").agg(F.sum("__v").alias("__s"))
    starts = totals.select(*keys, "__t", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__b"))
    local = cut.withColumn("__in", F.sum("__v").over(inside))
    return (
        lookup(local, starts, [*keys, "__t"])
        .withColumn(name, F.col("__in") + F.col("__b"))
        .drop("__t", "__v", "__in", "__b")
    )
