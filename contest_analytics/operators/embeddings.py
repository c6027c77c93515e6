"""Embedding analytics (F) on ``array<double>`` columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contest_analytics import config as C
from contest_analytics.functions.curves import as_col, clip, remap
from contest_analytics.functions.vectors import dot, norm, scaled
from contest_analytics.operators.autocorrelation import lag_sums
from contest_analytics.scale import (
    TILE,
    around,
    block_cells,
    broadcast_if_small,
    is_hot,
    lookup,
    ordered,
    owned,
    quantiles,
    shared_dir,
    spread,
    with_index,
)


def mean_vector(vec) -> Column:
    """Element-wise mean as an aggregate with partial sums."""
    return vector_to_array(Summarizer.mean(array_to_vector(as_col(vec))))


def sum_vector(vec) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(as_col(vec))))


def normalize_vectors(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Unit vectors; null and near-zero vectors are dropped."""
    return (
        df.filter(F.col(vec).isNotNull())
        .withColumn("_n", norm(vec))
        .filter(F.col("_n") >= 1e-8)
        .withColumn(vec, scaled(vec, 1.0 / F.col("_n")))
        .drop("_n")
    )


def cosine_score(a, b) -> Column:
    unit = F.try_divide(dot(a, b), norm(a) * norm(b))
    return remap(unit, C.COSINE_FLOOR, C.COSINE_CEILING)


def _units(vectors: pa.Array) -> np.ndarray:
    """Vectors as unit rows; not a number for null vectors and components."""
    sizes = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    data = np.zeros((len(vectors), sizes.max(initial=0)))
    data[np.arange(data.shape[1]) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    data[vectors.is_null().to_numpy(zero_copy_only=False)] = np.nan
    return data / (np.sqrt((data * data).sum(axis=1, keepdims=True)) + 1e-8)


def banded_means(units: np.ndarray, first: np.ndarray, skip: int, n: int, chunk: int = 256) -> np.ndarray:
    """For each row from ``skip`` on, the mean distance to the up to ``n`` rows before it, from
    ``first`` of it on; one half where there are none."""
    out = np.empty(len(units) - skip)
    for start in range(skip, len(units), chunk):
        rows = np.arange(start, min(start + chunk, len(units)))
        from_row = np.maximum(first[rows - skip], rows - n)
        base = max(start - n, 0)
        gaps = np.clip(1.0 - units[rows] @ units[base : rows[-1]].T, 0.0, 1.0)
        places = np.arange(base, rows[-1])
        inside = (places >= from_row[:, None]) & (places < rows[:, None])
        held = inside.sum(axis=1)
        total = np.where(inside, gaps, 0.0).sum(axis=1)
        out[rows - skip] = np.where(held > 0, total / np.maximum(held, 1), 0.5)
    return out


def history_diversity(
    df: DataFrame, key: str, order: Sequence[str], vec: str = "vec", n: int = C.HISTORY
) -> DataFrame:
    """Adds ``own_diversity``: mean distance to the up to ``n`` previous vectors of the key.

    Rows pass through in the order of their key; a batch is multiplied with itself and the ``n``
    vectors carried over from the batch before, along the band that counts. Null where the vector
    or one of the previous ones is null.
    """
    hot = is_hot(df, [key])
    tiled = ordered(df, [key], order, before=n, hot=hot)
    if hot:
        tiled = tiled.repartition(key, TILE)
    spot_key, spot_tile = tiled.columns.index(key), tiled.columns.index(TILE)
    spot_vec = tiled.columns.index(vec)
    schema = T.StructType([*tiled.schema.fields, T.StructField("own_diversity", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, current = np.empty((0, 0)), None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(batch.column(spot_key).to_pylist(), batch.column(spot_tile).to_pylist(), strict=True))
            units = _units(batch.column(spot_vec))
            if names[0] != current:
                carried = carried[:0]
            width = max(units.shape[1], carried.shape[1])
            pad = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
            whole, skip = np.concatenate([pad(carried), pad(units)]), len(carried)
            new = np.array([i > 0 and names[i] != names[i - 1] for i in range(len(names))])
            # Where each row's key begins among the carried and the new vectors.
            first = np.maximum.accumulate(np.where(new, np.arange(len(names)) + skip, 0))
            means = banded_means(whole, first, skip, n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(means, from_pandas=True)], schema.names)
            current = names[-1]
            carried = whole[max(int(first[-1]), len(whole) - n) :]

    rows = tiled.sortWithinPartitions(key, TILE, "idx").mapInArrow(run, schema)
    return owned(rows).drop("idx")


def population_diversity(
    df: DataFrame, batch: str, key: str, unique: str, vec: str = "vec"
) -> DataFrame:
    """Adds ``population_diversity``: mean distance to other keys' vectors of the batch.

    All-against-all inside a batch is done block by block as matrix products; what
    leaves a task is one partial sum per row and block pair.
    """
    kind = df.schema[key].dataType.simpleString()
    unique_kind = df.schema[unique].dataType.simpleString()
    unit = df.filter(F.col(vec).isNotNull()).select(
        batch, key, unique, scaled(vec, 1.0 / (norm(vec) + 1e-8)).alias("_u")
    )
    placed = with_index(unit, [batch], [unique], "_i")
    cells = block_cells(placed, [batch], "_i", [unique, key, "_u"], block=256)

    def sums(batches):
        for pdf in batches:
            out = []
            for i in range(len(pdf)):
                row = pdf.iloc[i]
                a, b = np.stack(row["left__u"]), np.stack(row["right__u"])
                ka, kb = np.asarray(row[f"left_{key}"]), np.asarray(row[f"right_{key}"])
                gaps = np.clip(1.0 - a @ b.T, 0.0, 1.0)
                other = ka[:, None] != kb[None, :]
                gaps = gaps * other
                out.append((row[f"left_{unique}"], gaps.sum(1), other.sum(1)))
                if row["left_block"] != row["right_block"]:
                    out.append((row[f"right_{unique}"], gaps.sum(0), other.sum(0)))
            yield pd.DataFrame(
                {
                    "_id": np.concatenate([ids for ids, _, _ in out]) if out else [],
                    "_s": np.concatenate([s for _, s, _ in out]) if out else [],
                    "_c": np.concatenate([c for _, _, c in out]) if out else [],
                }
            )

    parts = cells.drop("left_start", "right_start", batch).mapInPandas(
        sums, f"_id {unique_kind}, _s double, _c long"
    )
    means = parts.groupBy(F.col("_id").alias(unique)).agg(
        F.sum("_s").alias("_s"), F.sum("_c").alias("_c")
    )
    return lookup(df, means, [unique]).withColumn(
        "population_diversity",
        F.when(F.coalesce(F.col("_c"), F.lit(0)) > 0, F.col("_s") / F.col("_c")).otherwise(0.5),
    ).drop("_s", "_c")


def combined_diversity(own, population, vec) -> Column:
    share = C.POPULATION_SHARE
    mixed = (1.0 - share) * as_col(own) + share * as_col(population)
    return F.when(as_col(vec).isNull(), 0.0).otherwise(clip(mixed))


def diversity(
    df: DataFrame, key: str, batch: str, order: Sequence[str], unique: str, vec: str = "vec"
) -> DataFrame:
    """Adds ``diversity``; a missing vector scores 0 and counts for nobody."""
    present = df.filter(F.col(vec).isNotNull())
    own = history_diversity(present, key, order, vec).select(unique, "own_diversity")
    pop = population_diversity(present, batch, key, unique, vec).select(
        unique, "population_diversity"
    )
    joined = lookup(lookup(df, own, [unique]), pop, [unique])
    return joined.withColumn(
        "diversity", combined_diversity("own_diversity", "population_diversity", vec)
    )


def vector_moments(df: DataFrame, vec: str = "vec") -> DataFrame:
    """One row ``(n, mean, cov)``: sample covariance of all vectors.

    Each task adds up one Gram matrix of its rows and emits it row by row; the
    partial rows are summed in two levels, so no task sees more than a few hundred.
    """

    def partial(batches):
        n, s, g = 0, None, None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf[vec].to_numpy())
            n += len(x)
            s = x.sum(0) if s is None else s + x.sum(0)
            g = x.T @ x if g is None else g + x.T @ x
        if n:
            salt = TaskContext.get().partitionId() % 64
            rows = [s, *g]
            yield pd.DataFrame(
                {"i": range(-1, len(s)), "salt": salt, "n": n, "v": [list(r) for r in rows]}
            )

    def add(keys):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            v = np.stack(pdf["v"].to_numpy()).sum(0)
            head = {k: [pdf[k].iloc[0]] for k in keys}
            return pd.DataFrame({**head, "n": [pdf["n"].sum()], "v": [list(v)]})

        return run

    parts = df.select(vec).mapInPandas(partial, "i int, salt int, n long, v array<double>")
    level1 = parts.groupBy("i", "salt").applyInPandas(
        add(["i", "salt"]), "i int, salt int, n long, v array<double>"
    )
    rows = level1.drop("salt").groupBy("i").applyInPandas(add(["i"]), "i int, n long, v array<double>")
    whole = rows.agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "v"))).alias("r")
    )
    # Row -1 holds the sums; the others are the rows of the Gram matrix.
    n = F.col("n")
    mean = F.transform(F.col("r")[0]["v"], lambda v: v / n)
    gram = F.slice("r", F.lit(2), F.size("r") - 1)
    cov = F.transform(
        gram,
        lambda row: F.transform(
            row["v"],
            lambda v, j: (v - n * F.get(F.col("mean"), row["i"]) * F.get(F.col("mean"), j)) / (n - 1),
        ),
    )
    return whole.filter("n > 1").withColumn("mean", mean).select("n", "mean", cov.alias("cov"))


def fit_distribution(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Moments of the normalised vectors with 1e-6 on the diagonal; none under 10 vectors."""
    m = vector_moments(normalize_vectors(df, vec), vec).filter(F.col("n") >= C.MIN_VECTORS)
    ridge = F.transform(
        "cov",
        lambda row, i: F.transform(row, lambda v, j: v + F.when(i == j, 1e-6).otherwise(0.0)),
    )
    return m.withColumn("cov", ridge)


def _root(m: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return (vectors * np.sqrt(np.clip(values, 0, None))) @ vectors.T


def frechet(mean1, cov1, mean2, cov2) -> float:
    """Frechet distance of two Gaussians by symmetric roots; never negative."""
    half = _root(cov1)
    cross = np.linalg.eigvalsh(half @ cov2 @ half)
    gap = mean1 - mean2
    trace = np.trace(cov1) + np.trace(cov2) - 2 * np.sqrt(np.clip(cross, 0, None)).sum()
    return max(0.0, float(gap @ gap + trace))


def frechet_distance(
    df: DataFrame,
    ref: DataFrame,
    key: str,
    order: Sequence[str],
    vec: str = "vec",
    n: int = C.HISTORY,
    minimum: int = C.MIN_VECTORS,
) -> DataFrame:
    """``(key, n, distance)`` of each key's last ``n`` vectors to the reference.

    Spark keeps only ``n`` rows per key before the shuffle, so a group is at most
    n x D numbers. The reference is one row; it goes to the executors once.
    """
    unit = normalize_vectors(df.select(key, *order, vec), vec)
    last = W.partitionBy(key).orderBy(*[F.col(o).desc() for o in order])
    recent = unit.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= n)
    row = ref.first()
    model = None
    if row is not None:
        model = df.sparkSession.sparkContext.broadcast((np.array(row["mean"]), np.array(row["cov"])))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        d = None
        if model is not None and len(pdf) >= minimum:
            x = np.stack(pdf.sort_values("_r")[vec].to_numpy())
            cov = np.cov(x, rowvar=False) + np.eye(x.shape[1]) * 1e-6
            d = frechet(*model.value, x.mean(0), cov)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n": [len(pdf)], "distance": [d]})

    kind = df.schema[key].dataType.simpleString()
    return recent.groupBy(key).applyInPandas(one, f"{key} {kind}, n long, distance double")


def distance_penalty(d) -> Column:
    x = as_col(d) / C.DISTANCE_MIDPOINT
    low = C.DISTANCE_FLOOR
    return F.when(as_col(d).isNull(), 1.0).otherwise(
        clip(low + (1.0 - low) / (1.0 + F.pow(x, F.lit(C.DISTANCE_POWER))), low, 1.0)
    )


def label_presence(
    requests: DataFrame, labels: DataFrame, item="item", vec="vec", wanted="labels"
) -> DataFrame:
    """``(item, presence)``: share of the requested labels found in the item; none -> 0.5."""
    named = labels.select(F.col("label").alias("_label"), F.col("vec").alias("_lv"))
    asked = requests.select(item, vec, F.explode_outer(wanted).alias("_label"))
    scored = asked.join(named, "_label", "left")
    hit = F.coalesce((cosine_score(vec, "_lv") > 0.25).cast("double"), F.lit(0.0))
    return scored.groupBy(item).agg(
        F.coalesce(F.avg(F.when(F.col("_label").isNotNull(), hit)), F.lit(0.5)).alias("presence")
    )


def sequence_coherence(
    df: DataFrame, key: str, order: Sequence[str], vec: str = "vec", minimum: int = 4
) -> DataFrame:
    """``(key, coherence)``: mean cosine of consecutive vectors, null under ``minimum`` steps."""
    unit = df.select(key, *order, scaled(vec, 1.0 / F.greatest(norm(vec), F.lit(1e-12))).alias("_u"))
    tiled = ordered(unit, [key], order, before=1)
    step = dot(F.col("_u"), F.lag("_u").over(around([key])))
    return owned(tiled.withColumn("_c", step)).groupBy(key).agg(
        F.when(F.count(F.lit(1)) >= minimum, F.avg("_c")).alias("coherence")
    )


def activation_strength(df: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    return df.groupBy(key).agg(F.avg(norm(vec)).alias("strength"))


def mean_pairwise_cosine(df: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    """``(keys, agreement, n)`` over unit vectors, without forming pairs:
    the sum over pairs is (|sum u|^2 - sum |u|^2) / 2."""
    s = df.groupBy(*keys).agg(
        sum_vector(unit).alias("_s"),
        F.sum(dot(unit, unit)).alias("_q"),
        F.count(F.lit(1)).alias("n"),
    )
    n = F.col("n")
    value = F.try_divide(dot("_s", "_s") - F.col("_q"), n * (n - 1))
    return s.select(*keys, F.when(n >= 2, value).alias("agreement"), "n")


def group_agreement(df: DataFrame, key: str, layer: str, vec: str = "vec") -> DataFrame:
    """Mean pairwise cosine of a group's layer means; null with fewer than two layers."""
    means = df.groupBy(key, layer).agg(mean_vector(vec).alias("_m"))
    unit = means.withColumn("_m", scaled("_m", 1.0 / F.greatest(norm("_m"), F.lit(1e-12))))
    return mean_pairwise_cosine(unit, [key], "_m").select(key, "agreement")


def sequence_periodicity(
    df: DataFrame, key: str, order: Sequence[str], vec: str = "vec", minimum: int = 8
) -> DataFrame:
    """``(key, periodicity)``: largest mean lagged cosine over lags 1..T/2-1."""
    unit = df.select(key, *order, scaled(vec, 1.0 / F.greatest(norm(vec), F.lit(1e-12))).alias("_u"))
    sums = lag_sums(unit, key, order, "_u", lambda n: (1, n // 2 if n >= minimum else 0))
    mean = F.col("_sum") / (F.col("_n") - F.col("lag"))
    best = sums.groupBy(key).agg(F.max(mean).alias("periodicity"))
    return lookup(df.select(key).distinct(), best, [key])


def calibrate(df: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Per metric: count, mean, population std, median, min, max, and a bell's centre/width."""
    hot = is_hot(df, [metric])
    medians = quantiles(df, [metric], value, {"median": 0.5}, hot)
    stats = df.groupBy(metric).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    s = F.greatest(F.col("std"), F.lit(1e-6))
    return lookup(stats, medians, [metric]).withColumns(
        {"center": F.col("median"), "width": 1.0 / (2.0 * s * s)}
    )


def dual_vectors(a: DataFrame, b: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """Both parts required; the result is their concatenation."""
    second = b.select(key, F.col(vec).alias("_b"))
    return a.select(key, vec).join(second, key).select(key, F.concat(vec, "_b").alias(vec))


def fingerprint_hash(fp) -> Column:
    """16 hex digits over the first 64 components as big-endian 32-bit words."""
    hexes = F.transform(
        F.slice(as_col(fp), 1, 64), lambda v: F.lpad(F.hex(v.cast("long")), 8, "0")
    )
    return F.substring(F.sha2(F.unhex(F.array_join(hexes, "")), 256), 1, 16)


def with_shingles(df: DataFrame, text: str, out: str, size: int = 5) -> DataFrame:
    """Adds the word n-grams of the whole text (all its words when shorter).

    Use explode_outer on the result (it is never empty): for explode, Spark adds a
    filter on its size that computes it once more, ahead of any join.

    The words are a column of their own, so the text is split once; n-grams come
    from zipping the words with their own shifts.
    """
    w = F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda x: x != "")
    n = F.size("_w")
    grams = F.col("_w")
    for k in range(1, size):
        shifted = F.slice("_w", F.lit(k + 1), F.greatest(n - k, F.lit(0)))
        grams = F.zip_with(grams, shifted, lambda a, b: F.concat(a, F.lit(" "), b))
    full = F.slice(grams, F.lit(1), F.greatest(n - size + 1, F.lit(0)))
    whole = F.when(n >= size, full).otherwise(F.array(F.array_join("_w", " ")))
    return df.withColumn("_w", w).withColumn(out, whole).drop("_w")


#: Bytes of text whose words are held at a time.
CODE_BYTES = 4 << 20
SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def shingle_codes(text: Column, size: int = 5) -> Column:
    """Distinct 64-bit codes of a lower-cased text's word n-grams.

    Words of an Arrow batch are hashed once each; a code is a polynomial of the
    hashes of neighbouring words, computed for a whole text at a time. The words of at most
    ``CODE_BYTES`` of texts, or of one longer text, are held in Python.
    """

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def codes(texts: pa.Array) -> pa.Array:
        return code_lists(texts, size)

    return codes(text)


def code_lists(texts: pa.Array, size: int) -> pa.Array:
    """The distinct codes of each text; null and empty texts have that of no words."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    out, at = [], 0
    while at < len(texts):
        start = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, start + CODE_BYTES, "right")))
        out += _codes(texts.slice(at, stop - at).to_pylist(), size)
        at = stop
    places = np.cumsum([0, *map(len, out)])
    values = np.concatenate(out) if out else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(values))


def _codes(texts: list[str | None], size: int) -> list[np.ndarray]:
    split = [[w for w in SPACE.split(t) if w] if t else [] for t in texts]
    flat = np.array([w for ws in split for w in ws], dtype=object)
    which, unique = pd.factorize(flat)
    hashes = pd.util.hash_array(unique)[which] if len(flat) else np.array([], np.uint64)
    out, at = [], 0
    for ws in split:
        h = hashes[at : at + len(ws)]
        at += len(ws)
        width = min(size, len(h))
        code = np.zeros(len(h) - width + 1, np.uint64)
        for k in range(width):
            code = code * np.uint64(6364136223846793005) + h[k : k + len(code)]
        out.append(np.unique(code).view(np.int64))
    return out


def known_content_penalty(
    subs: DataFrame,
    catalogue: DataFrame,
    key: str = "id",
    item: str = "item",
    text: str = "text",
    threshold: float = C.KNOWN_MATCH,
    size: int = 5,
) -> DataFrame:
    """``(key, best_match, penalty)``: 0 where a catalogue item is contained by ``threshold``.

    Equal texts are matched once. A match must share one of an item's rarest
    shingles: with n shingles and k needed, any n-k+1 of them contain a shared one.
    Choosing the rarest keeps passages that everybody copies out of the candidate
    join, and loses nothing. Texts are never shuffled: only the codes of shingles
    that occur in the catalogue leave the scan.
    """
    marked = spread(subs.select(key, F.col(text).alias("_text"))).withColumn(
        "_h", F.sha2("_text", 256)
    )
    items = with_shingles(catalogue.select(item, text), text, "_ts", size)
    items = items.select(item, F.explode_outer(F.array_distinct("_ts")).alias("_t"))
    # A shingle is a text of its own: the same code comes out for it and for its text.
    items = items.withColumn("_g", shingle_codes(F.col("_t"), size)[0])
    grams = marked.select("_h", F.explode(shingle_codes(F.lower("_text"), size)).alias("_g"))
    shared_dir(subs.sparkSession)
    hits = grams.join(items.select("_g").distinct(), "_g", "left_semi").distinct().checkpoint()
    frequency = hits.groupBy("_g").agg(F.count(F.lit(1)).alias("_df"))
    sizes = items.groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
    ranked = (
        items.join(frequency, "_g", "left")
        .withColumn("_df", F.coalesce("_df", F.lit(0)))
        .withColumn("_r", F.row_number().over(W.partitionBy(item).orderBy("_df", "_g", "_t")))
        .join(sizes, item)
    )
    need = F.ceil(F.col("_n") * threshold - 1e-9)
    probes = ranked.filter(F.col("_r") <= F.col("_n") - need + 1).select(item, "_g")
    candidates = hits.join(probes, "_g").select("_h", item).distinct().checkpoint()
    # Hash codes only name candidates; the match is counted on the words themselves.
    wanted = broadcast_if_small(candidates.select("_h").distinct())
    named = marked.join(wanted, "_h", "left_semi")
    words = with_shingles(named.select("_h", "_text"), "_text", "_ts", size).select(
        "_h", F.explode_outer("_ts").alias("_t")
    )
    shared = (
        candidates.join(items.select(item, "_t"), item)
        .join(words, ["_h", "_t"], "left_semi")
        .groupBy("_h", item)
        .agg(F.count(F.lit(1)).alias("_c"))
        .join(sizes, item)
    )
    best = (
        shared.withColumn("_m", F.col("_c") / F.col("_n"))
        .filter(F.col("_m") >= threshold)
        .groupBy("_h")
        .agg(F.max("_m").alias("best_match"))
    )
    return marked.select(key, "_h").join(best, "_h", "left").select(
        key,
        "best_match",
        F.when(F.col("best_match") >= threshold, 0.0).otherwise(1.0).alias("penalty"),
    )
