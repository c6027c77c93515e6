"""Sources and validation (A)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contest_analytics.functions.curves import as_col

RESPONSE = T.StructType(
    [
        T.StructField("uid", T.LongType()),
        T.StructField("hotkey", T.StringType()),
        T.StructField("payload_b64", T.StringType()),
        T.StructField("generation_time_ms", T.LongType()),
    ]
)
ROUNDS = T.StructType(
    [
        T.StructField("challenge_id", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("genre", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("responses", T.ArrayType(RESPONSE)),
    ]
)
ANNOTATION = T.StructType(
    [
        T.StructField("pair_id", T.StringType()),
        T.StructField("audio_a", T.StringType()),
        T.StructField("audio_b", T.StringType()),
        T.StructField("challenge_id", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("preferred", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)
STATE_VERSIONS = (1, 2, 3)
FORMATS = ("mp3", "wav", "ogg", "flac")


def read_rounds(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Round payloads with a fixed schema: no inference pass over the files."""
    return spark.read.format(fmt).schema(ROUNDS).load(path)


def explode_responses(rounds: DataFrame, col: str = "responses") -> DataFrame:
    """One row per response; a round without responses keeps one row of nulls."""
    rest = [c for c in rounds.columns if c != col]
    return rounds.select(*rest, F.explode_outer(col).alias("_r")).select(*rest, "_r.*")


def parse_annotations(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """``(good, bad)`` from a column of JSON lines; blank lines are ignored.

    ``bad`` keeps the lines that are no JSON object, so they can be counted.
    """
    schema = T.StructType([*ANNOTATION.fields, T.StructField("_corrupt", T.StringType())])
    parsed = (
        lines.filter(F.trim(F.col(value)) != "")
        .withColumn(
            "_p",
            F.from_json(
                value, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
            ),
        )
    )
    broken = F.col("_p").isNull() | F.col("_p._corrupt").isNotNull()
    good = parsed.filter(~broken).select("_p.*").drop("_corrupt")
    good = good.withColumn("timestamp", F.try_to_timestamp("timestamp"))
    return good, parsed.filter(broken).select(value)


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_annotations(spark.read.text(path))


def scan_files(
    spark: SparkSession,
    folder: str,
    exts: Sequence[str] = ("wav", "mp3", "flac", "ogg"),
    max_files: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Binary files below ``folder``, in path order if ``ordered``. Listing reads no content
    when only ``path`` and ``length`` are used."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    )
    suffix = F.lower(F.substring_index("path", ".", -1))
    kept = found.filter(suffix.isin([e.lower().lstrip(".") for e in exts]))
    if ordered or max_files is not None:
        kept = kept.orderBy("path")
    return kept if max_files is None else kept.limit(max_files)


#: A round's sidecar.
SIDECAR = T.StructType(
    [
        T.StructField("prompt", T.StringType()),
        T.StructField("genre", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()),
    ]
)


def round_of(path) -> Column:
    """The challenge a file belongs to: its folder, or the folder ``challenge=...`` above it."""
    named = F.regexp_extract(as_col(path), r"/challenge=([^/]+)/", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.regexp_extract(as_col(path), r"([^/]+)/[^/]+$", 1))


def uid_of(path) -> Column:
    """The contributor of a file: the number in its name, or in the folder ``uid=...`` above it."""
    named = F.regexp_extract(as_col(path), r"/uid=([^/]+)/", 1)
    stem = F.regexp_extract(as_col(path), r"([^/]+?)(?:\.[^./]+)?$", 1)
    return F.coalesce(F.nullif(named, F.lit("")), stem).try_cast("long")


def read_round_tree(
    spark: SparkSession, folder: str, exts: Sequence[str] = ("wav", "mp3", "flac", "ogg"), sidecar: str = "*.json"
) -> DataFrame:
    """Responses kept as files: ``<challenge>/<uid>.<ext>`` beside a sidecar of the challenge.

    Returns ``challenge_id``, ``prompt``, ``genre``, ``duration_seconds``, ``uid``, ``path``, ``length``
    and ``payload``, a row for each file. Folders may also be written by ``partitionBy``, as
    ``challenge=<challenge>/uid=<uid>/``. A challenge without a sidecar keeps its files, with nulls;
    of several sidecars the first by path counts; a file whose name is no number has a null ``uid``.
    """
    files = scan_files(spark, folder, exts, ordered=False).select(
        round_of("path").alias("challenge_id"),
        uid_of("path").alias("uid"),
        "path",
        "length",
        F.col("content").alias("payload"),
    )
    meta = (
        spark.read.schema(SIDECAR)
        .option("multiLine", True)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", sidecar)
        .json(folder)
        .select(F.col("_metadata.file_path").alias("at"), *SIDECAR.names)
    )
    first = meta.groupBy(round_of("at").alias("challenge_id")).agg(F.min_by(F.struct(*SIDECAR.names), "at").alias("m"))
    joined = files.join(first, "challenge_id", "left")
    return joined.select("challenge_id", *[F.col(f"m.{c}").alias(c) for c in SIDECAR.names], "uid", "path", "length", "payload")


def attach_metadata(
    pairs: DataFrame, meta: DataFrame, folder_a: str = "folder_a", folder_b: str = "folder_b"
) -> DataFrame:
    """Adds ``prompt`` and ``genre``: A's sidecar first, then B's, else ''."""
    out = pairs
    for side, col in (("a", folder_a), ("b", folder_b)):
        m = meta.select(
            F.col("folder").alias(col),
            F.nullif("prompt", F.lit("")).alias(f"_prompt_{side}"),
            F.nullif("genre", F.lit("")).alias(f"_genre_{side}"),
        )
        out = out.join(m, col, "left")
    for f in ("prompt", "genre"):
        out = out.withColumn(f, F.coalesce(f"_{f}_a", f"_{f}_b", F.lit(""))).drop(
            f"_{f}_a", f"_{f}_b"
        )
    return out


def path_to_key(path) -> Column:
    """Last two path parts, joined by '/', without the last extension."""
    p = as_col(path)
    parent = F.regexp_extract(p, r"([^/]+)/+[^/]+/*$", 1)
    name = F.regexp_extract(p, r"([^/]+)/*$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    return F.concat_ws("/", F.nullif(parent, F.lit("")), stem)


def referenced_assets(annotations: DataFrame, a: str = "audio_a", b: str = "audio_b") -> DataFrame:
    """Distinct non-empty paths of both sides, skipped pairs included, sorted."""
    both = annotations.select(F.explode(F.array(a, b)).alias("path"))
    return both.filter(F.col("path").isNotNull() & (F.col("path") != "")).distinct().orderBy("path")


def cache_missing(
    keys: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "key"
) -> tuple[DataFrame, DataFrame]:
    """``(new, failed)``: computed rows for uncached keys, and keys that gave no vector."""
    todo = keys.select(key).distinct().join(cache.select(key), key, "left_anti")
    done = compute(keys.join(todo, key, "left_semi"))
    new = done.filter(F.col("vec").isNotNull())
    return new, todo.join(new.select(key), key, "left_anti")


def validate_requests(df: DataFrame) -> DataFrame:
    """Adds ``valid`` and ``reasons``."""

    def outside(c: str, lo: float, hi: float) -> Column:
        return F.col(c).isNotNull() & ~F.col(c).between(lo, hi)

    n = F.length(F.coalesce("prompt", F.lit("")))
    reasons = F.array_compact(
        F.array(
            F.when(outside("tempo_bpm", 20, 300), "tempo"),
            F.when(outside("duration_seconds", 1, 180), "duration"),
            F.when(~n.between(1, 2000), "prompt"),
            F.when(outside("num_variations", 1, 5), "variations"),
            F.when(~F.coalesce(F.col("format"), F.lit("wav")).isin(*FORMATS), "format"),
            F.when(F.length("lyrics") > 5000, "lyrics"),
        )
    )
    return df.withColumn("reasons", reasons).withColumn("valid", F.size("reasons") == 0)


def validate_state(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(ok, rejected)`` from untyped rows ``(version, uid, ema, rounds, hotkey)``.

    A bad score rejects the row with a reason. A bad count becomes 0 and an empty
    identity null, as both are optional.
    """
    uid = F.col("uid").try_cast("long")
    ema = F.col("ema").try_cast("double")
    reason = (
        F.when(~F.coalesce(F.col("version").try_cast("int").isin(*STATE_VERSIONS), F.lit(False)), "version")
        .when(uid.isNull(), "uid")
        .when(uid < 0, "negative_uid")
        .when(ema.isNull(), "ema")
        .when(~ema.between(0.0, 1.0) | F.isnan(ema), "ema_range")
    )
    marked = df.withColumn("reason", reason)
    count = F.col("rounds").try_cast("long")
    ok = marked.filter(F.col("reason").isNull()).select(
        F.col("version").try_cast("int").alias("version"),
        uid.alias("uid"),
        ema.alias("ema"),
        F.when(count >= 0, count).otherwise(0).alias("rounds"),
        F.nullif("hotkey", F.lit("")).alias("hotkey"),
    )
    return ok, marked.filter(F.col("reason").isNotNull())
