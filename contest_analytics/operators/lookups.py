"""Lookup, rule and range joins (D).

Rules, tiers and curves are short fixed lists, so they become expressions in the
projection instead of joins. Registries can be large and are joined on their key.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contest_analytics import config as C
from contest_analytics.functions.curves import as_col, clip


def profile_table(spark: SparkSession) -> DataFrame:
    """Tag -> profile, one row per known tag, from the fixed values."""
    rows = [(tag, family, *C.PROFILES[family]) for tag, family in C.GENRE_FAMILIES.items()]
    kinds = ", ".join(
        f"{f} boolean" if f == "vocal_expected" else f"{f} double" for f in C.PROFILE_FIELDS
    )
    return spark.createDataFrame(rows, f"tag string, family string, {kinds}")


def with_profile(
    df: DataFrame,
    key: str,
    profiles: DataFrame,
    default: Mapping[str, object] | None = None,
) -> DataFrame:
    """Adds the profile columns of the trimmed lower-cased ``key``; else the default row."""
    if default is None:
        default = {"family": "default", **dict(zip(C.PROFILE_FIELDS, C.PROFILES["default"]))}
    joined = df.join(profiles, F.lower(F.trim(F.col(key))) == profiles["tag"], "left")
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in default.items()}
    return joined.withColumns(filled).drop("tag")


def family_members(mapping: DataFrame, family="family", member="tag") -> DataFrame:
    """``mapping`` is a dimension table, so a family's list stays small."""
    return mapping.groupBy(family).agg(F.sort_array(F.collect_set(member)).alias("members"))


def keyword_pattern(keywords: Sequence[str]) -> str:
    """Whole-word, case-insensitive alternation with the longest keywords first.

    U: letters of every script count as word characters.
    """
    longest = sorted(keywords, key=lambda k: (-len(k), k))
    return r"(?iU)\b(?:" + "|".join(re.escape(k) for k in longest) + r")\b"


def derive_targets(
    df: DataFrame,
    text: str = "text",
    tag: str = "tag",
    duration: str = "duration",
    rules: Sequence[tuple[Sequence[str], Mapping[str, float]]] = C.TARGET_RULES,
    defaults: Mapping[str, float] = C.TARGET_DEFAULTS,
    bounds: Mapping[str, tuple[float, float]] = C.TARGET_BOUNDS,
) -> DataFrame:
    """Adds one column per target. ``rules`` are ``(keywords, deltas)``."""
    whole = F.trim(
        F.concat_ws(" ", F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(tag), F.lit("")))
    )
    d = F.coalesce(F.col(duration), F.lit(10.0))
    # Each pattern is searched once per row, however many targets it moves.
    hits = F.array(*[whole.rlike(keyword_pattern(words)) for words, _ in rules])
    base = df.withColumn("_whole", whole).withColumn("_hits", hits)
    out = {}
    for field, start in defaults.items():
        value = F.lit(start)
        for i, (_, deltas) in enumerate(rules):
            if field in deltas:
                value = value + F.when(F.col("_hits")[i], deltas[field]).otherwise(0.0)
        if field == "section_variety_target":
            value = value + F.when(d > 30, 0.05).when(d < 5, -0.10).otherwise(0.0)
        if field == "harmonic_progression_min":
            value = value + F.when(d > 30, 0.5).when(d < 5, -0.5).otherwise(0.0)
        out[field] = clip(value, *bounds[field]) if field in bounds else value
    low, high = out["onset_density_min"], out["onset_density_max"]
    middle = (low + high) / 2
    out["onset_density_min"] = F.when(low > high, middle).otherwise(low)
    out["onset_density_max"] = F.when(low > high, middle).otherwise(high)
    final = {
        f: F.when(F.col("_whole") == "", defaults[f]).otherwise(v) for f, v in out.items()
    }
    return base.withColumns(final).drop("_whole", "_hits")


def extract_tag(
    df: DataFrame, col: str, keywords: Mapping[str, Sequence[str]] = C.GENRE_KEYWORDS
) -> DataFrame:
    """Adds ``found_tag``: first category, in order, with a keyword inside the text."""
    lowered = F.lower(F.col(col))
    tag = F.lit(None).cast("string")
    for name, words in reversed(list(keywords.items())):
        hit = F.lit(False)
        for w in words:
            hit = hit | lowered.contains(w)
        tag = F.when(hit, name).otherwise(tag)
    return df.withColumn("found_tag", tag)


def interpolate_curve(
    df: DataFrame,
    x: str,
    anchors: Sequence[tuple[float, Sequence[float]]] = C.CURVE,
    fields: Sequence[str] = C.CURVE_FIELDS,
) -> DataFrame:
    """Piecewise-linear lookup; an anchor value belongs to the interval below it."""
    v = clip(x, anchors[0][0], anchors[-1][0])
    out = {}
    for i, name in enumerate(fields):
        value = F.lit(anchors[-1][1][i])
        for (lo, a), (hi, b) in reversed(list(zip(anchors, anchors[1:]))):
            here = F.lit(a[i]) + (v - lo) / (hi - lo) * F.lit(b[i] - a[i])
            value = F.when(v <= hi, here).otherwise(value)
        out[name] = value
    return df.withColumns(out)


def nearest_tier(level, tiers: Sequence[tuple[float, str]] = C.COMPLEXITY_TIERS) -> Column:
    """Label of the closest threshold; the earlier tier wins a tie."""
    options = [
        F.struct(F.abs(as_col(level) - t).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("n"))
        for i, (t, name) in enumerate(tiers)
    ]
    return F.array_min(F.array(*options))["n"]


def match_identity(
    scores: DataFrame, registry: DataFrame, key="uid", expected="hotkey", actual="hotkey"
) -> DataFrame:
    """Keeps scores whose key is registered under the expected identity (or none given)."""
    r = registry.select(F.col(key), F.col(actual).alias("_actual"))
    want = F.coalesce(F.col(expected), F.lit(""))
    return scores.join(r, key).filter((want == "") | (want == F.col("_actual"))).drop("_actual")


def allowed_callers(
    requests: DataFrame, nodes: DataFrame, min_stake: float, key="hotkey"
) -> DataFrame:
    allowed = nodes.filter(F.col("permit") & (F.col("stake") >= min_stake)).select(key)
    return requests.join(allowed, key, "left_semi")


def request_priority(
    requests: DataFrame,
    nodes: DataFrame,
    caller="hotkey",
    organic="organic",
    boost: float = C.ORGANIC_BOOST,
) -> DataFrame:
    """Stake of the caller plus a boost for user requests; unknown caller -> 0,
    no caller at all -> the boost alone."""
    stakes = nodes.select(F.col("hotkey").alias("_hk"), F.col("stake").alias("_stake"))
    extra = F.when(F.col(organic), boost).otherwise(0.0)
    anonymous = F.coalesce(F.col(caller), F.lit("")) == ""
    return (
        requests.join(stakes, F.col(caller) == F.col("_hk"), "left")
        .withColumn(
            "priority",
            F.when(anonymous, extra)
            .when(F.col("_stake").isNull(), 0.0)
            .otherwise(F.col("_stake") + extra),
        )
        .drop("_hk", "_stake")
    )


def _note_index(root: Column) -> Column:
    names = {n: i for i, n in enumerate(C.NOTES)}
    names.update({alias: names[n] for alias, n in C.ENHARMONIC.items()})
    table = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    return table[root]


def parse_key(text) -> Column:
    """'Bb minor' -> struct(note 0..11, is_minor), or null when it is no key."""
    parts = F.split(F.trim(as_col(text)), r"\s+")
    root = F.initcap(F.lower(F.get(parts, F.lit(0))))
    mode = F.lower(F.get(parts, F.lit(1)))
    note = _note_index(root)
    return F.when(
        note.isNotNull() & mode.isin("major", "minor"),
        F.struct(note.alias("note"), (mode == "minor").alias("is_minor")),
    )


def fifths_distance(a: Column, b: Column) -> Column:
    """Steps between two notes around the circle of fifths (7 semitones a step)."""
    d = F.abs(F.pmod(a * 7, F.lit(12)) - F.pmod(b * 7, F.lit(12)))
    return F.least(d, 12 - d)


def key_match(df: DataFrame, detected: str, requested: str) -> DataFrame:
    """Adds ``key_score``; both columns are key names. Unreadable request -> 0.5."""
    want, got = parse_key(requested), parse_key(detected)
    relative = F.pmod(
        want["note"] + F.when(want["is_minor"], 3).otherwise(9), F.lit(12)
    )
    steps = fifths_distance(want["note"], got["note"])
    return df.withColumn(
        "key_score",
        F.when(want.isNull() | got.isNull(), 0.5)
        .when((want["note"] == got["note"]) & (want["is_minor"] == got["is_minor"]), 1.0)
        .when((got["note"] == relative) & (want["is_minor"] != got["is_minor"]), 0.8)
        .when(steps == 1, 0.5)
        .when(steps == 2, 0.3)
        .otherwise(0.0),
    )


def tempo_match(detected, requested) -> Column:
    """Best of the detected tempo, its half and its double."""
    d, r = as_col(detected), as_col(requested)
    off = F.least(F.abs(d - r), F.abs(d / 2 - r), F.abs(d * 2 - r))
    fall = 1.0 - F.try_divide(off - 0.1 * r, 0.5 * r - 0.1 * r)
    unknown = d.isNull() | r.isNull() | (d <= 0) | (r <= 0)
    return F.when(unknown, 0.5).when(off <= 0.1 * r, 1.0).otherwise(clip(fall))
