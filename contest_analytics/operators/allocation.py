"""Challenge tables, work allocation and time bucketing (H)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contest_analytics import config as C
from contest_analytics.functions.curves import as_col
from contest_analytics.scale import with_index

# An own vocabulary for generated challenges: dances and styles with usual beats per minute.
TEMPO_RANGES = {
    "waltz": (84, 176), "tango": (112, 132), "samba": (96, 108), "polka": (108, 126),
    "bolero": (92, 104), "mambo": (180, 204), "cha-cha": (116, 128), "rumba": (100, 112),
    "quickstep": (192, 208), "foxtrot": (112, 120), "swing": (132, 184), "march": (112, 124),
    "minuet": (100, 126), "gigue": (120, 152), "ballad": (58, 84), "lullaby": (54, 76),
    "hymn": (66, 96), "shanty": (88, 116), "ragtime": (144, 192), "boogie": (136, 176),
    "dub": (62, 86), "synthwave": (84, 118), "breakbeat": (124, 146), "drone": (48, 66),
}
MOODS = [
    "playful", "solemn", "restless", "tender", "stormy", "hopeful", "weary", "mischievous",
    "stately", "wistful", "fierce", "drowsy",
]
DURATIONS = [5.0, 8.0, 10.0, 12.0, 15.0, 20.0, 25.0, 30.0]
KEYS = [f"{note} {mode}" for note in C.NOTES for mode in ("major", "minor")]
TIME_SIGNATURES = ["4/4", "3/4", "6/8", "2/4", "5/4", "7/8"]
VOCAL_SHARE = 0.20

TEMPLATES = [
    "A {mood} {genre} piece around {tempo} BPM with {items}",
    "{genre} at {tempo} BPM, {mood}, played on {items}",
    "Take {items} and make {mood} {genre} at {tempo} BPM",
]


def draw(seed, unique, field: str) -> Column:
    """A reproducible 32-bit number per row and field."""
    text = F.concat_ws(":", as_col(seed), as_col(unique).cast("string"), F.lit(field))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def choose(number: Column, options: Sequence) -> Column:
    values = F.array(*[F.lit(o) for o in options])
    return F.get(values, F.pmod(number, F.lit(len(options))).cast("int"))


def challenges_for(
    ids: DataFrame,
    unique: str,
    seed: str,
    tempo_ranges: Mapping[str, tuple[int, int]] = TEMPO_RANGES,
    moods: Sequence[str] = MOODS,
) -> DataFrame:
    """One reproducible challenge per row of ``ids``; no shuffle."""
    s = F.lit(seed)
    genres = list(tempo_ranges)
    spans = F.create_map(
        *[
            v
            for g, (lo, hi) in tempo_ranges.items()
            for v in (F.lit(g), F.array(F.lit(lo), F.lit(hi)))
        ]
    )
    df = ids.select(unique).withColumn("genre", choose(draw(s, unique, "genre"), genres))
    span = spans[F.col("genre")]
    low, width = span[0], span[1] - span[0] + 1
    return df.withColumns(
        {
            "mood": choose(draw(s, unique, "mood"), moods),
            "tempo": (low + F.pmod(draw(s, unique, "tempo"), width)).cast("int"),
            "duration": choose(draw(s, unique, "duration"), DURATIONS),
            "key_signature": choose(draw(s, unique, "key"), KEYS),
            "time_signature": choose(draw(s, unique, "time"), TIME_SIGNATURES),
            "vocals_requested": draw(s, unique, "vocals") < int(VOCAL_SHARE * 2**32),
            "challenge_id": F.substring(
                F.sha2(F.concat_ws(":", s, F.col(unique).cast("string"), F.lit("id")), 256), 1, 16
            ),
        }
    )


def generate_challenges(spark: SparkSession, n: int, seed: str, **vocab) -> DataFrame:
    return challenges_for(spark.range(n), "id", seed, **vocab)


def sample_from_pool(
    df: DataFrame, unique: str, pool: str, seed: str, low: int = 2, high: int = 4
) -> DataFrame:
    """Adds ``sampled``: low..high distinct items of the row's pool, in hash order."""
    s = F.lit(seed)
    count = low + F.pmod(draw(s, unique, "count"), F.lit(high - low + 1))
    tagged = F.transform(
        F.array_distinct(F.col(pool)),
        lambda x: F.struct(
            F.sha2(F.concat_ws(":", s, F.col(unique).cast("string"), x), 256).alias("h"),
            x.alias("x"),
        ),
    )
    picked = F.slice(F.array_sort(tagged), F.lit(1), count.cast("int"))
    return df.withColumn("sampled", F.transform(picked, lambda t: t["x"]))


def listed(items) -> Column:
    """['a','b','c'] -> 'a, b and c'."""
    a = as_col(items)
    n = F.size(a)
    head = F.array_join(F.slice(a, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n > 1, F.concat(head, F.lit(" and "), F.element_at(a, -1))).otherwise(
        F.coalesce(F.get(a, F.lit(0)), F.lit(""))
    )


def render_prompts(
    df: DataFrame,
    fields: Mapping[str, str],
    items: str,
    constraint: str | None = None,
    templates: Sequence[str] = TEMPLATES,
    pick: Column | None = None,
) -> DataFrame:
    """Adds ``prompt``: the chosen template with ``{field}`` filled in."""
    text = choose(pick, templates) if pick is not None else F.lit(templates[0])
    for name, col in fields.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.col(col).cast("string"))
    text = F.replace(text, F.lit("{items}"), listed(items))
    if constraint:
        text = F.concat(text, F.lit(", "), F.col(constraint), F.lit("."))
    return df.withColumn("prompt", text)


def active_members(
    commits: DataFrame, nodes: DataFrame, epoch: str, min_stake: float = 10_000.0
) -> DataFrame:
    """Members that committed this epoch, with permit and stake; ``member`` = 0.. by uid."""
    matched = nodes.filter(F.col("permit") & (F.col("stake") >= min_stake)).join(
        commits.filter(F.col("value") == epoch).select("hotkey"), "hotkey", "left_semi"
    )
    placed = with_index(matched.select("uid", "hotkey"), [], ["uid"], "member")
    return placed.withColumn("member", F.col("member") - 1)


def partition_ids(ids: DataFrame, uid: str, n: int, epoch: str) -> DataFrame:
    """``(uid, subset)``: disjoint balanced subsets 0..n-1 in an order seeded by the epoch."""
    seed = F.sha2(F.lit(str(epoch)), 256)
    mark = F.sha2(F.concat(seed, F.col(uid).cast("string")), 256)
    placed = with_index(ids.select(uid, mark.alias("_m")), [], ["_m", uid], "_p")
    return placed.select(uid, F.pmod(F.col("_p") - 1, F.lit(n)).alias("subset"))


def assignments(
    parts: DataFrame, members: DataFrame, n: int, rounds: int, eligible: DataFrame, uid: str
) -> DataFrame:
    """``(round, member, member_uid, uid)``: member i takes subset (i + round) mod n.

    Each id belongs to one subset and thus to one member per round, so the rows
    come from exploding rounds; no member meets an id it does not get.
    """
    by_round = parts.join(eligible.select(uid), uid, "left_semi").select(
        uid,
        "subset",
        F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"),
    )
    placed = by_round.withColumn("member", F.pmod(F.col("subset") - F.col("round"), F.lit(n)))
    who = members.select("member", F.col("uid").alias("member_uid"))
    return placed.join(who, "member").select("round", "member", "member_uid", uid)


def epoch_phase(df: DataFrame, seconds: str) -> DataFrame:
    """Adds ``epoch_start``, ``phase`` (sync, round, cooldown) and ``round`` (or null)."""
    t = F.col(seconds)
    start = t - F.pmod(t, F.lit(C.EPOCH_SECONDS))
    elapsed = t - start
    index = F.floor((elapsed - C.SYNC_SECONDS) / C.ROUND_SECONDS)
    in_sync = elapsed < C.SYNC_SECONDS
    running = ~in_sync & (index < C.ROUNDS_PER_EPOCH)
    return df.withColumns(
        {
            "epoch_start": start,
            "phase": F.when(in_sync, "sync").when(running, "round").otherwise("cooldown"),
            "round": F.when(running, index),
        }
    )


def audit_partition(parts: DataFrame, ids: DataFrame, uid: str) -> DataFrame:
    """One row: is the allocation disjoint, complete and balanced?"""
    times = parts.groupBy(uid).agg(F.count(F.lit(1)).alias("_n"))
    seen = ids.select(uid).join(times, uid, "left").agg(
        (F.max(F.coalesce("_n", F.lit(0))) <= 1).alias("disjoint"),
        (F.min(F.coalesce("_n", F.lit(0))) >= 1).alias("complete"),
    )
    sizes = parts.groupBy("subset").agg(F.count(F.lit(1)).alias("_s"))
    spread = sizes.agg(
        F.count(F.lit(1)).alias("subsets"), (F.max("_s") - F.min("_s")).alias("size_gap")
    )
    return seen.withColumn("_one", F.lit(1)).join(spread.withColumn("_one", F.lit(1)), "_one").select(
        "disjoint", "complete", (F.col("size_gap") <= 1).alias("balanced"), "subsets"
    )
