"""Queries for lookups, text rules, registries and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from contest_analytics import config as C
from contest_analytics.functions.curves import rounded
from contest_analytics.operators import lookups as lk
from contest_analytics.plans.adapters import oracle, table, view
from contest_analytics.plans.registry import query
from contest_analytics.scale import spread
from contest_analytics.sources import tables as src

# The test tables hold no music words: give each kind of part a genre to look up.
GENRE_OF = {"ECONOMY": " Rock", "STANDARD": "ambient", "PROMO": "R&B ", "SMALL": "jazz", "MEDIUM": "none"}


def genre_column():
    t = F.create_map(*[F.lit(x) for kv in GENRE_OF.items() for x in kv])
    return t[F.col("tag")]


GENRE_SQL = "case tag " + " ".join(f"when '{t}' then '{g}'" for t, g in GENRE_OF.items()) + " end"
PROFILE_SQL = """case tag when 'ECONOMY' then {0} when 'STANDARD' then {1} when 'PROMO' then {2}
  when 'SMALL' then {3} else {4} end"""


def _profile(i: int) -> str:
    fams = ["rock", "ambient", "groove-soul", "jazz-blues", "default"]
    return PROFILE_SQL.format(*[f"{C.PROFILES[f][i]}::double" for f in fams])


@query(
    "with_profile",
    oracle(f"""select id, {PROFILE_SQL.format("'rock'", "'ambient'", "'groove-soul'", "'jazz-blues'", "'default'")} as family,
      {_profile(0)} as dynamic_range_target, {_profile(8)} as lufs_target from v_levels"""),
)
def _(spark, d):
    v = view(spark, d, "v_levels").select(
        "id", F.coalesce(genre_column(), F.lit("")).alias("genre")
    )
    return lk.with_profile(v, "genre", lk.profile_table(spark)).select(
        "id", "family", "dynamic_range_target", "lufs_target"
    )


@query(
    "family_members",
    # The dimension: the genres of the table's own parts, each with its family.
    oracle(f"""select family, array_to_string(list_sort(list(distinct genre)), ',') as members from (
      select {PROFILE_SQL.format("'rock'", "'ambient'", "'groove-soul'", "'jazz-blues'", "'default'")} as family,
        coalesce(genre, '') as genre from (select {GENRE_SQL} as genre, tag from v_levels)) group by family"""),
)
def _(spark, d):
    genre = F.coalesce(genre_column(), F.lit("")).alias("genre")
    seen = view(spark, d, "v_levels").select(genre).distinct()
    mapped = lk.with_profile(seen, "genre", lk.profile_table(spark))
    out = lk.family_members(mapped, "family", "genre")
    return out.select("family", F.array_join("members", ",").alias("members"))


# Rules made of words that do occur in the documents.
TEXT_RULES = [
    (["the", "and"], C.TARGET_RULES[0][1]),
    (["les", "que", "with"], C.TARGET_RULES[1][1]),
    (["der", "und", "die"], C.TARGET_RULES[2][1]),
    (["in the", "of"], C.TARGET_RULES[5][1]),
]


def _targets_sql() -> str:
    hits = [
        f"regexp_matches(whole, '(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])(?:{"|".join(words)})($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])')"
        for words, _ in TEXT_RULES
    ]
    out = {}
    for f, start in C.TARGET_DEFAULTS.items():
        v = f"{start}::double"
        for h, (_, deltas) in zip(range(len(hits)), TEXT_RULES):
            if f in deltas:
                v += f" + case when h{h} then {deltas[f]}::double else 0e0 end"
        if f == "section_variety_target":
            v += " + case when dur > 30 then 5e-2 when dur < 5 then -1e-1 else 0e0 end"
        if f == "harmonic_progression_min":
            v += " + case when dur > 30 then 5e-1 when dur < 5 then -5e-1 else 0e0 end"
        lo, hi = C.TARGET_BOUNDS[f]
        out[f] = f"greatest({lo}::double, least({hi}::double, {v}))"
    cols = ", ".join(f"{v} as {f}" for f, v in out.items())
    flags = ", ".join(f"{h} as h{i}" for i, h in enumerate(hits))
    final = ", ".join(
        (
            f"round(case when whole = '' then {C.TARGET_DEFAULTS[f]}::double when onset_density_min > onset_density_max"
            f" then (onset_density_min + onset_density_max) / 2e0 else {f} end, 6) as {f}"
            if f.startswith("onset_density")
            else f"round(case when whole = '' then {C.TARGET_DEFAULTS[f]}::double else {f} end, 6) as {f}"
        )
        for f in out
    )
    return f"""select id, {final} from (select id, whole, {cols} from (select *, {flags} from (
      select id, trim(concat(text, ' ', tag), ' ') as whole, (id % 45) * 1e0 as dur from v_text)))"""


@query("derive_targets", oracle(_targets_sql()))
def _(spark, d):
    t = spread(view(spark, d, "v_text")).withColumn("duration", (F.col("id") % 45).cast("double"))
    out = lk.derive_targets(t, rules=TEXT_RULES)
    return out.select("id", *[rounded(f).alias(f) for f in C.TARGET_DEFAULTS])


def _tag_sql(keywords, name: str) -> str:
    hits = " ".join(
        "when " + " or ".join(f"contains(t, '{w}')" for w in words) + f" then '{tag}'" for tag, words in keywords.items()
    )
    return f"case {hits} end as {name}"


@query(
    "extract_tag",
    oracle(f"""select id, {_tag_sql(C.GENRE_KEYWORDS, "genre")}, {_tag_sql(C.MOOD_KEYWORDS, "mood")}
      from (select id, lower(text) as t from v_text)"""),
)
def _(spark, d):
    genres = lk.extract_tag(view(spark, d, "v_text"), "text").withColumnRenamed("found_tag", "genre")
    return lk.extract_tag(genres, "text", C.MOOD_KEYWORDS).select("id", "genre", F.col("found_tag").alias("mood"))


def _curve_sql() -> str:
    cols = []
    for i, f in enumerate(C.CURVE_FIELDS):
        parts = [
            f"when x <= {hi}::double then {a[i]}::double + (x - {lo}::double) / ({hi}::double - {lo}::double)"
            f" * ({b[i]}::double - {a[i]}::double)"
            for (lo, a), (hi, b) in zip(C.CURVE, C.CURVE[1:])
        ]
        cols.append(f"round(case {' '.join(parts)} else {C.CURVE[-1][1][i]}::double end, 6) as {f}")
    return f"select id, {', '.join(cols)} from v_levels"


@query("interpolate_curve", oracle(_curve_sql()))
def _(spark, d):
    out = lk.interpolate_curve(view(spark, d, "v_levels"), "x")
    return out.select("id", *[rounded(f).alias(f) for f in C.CURVE_FIELDS])


def _tier_rows(tiers) -> str:
    return ", ".join(f"({i}, {t}::double, '{n}')" for i, (t, n) in enumerate(tiers))


@query(
    "nearest_tier",
    oracle(f"""select id, min(tier) as tier, min(complexity) as complexity from (
      select id, arg_min(n, struct_pack(d := round(abs(x - t), 12), i := i)) as tier, null as complexity
        from v_levels, (values {_tier_rows(C.ATTRIBUTE_TIERS)}) as tiers(i, t, n) group by id
      union all select id, null, arg_min(n, struct_pack(d := round(abs(x - t), 12), i := i))
        from v_levels, (values {_tier_rows(C.COMPLEXITY_TIERS)}) as tiers(i, t, n) group by id) group by id"""),
)
def _(spark, d):
    return view(spark, d, "v_levels").select(
        "id", lk.nearest_tier("x", C.ATTRIBUTE_TIERS).alias("tier"), lk.nearest_tier("x").alias("complexity")
    )


@query(
    "match_identity",
    oracle("""select event_id, contributor, raw as score from v_scores join v_nodes on uid = contributor
      where event_id % 4 = 0 or (event_id % 4 <> 1 and event_id % 3 <> 0)"""),
)
def _(spark, d):
    nodes = view(spark, d, "v_nodes")
    v = view(spark, d, "v_scores").select(
        "event_id",
        F.col("contributor").alias("uid"),
        F.col("raw").alias("score"),
        F.when(F.col("event_id") % 4 == 0, "")
        .when((F.col("event_id") % 4 == 1) | (F.col("event_id") % 3 == 0), "someone else")
        .otherwise(F.format_string("Supplier#%09d", "contributor"))
        .alias("hotkey"),
    )
    return lk.match_identity(v, nodes).select(
        "event_id", F.col("uid").alias("contributor"), "score"
    )


@query(
    "allowed_callers",
    oracle("""select request, line, part from v_submissions where contributor in (
      select uid from v_nodes where permit and stake >= 5000)"""),
)
def _(spark, d):
    nodes = view(spark, d, "v_nodes").withColumnRenamed("uid", "contributor")
    out = lk.allowed_callers(view(spark, d, "v_submissions"), nodes, 5000.0, "contributor")
    return out.select("request", "line", "part")


@query(
    "request_priority",
    oracle("""select event_id, case when event_id % 6 = 0 then x when uid is null then 0e0
      else stake + x end as priority from (
        select event_id, contributor, case when contest = 'purchase' then 1e6 else 0e0 end as x
        from v_scores) left join v_nodes on uid = contributor"""),
)
def _(spark, d):
    v = view(spark, d, "v_scores").select(
        "event_id",
        F.when(F.col("event_id") % 6 != 0, F.format_string("Supplier#%09d", "contributor")).alias(
            "hotkey"
        ),
        (F.col("contest") == "purchase").alias("organic"),
    )
    return lk.request_priority(v, view(spark, d, "v_nodes")).select("event_id", "priority")


NOTE_LIST = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"


@query(
    "key_match",
    oracle(f"""select id, case when a = b and am = bm then 1e0
        when a = (b + case when bm then 3 else 9 end) % 12 and am <> bm then 8e-1
        when least(abs(fa - fb), 12 - abs(fa - fb)) = 1 then 5e-1
        when least(abs(fa - fb), 12 - abs(fa - fb)) = 2 then 3e-1 else 0e0 end as key_score
      from (select *, (a * 7) % 12 as fa, (b * 7) % 12 as fb from (
        select id, id % 12 as a, size % 12 as b, id % 5 < 2 as am, size % 3 = 0 as bm from v_levels))"""),
)
def _(spark, d):
    notes = F.array(*map(F.lit, C.NOTES))
    i, s = F.col("id"), F.col("size")
    mode = lambda minor: F.when(minor, " minor").otherwise(" major")
    v = view(spark, d, "v_levels").select(
        "id",
        F.concat(F.get(notes, (i % 12).cast("int")), mode(i % 5 < 2)).alias("detected"),
        F.concat(F.lower(F.get(notes, (s % 12).cast("int"))), mode(s % 3 == 0)).alias("requested"),
    )
    return lk.key_match(v, "detected", "requested").select("id", "key_score")


@query(
    "tempo_match",
    oracle("""select id, round(case when d <= 0 or r <= 0 then 5e-1 when o <= 1e-1 * r then 1e0
      else greatest(0e0, least(1e0, 1e0 - (o - 1e-1 * r) / (5e-1 * r - 1e-1 * r))) end, 6) as tempo_score
      from (select *, least(abs(d - r), abs(d / 2 - r), abs(d * 2 - r)) as o from (
        select id, (id % 200) * 1e0 as d, tempo * 1e0 as r from v_levels))"""),
)
def _(spark, d):
    v = view(spark, d, "v_levels")
    detected, requested = (F.col("id") % 200).cast("double"), F.col("tempo").cast("double")
    return v.select("id", rounded(lk.tempo_match(detected, requested)).alias("tempo_score"))


# --- sources ----------------------------------------------------------------


@query(
    "parse_annotations",
    oracle("""select 'good' as kind, contest as preferred, count(*) as n from v_scores
      where event_id % 10 > 1 group by contest
      union all select 'bad', null, count(*) from v_scores where event_id % 10 = 1"""),
)
def _(spark, d):
    # JSON lines made from the events; one in ten is cut off, one in ten is blank.
    whole = F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("pair_id"),
            F.col("contest").alias("preferred"),
            F.lit("2024-01-01T00:00:00").alias("timestamp"),
        )
    )
    m = F.col("event_id") % 10
    line = F.when(m == 0, " ").when(m == 1, F.left(whole, F.lit(12))).otherwise(whole)
    good, bad = src.parse_annotations(view(spark, d, "v_scores").select(line.alias("value")))
    count = F.count(F.lit(1)).alias("n")
    return (
        good.groupBy("preferred")
        .agg(count)
        .select(F.lit("good").alias("kind"), "preferred", "n")
        .unionByName(bad.agg(count).select(F.lit("bad").alias("kind"), F.lit(None).cast("string").alias("preferred"), "n"))
    )


@query(
    "path_to_key",
    oracle("""select page_id, concat(p[len(p) - 1], '/', regexp_replace(p[len(p)], '(.)\\.[^.]+$', '\\1')) as key
      from (select page_id, list_filter(string_split(url, '/'), lambda x: x <> '') as p from pages)"""),
)
def _(spark, d):
    return table(spark, d, "pages").select("page_id", src.path_to_key("url").alias("key"))


@query(
    "attach_metadata",
    oracle("""select l.l_orderkey as request, l.l_partkey as part, l.l_suppkey as contributor, l.l_linenumber as line,
      coalesce(nullif(a.m, ''), nullif(b.m, ''), '') as prompt, coalesce(nullif(a.g, ''), nullif(b.g, ''), '') as genre
      from lineitem l
      left join (select p_partkey as k, case when p_size % 3 = 0 then '' else p_name end as m, case when p_size % 2 = 0 then p_type else '' end as g from part) a on a.k = l.l_partkey
      left join (select p_partkey as k, case when p_size % 3 = 0 then '' else p_name end as m, case when p_size % 2 = 0 then p_type else '' end as g from part) b on b.k = l.l_suppkey"""),
)
def _(spark, d):
    meta = view(spark, d, "v_levels").select(
        F.col("id").alias("folder"),
        F.when(F.col("size") % 3 != 0, F.col("name")).otherwise("").alias("prompt"),
        F.when(F.col("size") % 2 == 0, F.col("tag")).otherwise("").alias("genre"),
    )
    pairs = view(spark, d, "v_submissions").select("request", "part", "contributor", "line")
    return src.attach_metadata(pairs, meta, "part", "contributor")


@query(
    "referenced_assets",
    oracle("""select distinct path from (select l_partkey as path from lineitem
      union all select l_suppkey from lineitem)"""),
)
def _(spark, d):
    s = view(spark, d, "v_submissions").select(
        F.col("part").cast("string").alias("a"), F.col("contributor").cast("string").alias("b")
    )
    return src.referenced_assets(s, "a", "b").select(F.col("path").cast("long").alias("path"))


@query(
    "cache_missing",
    oracle("""select seq as key, 'new' as state from v_vectors where seq % 3 <> 0 and seq % 7 <> 0
      union all select seq, 'failed' from v_vectors where seq % 3 <> 0 and seq % 7 = 0"""),
)
def _(spark, d):
    v = view(spark, d, "v_vectors").withColumn("key", F.col("seq"))
    cache = v.filter("seq % 3 = 0").select("key")

    def compute(todo):
        return todo.select("key", F.when(F.col("key") % 7 != 0, F.col("vec")).alias("vec"))

    new, failed = src.cache_missing(v, cache, compute)
    return new.select("key", F.lit("new").alias("state")).unionByName(
        failed.select("key", F.lit("failed").alias("state"))
    )


@query(
    "validate_state",
    oracle("""select reason, count(*) as n from (select case when event_id % 9 = 0 then 'version'
        when event_id % 9 = 1 then 'uid' when event_id % 9 = 2 and contributor > 0 then 'negative_uid'
        when event_id % 9 = 3 then 'ema' when value / 2e2 > 1 then 'ema_range' else 'ok' end as reason
      from v_scores) group by reason"""),
)
def _(spark, d):
    m = F.col("event_id") % 9
    uid = F.col("contributor")
    v = view(spark, d, "v_scores").select(
        F.when(m == 0, "999").otherwise("2").alias("version"),
        F.when(m == 1, "abc").when(m == 2, (-uid).cast("string")).otherwise(uid.cast("string")).alias("uid"),
        F.when(m == 3, "x").otherwise((F.col("value") / 200).cast("string")).alias("ema"),
        F.lit("5").alias("rounds"),
        F.col("hotkey"),
    )
    ok, rejected = src.validate_state(v)
    return (
        ok.select(F.lit("ok").alias("reason"))
        .unionByName(rejected.select("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "validate_lyrics",
    oracle("""select id, array_to_string(list_filter([case when length(text) not between 1 and 2000 then 'prompt' end,
      case when length(text) > 5000 then 'lyrics' end], lambda r: r is not null), ',') as reasons from v_text"""),
)
def _(spark, d):
    """Whole documents as prompts and lyrics: every length that the tables hold."""
    none = {c: F.lit(None).cast("double") for c in ("tempo_bpm", "duration_seconds", "num_variations")}
    v = view(spark, d, "v_text").select("id", F.col("text").alias("prompt"), F.col("text").alias("lyrics"))
    out = src.validate_requests(v.withColumns({**none, "format": F.lit("wav")}))
    return out.select("id", F.array_join("reasons", ",").alias("reasons"))
