"""Queries over submissions: gates, per-submission scalars and composite scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from contest_analytics import config as C
from contest_analytics.functions import curves
from contest_analytics.functions.curves import rounded
from contest_analytics.operators import composite as comp
from contest_analytics.operators import gates
from contest_analytics.plans.adapters import oracle, table, view
from contest_analytics.plans.registry import query
from contest_analytics.scale import spread

KEY = ["request", "line"]
# Order line numbers repeat in the test tables; these columns are unique together.
UNIQUE = ["request", "line", "part", "contributor", "requested"]

DURATION_SQL = """case when requested <= 0 then 1e0
  when abs(actual - requested) / requested <= 0.2::double then 1e0
  when abs(actual - requested) / requested >= 0.5::double then 0e0
  else 1e0 - (abs(actual - requested) / requested - 0.2::double) / (0.5::double - 0.2::double) end"""


def _clip(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"


@query(
    "duration_penalty",
    oracle(f"select request, line, round({DURATION_SQL}, 6) as penalty from v_submissions"),
)
def _(spark, d):
    return view(spark, d, "v_submissions").select(
        *KEY, rounded(gates.duration_penalty("actual", "requested")).alias("penalty")
    )


@query(
    "speed_score",
    oracle("""select request, line, round(case when r <= 1 then 1e0 when r >= 6 then 0e0
      when r <= 3 then 1e0 - 7e-1 * (r - 1) / 2e0 else 3e-1 * (1e0 - (r - 3) / 3e0) end, 6) as speed
      from (select request, line, elapsed / greatest(requested, 1e0) as r from v_submissions)"""),
)
def _(spark, d):
    return view(spark, d, "v_submissions").select(
        *KEY, rounded(gates.speed_score("elapsed", "requested")).alias("speed")
    )


@query(
    "silence_gate",
    oracle("""select request, line, case when rms < 1e-2 then 0e0 else clap end as gated_score
      from v_submissions"""),
)
def _(spark, d):
    s = view(spark, d, "v_submissions")
    return gates.silence_gate(s, "rms", "clap").select(*KEY, "gated_score")


@query(
    "timeout_gate",
    oracle("""select request, line, coalesce(m > 300, r > 300000, false) as timed_out from (
      select request, line, case when part % 3 = 0 then null else elapsed end as m,
        case when part % 6 = 0 then null else elapsed * 1200 end as r from v_submissions)"""),
)
def _(spark, d):
    s = view(spark, d, "v_submissions").withColumns(
        {
            "measured_s": F.when(F.col("part") % 3 != 0, F.col("elapsed")),
            "reported_ms": F.when(F.col("part") % 6 != 0, F.col("elapsed") * 1200),
        }
    )
    return gates.timeout_gate(s).select(*KEY, "timed_out")


@query(
    "quality_gate",
    oracle("""select request, line, case when size < 1024 then 'too_small'
      when rms < 1e-3 then 'silent'
      when actual < requested * 5e-1 or actual > requested * 15e-1 then 'duration'
      when peak > 99e-2 then 'clipping' end as failed_check from v_submissions"""),
)
def _(spark, d):
    s = view(spark, d, "v_submissions")
    return gates.quality_gate(s, expected="requested").select(*KEY, "failed_check")


@query(
    "decode_payload",
    oracle("""select id, case when id % 4 = 0 then null when id % 4 = 1 then null
      else octet_length(encode(text)) end as bytes,
      case when id % 4 <= 1 then null else sha256(text) end as digest from v_text"""),
)
def _(spark, d):
    t = view(spark, d, "v_text")
    sent = F.when(F.col("id") % 4 == 1, F.concat(F.lit("*"), F.base64(F.encode("text", "utf-8"))))
    sent = sent.when(F.col("id") % 4 > 1, F.base64(F.encode("text", "utf-8")))
    got = gates.decode_payload("_sent")
    return t.withColumn("_sent", sent).select(
        "id", F.octet_length(got).cast("long").alias("bytes"), F.sha2(got, 256).alias("digest")
    )


@query(
    "payload_gate",
    oracle("""select contributor, batch, seq, case when seq % 5 = 0 then 'undecodable'
      when seq % 5 = 1 then 'too_long' when seq % 5 = 2 then 'not_finite' end as reject_reason
      from v_vectors"""),
)
def _(spark, d):
    v = view(spark, d, "v_vectors").withColumns(
        {
            "payload": F.when(F.col("seq") % 5 != 0, F.encode(F.lit("x"), "utf-8")),
            "seconds": F.when(F.col("seq") % 5 == 1, 200.0).otherwise(100.0),
            "samples": F.when(
                F.col("seq") % 5 == 2, F.concat("vec", F.array(F.lit(float("nan"))))
            ).otherwise(F.col("vec")),
        }
    )
    return gates.payload_gate(v).select("contributor", "batch", "seq", "reject_reason")


@query(
    "payload_sizes",
    oracle("""select seq, case when seq % 250 = 3 then 'too_large' when seq % 250 = 7 then 'too_long' end as reject_reason from v_vectors"""),
)
def _(spark, d):
    """Payloads one byte beyond the limit, and exactly at it."""
    over, full = (F.encode(F.repeat(F.lit("x"), C.MAX_PAYLOAD_BYTES + n), "utf-8") for n in (1, 0))
    v = view(spark, d, "v_vectors").withColumns(
        {
            "payload": F.when(F.col("seq") % 250 == 3, over).when(F.col("seq") % 250 == 7, full).otherwise(F.encode(F.lit("x"), "utf-8")),
            "seconds": F.when(F.col("seq") % 250 == 7, C.MAX_SECONDS + 0.5).otherwise(C.MAX_SECONDS * 1.0),
            "samples": F.col("vec"),
        }
    )
    return gates.payload_gate(v).select("seq", "reject_reason")


@query(
    "sanitize_score",
    oracle("""select event_id, case when event_id % 10 in (0, 2) then 0e0
      when event_id % 10 = 1 then 1e0 else greatest(0e0, least(1e0, value / 4e2)) end as score
      from v_scores"""),
)
def _(spark, d):
    m = F.col("event_id") % 10
    raw = (
        F.when(m == 0, float("nan"))
        .when(m == 1, float("inf"))
        .when(m == 2, float("-inf"))
        .otherwise(F.col("value") / 400)
    )
    return view(spark, d, "v_scores").select("event_id", curves.sanitize_score(raw).alias("score"))


@query(
    "response_curves",
    oracle(f"""select request, line, round(exp(-25e0 * (x - 6e-1) * (x - 6e-1)), 6) as bell,
      round({_clip("1e0 - abs(x - 5e-1) / 3e-1")}, 6) as tent,
      round(case when x <= 5e-2 then 1e0 when x >= 4e-1 then 0e0
        else 1e0 - (x - 5e-2) / (4e-1 - 5e-2) end, 6) as ramp,
      round({_clip("(x - 5e-2) / (55e-2 - 5e-2)")}, 6) as remap,
      round(1e0 / (1e0 + exp(-(x - 5e-1) * 8e0)), 6) as logistic
      from (select request, line, clap as x from v_submissions)"""),
)
def _(spark, d):
    x = "clap"
    return view(spark, d, "v_submissions").select(
        *KEY,
        rounded(curves.bell(x, 0.6, 25.0)).alias("bell"),
        rounded(curves.tent(x, 0.5, 0.3)).alias("tent"),
        rounded(curves.ramp(x, 0.05, 0.4)).alias("ramp"),
        rounded(curves.remap(x, 0.05, 0.55)).alias("remap"),
        rounded(curves.logistic(x, 0.5, 8.0)).alias("logistic"),
    )


def turn_pairs(spark, d):
    """User turns with the assistant turn that follows."""
    t = view(spark, d, "v_turns")
    user = t.filter("role = 'user'").select(
        "conv_id", "turn", F.col("words").alias("ref"), (F.col("turn") + 1).alias("_next")
    )
    reply = t.filter("role = 'assistant'").select(
        "conv_id", F.col("turn").alias("_next"), F.col("words").alias("hyp")
    )
    return user.join(reply, ["conv_id", "_next"]).drop("_next")


WORDS_OF = "list_filter(string_split_regex(lower({0}), '\\s+'), lambda w: w <> '')"


@query(
    "word_error_rate",
    # One row of the table for each reference word, filled in from left to right.
    oracle(
        """select conv_id, turn, round(case when len(r) = 0 then least(len(h), 1)::double else list_reduce(
          list_prepend(range(0, len(h) + 1), [[x] for x in r]), lambda row, w: list_reduce(
            list_prepend([row[1] + 1], [[j] for j in range(1, len(h) + 1)]), lambda done, j:
              list_append(done, least(row[j[1] + 1] + 1, done[-1] + 1, row[j[1]] + (h[j[1]] <> w[1])::int))))[-1]
          / len(r)::double end, 6) as wer from h_coded""",
        h_coded="""select conv_id, turn, [list_position(known, w)::bigint for w in r] as r, [list_position(known, w)::bigint for w in h] as h
          from (select *, list_distinct(r || h) as known from h_words)""",
        h_words=f"select conv_id, turn, {WORDS_OF.format('ref')} as r, {WORDS_OF.format('hyp')} as h from h_pairs",
        h_pairs="""select u.conv_id, u.turn, u.words as ref, a.words as hyp from v_turns u
          join v_turns a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'""",
    ),
)
def _(spark, d):
    return gates.word_error_rate(spread(turn_pairs(spark, d))).select(
        "conv_id", "turn", rounded("wer").alias("wer")
    )


@query(
    "text_intelligibility",
    oracle(f"""select id, round(case when trim(text) = '' then 3e-1 else {_clip(
        "case when w is null then b else 5e-1 * greatest(0e0, least(1e0, 1e0 - w)) + 5e-1 * b end"
      )} end, 6) as intelligibility from (
        select id, text, w, 35e-2 * {_clip("n / 40e0")} + 4e-1 * {_clip("c / 6e-1")}
          + 25e-2 * exp(-2e0 * (n / s - 2e0) * (n / s - 2e0)) as b from (
          select id, text, len(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) as n,
            n_chars / 12e0 + 1e0 as s, (exp(-((id % 7) / 1e1)) * (1e0 - (id % 3) / 1e1)
              + exp(-((id % 5) / 1e1)) * 5e-1) / 2e0 as c,
            case when id % 2 = 0 then (id % 13) / 1e1 end as w from v_text))"""),
)
def _(spark, d):
    t = view(spark, d, "v_text")
    i = F.col("id")
    conf = gates.segment_confidence(
        F.array(-(i % 7) / 10, -(i % 5) / 10), F.array((i % 3) / 10, F.lit(0.5))
    )
    t = t.withColumns(
        {
            "seconds": F.col("n_chars") / 12 + 1,
            "confidence": conf,
            "wer": F.when(i % 2 == 0, (i % 13) / 10),
        }
    )
    return gates.text_intelligibility(t).select(
        "id", rounded("intelligibility").alias("intelligibility")
    )


@query(
    "clean_lines",
    oracle("""select id, coalesce(string_agg(case when p <= coalesce(cut, 1000000000) and bare <> ''
        then bare end, '|' order by p), '') as lines from (
        select *, min(case when not marker and kept >= 8 then p end) over (partition by id) as cut from (
          select *, sum(case when bare <> '' then 1 else 0 end)
              over (partition by id order by p) as kept from (
            select id, p, marker, case when marker then x
              else regexp_replace(x, '^[0-9.)\\-*]+\\s*', '') end as bare from (
              select id, p, x, starts_with(x, '[') and ends_with(x, ']') as marker from (
                select id, trim(unnest(parts), ' ') as x, unnest(range(1, len(parts) + 1)) as p
                from (select id, string_split(text, chr(10)) as parts from v_text))
              where length(x) between 2 and 100)
            where marker or not (contains(lower(x), 'written by') or contains(lower(x), 'copyright')
              or contains(lower(x), 'here are') or contains(lower(x), 'here''s')
              or contains(lower(x), 'sure,') or contains(lower(x), 'of course')
              or contains(lower(x), 'certainly')))))
      group by id
      union all select id, '' from v_text where id not in (select id from (
        select id, trim(unnest(string_split(text, chr(10))), ' ') as x from v_text)
        where length(x) between 2 and 100 and ((starts_with(x, '[') and ends_with(x, ']')) or not (
          contains(lower(x), 'written by') or contains(lower(x), 'copyright')
          or contains(lower(x), 'here are') or contains(lower(x), 'here''s')
          or contains(lower(x), 'sure,') or contains(lower(x), 'of course')
          or contains(lower(x), 'certainly'))))"""),
)
def _(spark, d):
    t = gates.clean_lines(spread(view(spark, d, "v_text")), "text", 8)
    return t.select("id", F.array_join("lines", "|").alias("lines"))


@query(
    "conditional_gate",
    oracle("""select request, line, case when peak < 1e-6 or actual < 1 then
        (case when vocals then 1e-1 else 5e-1 end)
      when not vocals then (case when artifact_penalty > 4e-1 then 0e0 else 5e-1 end)
      else vocal end as vocal,
      case when peak < 1e-6 or actual < 1 then (case when vocals then 1e-1 else 5e-1 end)
      when not vocals then (case when artifact_penalty > 4e-1 then 0e0 else 5e-1 end)
      else vocal_lyrics end as vocal_lyrics from v_submissions"""),
)
def _(spark, d):
    s = view(spark, d, "v_submissions")
    return gates.conditional_gate(
        s,
        ["vocal", "vocal_lyrics"],
        requested="vocals",
        presence="artifact_penalty",
        seconds="actual",
    ).select(*KEY, "vocal", "vocal_lyrics")


# --- composite scores -------------------------------------------------------

SUM_SQL = " + ".join(f"{s} * {w}::double" for s, w in C.SIGNAL_WEIGHTS.items())


@query(
    "composite_score",
    oracle(f"select request, line, round({SUM_SQL}, 6) as composite from v_submissions"),
)
def _(spark, d):
    out = comp.composite(view(spark, d, "v_submissions"), C.SIGNAL_WEIGHTS)
    return out.select(*KEY, rounded("composite").alias("composite"))


PREFERENCE_SQL = """case when bootstrap then 0e0 when accuracy is null then 2e-2
  else 2e-2 + pow((least(75e-2, greatest(55e-2, accuracy)) - 55e-2)
    / (75e-2 - 55e-2 + 1e-8), 2) * 18e-2 end"""


@query(
    "preference_weight",
    oracle(f"select request, line, round({PREFERENCE_SQL}, 6) as weight from v_submissions"),
)
def _(spark, d):
    return view(spark, d, "v_submissions").select(
        *KEY, rounded(comp.preference_weight("accuracy", "bootstrap")).alias("weight")
    )


def _multiplier_sql(signal: str) -> str:
    a, b = C.SHORT_MULTIPLIERS.get(signal, 1.0), C.LONG_MULTIPLIERS.get(signal, 1.0)
    return (
        f"greatest(5e-1, least(2e0, case when requested < 10 then {a}::double"
        f" when requested < 30 then {a}::double + (requested - 10) / 20e0 * ({b}::double - {a}::double)"
        f" else {b}::double end))"
    )


@query(
    "duration_multipliers",
    oracle(
        "select request, line, "
        + ", ".join(
            f"round({_multiplier_sql(s)}, 6) as {s}" for s in ("structural", "melody", "speed", "clap")
        )
        + " from v_submissions"
    ),
)
def _(spark, d):
    s = comp.duration_multipliers(view(spark, d, "v_submissions").drop(*C.SIGNALS), "requested")
    return s.select(
        *KEY,
        *[rounded(F.col("multipliers")[c]).alias(c) for c in ("structural", "melody", "speed", "clap")],
    )


WEIGHTS_SQL = ", ".join(
    f"""({PREFERENCE_SQL if s == "preference" else f"{w}::double"})"""
    + (f" * (case when vocals then {C.REQUESTED_BOOST[s]}::double else 1e0 end)" if s in C.REQUESTED_BOOST else "")
    + f" * {_multiplier_sql(s)} as w_{s}"
    for s, w in C.SIGNAL_WEIGHTS.items()
)
W_TOTAL = "(" + " + ".join(f"w_{s}" for s in C.SIGNALS) + ")"


@query(
    "boost_and_renormalize",
    oracle(
        "select request, line, part, contributor, requested, signal, round(weight / sum(weight) over (partition by request, line, part, contributor, requested), 6)"
        " as weight from ("
        + " union all ".join(
            f"select request, line, part, contributor, requested, '{s}' as signal, {w}::double"
            + (f" * case when vocals then {C.REQUESTED_BOOST[s]}::double else 1e0 end" if s in C.REQUESTED_BOOST else "")
            + " as weight from v_submissions"
            for s, w in C.SIGNAL_WEIGHTS.items()
        )
        + ")"
    ),
)
def _(spark, d):
    # Dealt by submission (its whole-number keys) before there is a row for each signal: no such row is shuffled.
    s = view(spark, d, "v_submissions").select(*UNIQUE, "vocals").repartition(*UNIQUE[:4]).select(
        *UNIQUE,
        "vocals",
        F.explode(F.create_map(*[F.lit(x) for kv in C.SIGNAL_WEIGHTS.items() for x in kv])).alias(
            "signal", "weight"
        ),
    )
    out = comp.boost_and_renormalize(s, C.REQUESTED_BOOST, UNIQUE, flag="vocals")
    return out.select(*UNIQUE, "signal", rounded("weight").alias("weight"))


def scored_submissions(spark, d):
    """Full reward of every submission: gates, weights, penalties."""
    s = view(spark, d, "v_submissions")
    s = s.withColumns(
        {
            "composite": comp.adjusted_composite(requested="vocals", duration="requested"),
            "duration_penalty": gates.duration_penalty("actual", "requested"),
            "gated": gates.is_silent("rms") | gates.timed_out("elapsed", F.lit(None).cast("double")),
        }
    )
    return comp.final_reward(s, bonuses=(), gated="gated")


FINAL_SQL = f"""select request, line, contributor, round(case when rms < 1e-2 or elapsed > 300 then 0e0 else
  {_clip("composite * duration_penalty * artifact_penalty * fad_penalty * fingerprint_penalty")} end, 6)
  as final_reward from (
    select *, ({" + ".join(f"{s} * w_{s}" for s in C.SIGNALS)}) / {W_TOTAL} as composite,
      {DURATION_SQL} as duration_penalty from (select *, {WEIGHTS_SQL} from v_submissions))"""


@query("final_reward", oracle(FINAL_SQL))
def _(spark, d):
    return scored_submissions(spark, d).select(
        *KEY, "contributor", rounded("final_reward").alias("final_reward")
    )


@query(
    "light_composite",
    oracle(f"""select request, line, round({_clip(
        "(" + " + ".join(f"{s} * {w}::double" for s, w in C.LIGHT_WEIGHTS.items())
        + f") * ({DURATION_SQL}) * artifact_penalty")}, 6) as light_reward from v_submissions"""),
)
def _(spark, d):
    s = view(spark, d, "v_submissions").withColumn(
        "duration_penalty", gates.duration_penalty("actual", "requested")
    )
    return comp.light_composite(s).select(*KEY, rounded("light_reward").alias("light_reward"))


@query(
    "present_weighted_mean",
    oracle("""select request, line, round(case when t is null and k is null and i is null then 5e-1
      else (coalesce(t * 4e-1, 0) + coalesce(k * 3e-1, 0) + coalesce(i * 3e-1, 0))
        / (case when t is null then 0 else 4e-1 end + case when k is null then 0 else 3e-1 end
          + case when i is null then 0 else 3e-1 end) end, 6) as attribute from (
      select request, line, case when part % 2 = 0 then clap end as t,
        case when part % 3 = 0 then melody end as k, case when part % 5 = 0 then vocal end as i
      from v_submissions)"""),
)
def _(spark, d):
    s = view(spark, d, "v_submissions").select(
        *KEY,
        F.when(F.col("part") % 2 == 0, F.col("clap")).alias("tempo"),
        F.when(F.col("part") % 3 == 0, F.col("melody")).alias("key"),
        F.when(F.col("part") % 5 == 0, F.col("vocal")).alias("instruments"),
    )
    return s.select(*KEY, rounded(comp.present_weighted_mean(C.ATTRIBUTE_WEIGHTS)).alias("attribute"))


@query(
    "breakdown_long",
    oracle(
        " union all ".join(
            f"select request, line, '{s}' as signal, {s} as score, {w}::double as weight,"
            f" round({s} * {w}::double, 6) as contribution from v_submissions"
            for s, w in C.SIGNAL_WEIGHTS.items()
        )
    ),
)
def _(spark, d):
    out = comp.breakdown_long(view(spark, d, "v_submissions"), KEY)
    return out.withColumn("contribution", rounded("contribution"))


@query(
    "breakdown_wide",
    oracle("select request, line, part, contributor, requested, clap, melody, speed from v_submissions"),
)
def _(spark, d):
    three = {s: C.SIGNAL_WEIGHTS[s] for s in ("clap", "melody", "speed")}
    long = comp.breakdown_long(view(spark, d, "v_submissions"), UNIQUE, three)
    return comp.breakdown_wide(long, UNIQUE, list(three))


@query(
    "geo_mean_penalty",
    oracle("""select request, line, round(exp((ln(greatest(artifact_penalty, 0.1::double))
      + ln(greatest(clap, 0.1::double)) + ln(greatest(melody, 0.1::double))
      + ln(greatest(fad_penalty, 0.1::double))) / 4e0), 6) as penalty from v_submissions"""),
)
def _(spark, d):
    cols = ["artifact_penalty", "clap", "melody", "fad_penalty"]
    return view(spark, d, "v_submissions").select(
        *KEY, rounded(comp.geo_mean_penalty(cols)).alias("penalty")
    )


@query(
    "round_summary",
    oracle("""select request as challenge, count(*) as n,
      round(avg(coalesce(s, 0)), 6) as mean_score, max(coalesce(s, 0)) as max_score from (
        select request, case when part % 9 = 0 then null else clap end as s from v_submissions)
      group by request"""),
)
def _(spark, d):
    s = view(spark, d, "v_submissions").select(
        F.col("request").alias("challenge"),
        F.when(F.col("part") % 9 != 0, F.col("clap")).alias("score"),
    )
    return comp.round_summary(s).withColumn("mean_score", rounded("mean_score"))


_METRICS = [
    ("quality", "harmonic_ratio", "clap"),
    ("quality", "onset_quality", "attribute"),
    ("quality", "dynamic_range", "melody"),
    ("harmonic", "vocal_presence", "vocal"),
    ("harmonic", "vocal_clarity", "quality"),
    ("stereo", "stereo_width", "production"),
]


@query(
    "aggregate_submetrics",
    oracle(f"""select request, line, part, contributor, requested, 'quality' as family, round({_clip(
        "clap * 25e-2 + attribute * 2e-1 + melody * 15e-2")}, 6) as score from v_submissions
      union all select request, line, part, contributor, requested, 'harmonic', round({_clip(
        "vocal * 35e-2 + quality * 3e-1 + 5e-1 * (1e0 - 65e-2)")}, 6) from v_submissions
      union all select request, line, part, contributor, requested, 'stereo', round({_clip("production * 3e-1")}, 6) from v_submissions"""),
)
def _(spark, d):
    s = view(spark, d, "v_submissions")
    rows = F.array(
        *[
            F.struct(F.lit(f).alias("family"), F.lit(m).alias("metric"), F.col(c).alias("value"))
            for f, m, c in _METRICS
        ]
    )
    long = s.select(*UNIQUE, F.explode(rows).alias("r")).select(*UNIQUE, "r.*")
    out = comp.aggregate_submetrics(long, UNIQUE)
    return out.withColumn("score", rounded("score"))


@query(
    "request_validation",
    oracle("""select id, len(list_filter([case when tempo not between 20 and 300 then 'tempo' end,
        case when duration not between 1 and 180 then 'duration' end,
        case when size % 7 = 0 then 'prompt' end,
        case when size % 10 not between 1 and 5 then 'variations' end,
        case when size % 4 = 3 then 'format' end], lambda r: r is not null)) = 0 as valid,
      array_to_string(list_filter([case when tempo not between 20 and 300 then 'tempo' end,
        case when duration not between 1 and 180 then 'duration' end,
        case when size % 7 = 0 then 'prompt' end,
        case when size % 10 not between 1 and 5 then 'variations' end,
        case when size % 4 = 3 then 'format' end], lambda r: r is not null), ',') as reasons from v_levels"""),
)
def _(spark, d):
    from contest_analytics.sources.tables import validate_requests

    size = F.col("size")
    r = view(spark, d, "v_levels").select(
        "id",
        F.col("tempo").alias("tempo_bpm"),
        F.col("duration").alias("duration_seconds"),
        F.when(size % 7 != 0, F.col("name")).otherwise("").alias("prompt"),
        (size % 10).alias("num_variations"),
        F.get(F.array(*map(F.lit, ["wav", "mp3", "ogg", "aiff"])), size % 4).alias("format"),
        F.lit(None).cast("string").alias("lyrics"),
    )
    return validate_requests(r).select("id", "valid", F.array_join("reasons", ",").alias("reasons"))


@query(
    "explode_responses",
    oracle("""select o.o_orderkey as request, l.l_linenumber as line, l.l_suppkey as contributor
      from orders o left join lineitem l on l.l_orderkey = o.o_orderkey"""),
)
def _(spark, d):
    from contest_analytics.sources.tables import explode_responses

    # The nested round table: one row per order with its responses as an array.
    responses = (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("request"))
        .agg(F.collect_list(F.struct("l_linenumber", "l_suppkey")).alias("responses"))
    )
    rounds = (
        table(spark, d, "orders")
        .select(F.col("o_orderkey").alias("request"))
        .join(responses, "request", "left")
    )
    return explode_responses(rounds).select(
        "request",
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("contributor"),
    )
