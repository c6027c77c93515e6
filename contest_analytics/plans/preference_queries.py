"""Queries over pairs, annotations and votes, and over work allocation."""

from __future__ import annotations

from pyspark.sql import functions as F

from contest_analytics.functions.curves import rounded
from contest_analytics.operators import allocation as al
from contest_analytics.operators import preference as pf
from contest_analytics.plans.adapters import oracle, view
from contest_analytics.plans.registry import query

PAIRS = """select a.batch as challenge, a.seq as a, b.seq as b, substr(sha256(concat(
    least(cast(a.seq as varchar), cast(b.seq as varchar)), chr(10),
    greatest(cast(a.seq as varchar), cast(b.seq as varchar)))), 1, 12) as pair_id
  from v_vectors a join v_vectors b on a.batch = b.batch and a.seq < b.seq"""
ANNOTATED = """select *, case (a + b) % 3 when 0 then 'a' when 1 then 'b' else 'skip' end as preferred from h_pairs"""
PREF = {"h_pairs": PAIRS, "h_ann": ANNOTATED}


def pairs(spark, d):
    out = pf.make_pairs(view(spark, d, "v_vectors"), "batch", "seq")
    return out.withColumn("pair_id", pf.pair_id("a", "b"))


def annotations(spark, d):
    m = (F.col("a") + F.col("b")) % 3
    return pairs(spark, d).withColumn(
        "preferred", F.when(m == 0, "a").when(m == 1, "b").otherwise("skip")
    )


def cached_vectors(spark, d):
    return view(spark, d, "v_vectors").filter("seq % 17 <> 0").select(F.col("seq").alias("key"), "vec")


@query("make_pairs", oracle("select challenge, a, b from h_pairs", **PREF))
def _(spark, d):
    return pairs(spark, d).select("challenge", "a", "b")


@query("pair_id", oracle("select a, b, pair_id, true as symmetric from h_pairs", **PREF))
def _(spark, d):
    return pairs(spark, d).select(
        "a", "b", "pair_id", (F.col("pair_id") == pf.pair_id("b", "a")).alias("symmetric")
    )


@query(
    "pending_pairs",
    oracle(
        "select pair_id, a, b from h_pairs where (a + b) % 4 <> 0 order by pair_id limit 200", **PREF
    ),
)
def _(spark, d):
    p = pairs(spark, d)
    done = p.filter((F.col("a") + F.col("b")) % 4 == 0)
    return pf.pending_pairs(p, done, 200).select("pair_id", "a", "b")


@query(
    "stable_shuffle",
    # The seed is the content's: the exclusive or of the names' hashes, and their number.
    oracle(
        """select id, row_number() over (order by sha256(concat(s, cast(id as varchar))), id) as position
        from v_text, h_seed""",
        h_seed="""select concat(cast(bit_xor(('0x' || substr(sha256(cast(id as varchar)), 1, 15))::bigint) as varchar),
          ':', cast(count(*) as varchar)) as s from v_text""",
    ),
)
def _(spark, d):
    ids = view(spark, d, "v_text").select("id")
    return pf.stable_shuffle(ids, pf.content_seed(ids, "id"), "id")


@query(
    "oriented_pairs",
    oracle(
        """select pair_id, case preferred when 'a' then a else b end as preferred_key,
        case preferred when 'a' then b else a end as rejected_key from h_ann
        where preferred <> 'skip' and a % 17 <> 0 and b % 17 <> 0""",
        **PREF,
    ),
)
def _(spark, d):
    good, _dropped = pf.oriented_pairs(annotations(spark, d), cached_vectors(spark, d))
    return good.select("pair_id", "preferred_key", "rejected_key")


@query(
    "dropped_annotations",
    oracle(
        """select case when preferred = 'skip' then 'skip'
          when (case preferred when 'a' then a else b end) % 17 = 0 then 'missing_preferred'
          else 'missing_rejected' end as drop_reason, count(*) as n from h_ann
        where preferred = 'skip' or a % 17 = 0 or b % 17 = 0 group by 1""",
        **PREF,
    ),
)
def _(spark, d):
    return pf.oriented_pairs(annotations(spark, d), cached_vectors(spark, d))[1]


@query(
    "split_pairs",
    oracle(
        """select pair_id, row_number() over (order by sha256(concat('42', pair_id)), pair_id)
          <= greatest(1, floor(count(*) over () * 0.2::double)) as is_validation from h_pairs""",
        **PREF,
    ),
)
def _(spark, d):
    return pf.split_pairs(pairs(spark, d)).select("pair_id", "is_validation")


def held_out(spark, d):
    """Fit on the training pairs, score the validation pairs."""
    good, _dropped = pf.oriented_pairs(annotations(spark, d), cached_vectors(spark, d))
    split = pf.split_pairs(good)
    model = pf.fit_preference(split.filter("not is_validation"))
    w = pf.model_weights(model)
    val = split.filter("is_validation")
    val = pf.preference_score(val, w, "preferred_vec").withColumnRenamed("preference", "score_preferred")
    return pf.preference_score(val, w, "rejected_vec").withColumnRenamed("preference", "score_rejected")


@query("fit_preference")
def _(spark, d):
    out = held_out(spark, d)
    return out.select("pair_id", rounded("score_preferred").alias("score_preferred"), rounded("score_rejected").alias("score_rejected"))


@query(
    "fit_certificate",
    oracle(
        """select count(*) - greatest(1, floor(count(*) * 0.2::double))::bigint as n, 64::int as dims, true as optimal
          from h_ann where preferred <> 'skip' and a % 17 <> 0 and b % 17 <> 0""",
        **PREF,
    ),
)
def _(spark, d):
    """The fitted weights are where the regularised loss is flat, on all training pairs."""
    good, _dropped = pf.oriented_pairs(annotations(spark, d), cached_vectors(spark, d))
    training = pf.split_pairs(good).filter("not is_validation")
    weights = pf.model_weights(pf.fit_preference(training))
    return pf.fit_certificate(training, weights).select("n", "dims", "optimal")


@query("heldout_metrics")
def _(spark, d):
    return pf.pairwise_metrics(held_out(spark, d))


@query(
    "pairwise_metrics",
    oracle("""select count(*) as n, round(avg(case when clap - melody > 0 then 1e0 else 0e0 end), 6) as accuracy,
      round(avg(ln(1e0 + exp(-(clap - melody)))), 6) as log_loss from v_submissions"""),
)
def _(spark, d):
    out = pf.pairwise_metrics(view(spark, d, "v_submissions"), "clap", "melody")
    return out.withColumns({c: rounded(c) for c in ("accuracy", "log_loss")})


@query(
    "preference_score",
    oracle("""select seq, round(case when seq % 8 = 0 then 5e-1 else 1e0 / (1e0 + exp(-list_sum(list_transform(
      range(1, len(vec) + 1), lambda i: vec[i] * (i % 7 - 3))))) end, 6) as preference from v_vectors"""),
)
def _(spark, d):
    v = view(spark, d, "v_vectors").withColumn("vec", F.when(F.col("seq") % 8 != 0, F.col("vec")))
    out = pf.preference_score(v, [float(i % 7 - 3) for i in range(1, 65)])
    return out.select("seq", rounded("preference").alias("preference"))


VOTE = """select pair, sum(w) filter (choice = 'a') as wa, sum(w) as wt from (
  select *, case when annotator % 3 = 0 then 5e-1 else 1e0 end as w from v_votes) group by pair"""


@query(
    "weighted_vote",
    oracle(
        """select pair, case when coalesce(wa, 0) / wt > 0.6::double then 'a'
        when (wt - coalesce(wa, 0)) / wt > 0.6::double then 'b' end as winner,
        round(coalesce(wa, 0) / wt, 6) as share_a from h_vote""",
        h_vote=VOTE,
    ),
)
def _(spark, d):
    votes = view(spark, d, "v_votes")
    known = votes.select("annotator").distinct().filter("annotator % 3 = 0").withColumn("reliability", F.lit(0.5))
    return pf.weighted_vote(votes, known).withColumn("share_a", rounded("share_a"))


RESOLVED = """select v.*, v.choice = r.winner as agreed from v_votes v join (
  select pair, case when avg(case when choice = 'a' then 1e0 else 0e0 end) > 0.52::double then 'a'
    when avg(case when choice = 'b' then 1e0 else 0e0 end) > 0.52::double then 'b' end as winner
  from v_votes group by pair) r using (pair) where r.winner is not null"""


@query(
    "vote_agreement",
    oracle(
        "select event_id, pair, annotator, agreed from h_agree",
        h_agree=RESOLVED.replace("0.52", "0.6"),
    ),
)
def _(spark, d):
    return pf.vote_agreement(view(spark, d, "v_votes")).select("event_id", "pair", "annotator", "agreed")


@query(
    "annotator_reliability",
    oracle("""select annotator, round(list_reduce(list_prepend(1e0, list(case when choice = 'a' then 1e-1 else 0e0 end order by ts, event_id)),
      lambda r, g: greatest(g + 9e-1 * r, 1e-1)), 6) as reliability, count(*) as votes from v_votes group by annotator"""),
)
def _(spark, d):
    v = view(spark, d, "v_votes").withColumn("agreed", F.col("choice") == "a")
    out = pf.annotator_reliability(v, order=["ts", "event_id"])
    return out.withColumn("reliability", rounded("reliability"))


@query(
    "resolved_reliability",
    oracle(
        """select annotator, round(list_reduce(list_prepend(1e0, list(case when agreed then 1e-1 else 0e0 end order by ts, event_id)),
          lambda r, g: greatest(g + 9e-1 * r, 1e-1)), 6) as reliability, count(*) as votes from h_agree group by annotator""",
        h_agree=RESOLVED.replace("0.52", "0.6").replace("v_votes", "h_daily"),
        h_daily="select * replace (ts // 86400000000 * 40 + pair % 40 as pair) from v_votes",
    ),
)
def _(spark, d):
    """Agreement with the winner of each vote's pair, in the order of the votes."""
    v = view(spark, d, "v_votes")
    daily = v.withColumn("pair", F.floor(F.col("ts") / 86_400_000_000) * 40 + F.col("pair") % 40)
    out = pf.annotator_reliability(pf.vote_agreement(daily), order=["ts", "event_id"])
    return out.withColumn("reliability", rounded("reliability"))


DAILY = "select day, contributor as uid, avg(raw) as score from v_scores group by day, contributor"


@query(
    "uncertain_pairs",
    oracle(
        """select day, a, b, round(uncertainty, 6) as uncertainty, rank from (
          select x.day, x.uid as a, y.uid as b, 1e0 - abs(x.score - y.score) as uncertainty,
            row_number() over (partition by x.day order by round(1e0 - abs(x.score - y.score), 9) desc, x.uid, y.uid) as rank
          from h_day x join h_day y on x.day = y.day and x.uid < y.uid) where rank <= 3""",
        h_day=DAILY,
    ),
)
def _(spark, d):
    v = view(spark, d, "v_scores").groupBy("day", F.col("contributor").alias("uid")).agg(F.avg("raw").alias("score"))
    return pf.uncertain_pairs(v, "day").withColumn("uncertainty", rounded("uncertainty"))


@query(
    "retrain_due",
    oracle(
        """select count(*) as total, count(*) - 100 as new_pairs, null::varchar as blocked_by, true as due from h_ann""",
        **PREF,
    ),
)
def _(spark, d):
    return pf.retrain_due(annotations(spark, d), now=100_000, last_run=90_000, last_count=100)


@query(
    "retrain_blocked",
    oracle("""select kind, case when kind = 'empty' then 0 else n end as total, case when kind = 'empty' then 0 when kind = 'known' then 4 else n end as new_pairs,
      case kind when 'empty' then 'too_few_total' when 'known' then 'too_few_new' when 'soon' then 'cooldown' end as blocked_by, kind = 'later' as due
      from (select count(*) as n from v_votes), (select unnest(['empty', 'known', 'soon', 'later']) as kind)"""),
)
def _(spark, d):
    """Every reason that blocks a run, and a run that is due."""
    votes = view(spark, d, "v_votes").select("event_id")
    seen = votes.count() - 4
    cases = [("empty", votes.filter("event_id is null"), 9_000, 0), ("known", votes, 9_000, seen), ("soon", votes, 7_199, 0), ("later", votes, 7_200, 0)]
    parts = [
        pf.retrain_due(rows, now=now, last_run=0, last_count=known).withColumn("kind", F.lit(kind)) for kind, rows, now, known in cases
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# --- allocation -------------------------------------------------------------


def _draw(field: str) -> str:
    return f"('0x' || substr(sha256(concat('s1:', cast(request as varchar), ':{field}')), 1, 8))::bigint"


GENRES = list(al.TEMPO_RANGES)


@query(
    "generate_challenges",
    oracle(f"""select request, genre, mood, duration, key_signature, time_signature, vocals_requested, challenge_id,
        (lo + t % (hi - lo + 1))::integer as tempo from (
        select *, ({GENRES})[g + 1] as genre, ({[al.TEMPO_RANGES[g][0] for g in GENRES]})[g + 1] as lo,
          ({[al.TEMPO_RANGES[g][1] for g in GENRES]})[g + 1] as hi from (
          select request, {_draw("genre")} % {len(GENRES)} as g, {_draw("tempo")} as t,
            ({al.MOODS})[{_draw("mood")} % {len(al.MOODS)} + 1] as mood,
            ({al.DURATIONS}::double[])[{_draw("duration")} % {len(al.DURATIONS)} + 1] as duration,
            ({al.KEYS})[{_draw("key")} % {len(al.KEYS)} + 1] as key_signature,
            ({al.TIME_SIGNATURES})[{_draw("time")} % {len(al.TIME_SIGNATURES)} + 1] as time_signature,
            {_draw("vocals")} < {int(al.VOCAL_SHARE * 2**32)} as vocals_requested,
            substr(sha256(concat('s1:', cast(request as varchar), ':id')), 1, 16) as challenge_id from v_orders))"""),
)
def _(spark, d):
    return al.challenges_for(view(spark, d, "v_orders"), "request", "s1")


POOL = ["bass", "drums", "flute", "guitar", "harp", "piano", "strings"]
SAMPLED = f"""select request, list_transform(list_sort(list_transform({POOL}, lambda x:
    struct_pack(h := sha256(concat('s1:', cast(request as varchar), ':', x)), x := x)))[1:2 + {_draw("count")} % 3],
    lambda t: t.x) as sampled from v_orders"""


def sampled(spark, d):
    o = view(spark, d, "v_orders").withColumn("pool", F.array(*map(F.lit, POOL)))
    return al.sample_from_pool(o, "request", "pool", "s1")


@query(
    "sample_from_pool",
    oracle("select request, array_to_string(sampled, ',') as sampled from h_s", h_s=SAMPLED),
)
def _(spark, d):
    return sampled(spark, d).select("request", F.array_join("sampled", ",").alias("sampled"))


@query(
    "render_prompts",
    oracle(
        """select request, concat('A ', priority, ' ', publication, ' piece around ', cast(key as varchar), ' BPM with ',
        array_to_string(sampled[1:len(sampled) - 1], ', '), ' and ', sampled[len(sampled)], ', soft.') as prompt
        from h_s join v_orders using (request)""",
        h_s=SAMPLED,
    ),
)
def _(spark, d):
    s = sampled(spark, d).withColumn("constraint", F.lit("soft"))
    out = al.render_prompts(
        s, {"mood": "priority", "genre": "publication", "tempo": "key"}, "sampled", "constraint"
    )
    return out.select("request", "prompt")


MEMBERS = """select uid, hotkey, row_number() over (order by uid) - 1 as member from v_nodes
  where permit and stake >= 5000 and uid % 4 <> 0"""


def members(spark, d):
    nodes = view(spark, d, "v_nodes")
    commits = nodes.select(
        "hotkey", F.when(F.col("uid") % 4 == 0, "other").otherwise("1080").alias("value")
    )
    return al.active_members(commits, nodes, "1080", 5000.0)


@query("active_members", oracle("select uid, hotkey, member from h_m", h_m=MEMBERS))
def _(spark, d):
    return members(spark, d)


PARTS = """select id as uid, (row_number() over (order by sha256(concat(sha256('1080'), cast(id as varchar))), id) - 1) % 7 as subset
  from v_levels"""


def parts(spark, d):
    ids = view(spark, d, "v_levels").select(F.col("id").alias("uid"))
    return al.partition_ids(ids, "uid", 7, "1080")


@query("partition_ids", oracle("select uid, subset from h_p", h_p=PARTS))
def _(spark, d):
    return parts(spark, d)


@query(
    "assignments",
    oracle(
        """select r.round, m.member, m.uid as member_uid, p.uid as id from (select unnest(range(0, 7)) as round) r
        join h_m m on m.member < 7 join h_p p on p.subset = (m.member + r.round) % 7 where p.uid % 10 <> 0""",
        h_m=MEMBERS,
        h_p=PARTS,
    ),
)
def _(spark, d):
    p = parts(spark, d).withColumnRenamed("uid", "id")
    m = members(spark, d).filter("member < 7")
    out = al.assignments(p, m, 7, 7, p.filter("id % 10 <> 0"), "id")
    return out


@query(
    "epoch_phase",
    oracle("""select event_id, sec - e as epoch_start, case when e < 60 then 'sync' when (e - 60) // 240 < 4 then 'round'
        else 'cooldown' end as phase, case when e >= 60 and (e - 60) // 240 < 4 then (e - 60) // 240 end as round
      from (select event_id, sec, sec % 1080 as e from v_scores)"""),
)
def _(spark, d):
    return al.epoch_phase(view(spark, d, "v_scores"), "sec").select(
        "event_id", "epoch_start", "phase", "round"
    )


@query(
    "audit_partition",
    oracle("select true as disjoint, true as complete, true as balanced, 7::bigint as subsets"),
)
def _(spark, d):
    ids = view(spark, d, "v_levels").select(F.col("id").alias("uid"))
    return al.audit_partition(parts(spark, d), ids, "uid")
