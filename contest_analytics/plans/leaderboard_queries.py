"""Queries over scores, nodes and weights: folds, ranking, routing, distribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from contest_analytics.functions.curves import rounded
from contest_analytics.operators import leaderboard as lb
from contest_analytics.plans.adapters import oracle, view
from contest_analytics.plans.registry import query
from contest_analytics.scale import are_hot

# --- shared inputs ----------------------------------------------------------

EMA_SQL = """select {keys}, sum(0.2::double * greatest(0e0, least(1e0, raw)) * pow(0.8::double, after)) as ema,
  count(*) as rounds from (select *, count(*) over (partition by {keys}) - row_number()
    over (partition by {keys} order by micros, event_id) as after from v_scores) group by {keys}"""
BOARD = EMA_SQL.format(keys="contest, contributor")
TIERED = """select *, case when total > 0 then rw / total * share else 0e0 end as weight from (
  select *, sum(rw) over (partition by contest, tier) as total,
    case when tier = 'rest' then 2e-1 when rest > 0 then 8e-1 else 1e0 end as share from (
    select *, coalesce(sum(case when tier = 'rest' then rw end) over (partition by contest), 0) as rest from (
      select *, case when rank <= 10 then 'elite' else 'rest' end as tier,
        case when ema > 0 then ema * ema else 0e0 end as rw from (
        select *, row_number() over (partition by contest order by ema desc, contributor) as rank
        from h_board))))"""
HELP = {"h_board": BOARD, "h_tiered": TIERED}


def board(spark, d):
    """The board by contest, and whether a contest has too many contributors for one task."""
    events = view(spark, d, "v_scores")
    hot_key, hot_contest = are_hot(events, ["contest"], ["contributor"])
    return lb.ema(events, ["contest", "contributor"], ["micros", "event_id"], "raw", hot=hot_key), hot_contest


def user_board(spark, d):
    return lb.ema(view(spark, d, "v_scores"), ["contributor"], ["micros", "event_id"], "raw")


@query(
    "leaderboard_snapshot",
    oracle(
        """select contest, contributor, rank, tier, rounds, round(ema, 6) as ema,
        round(weight, 6) as weight from h_tiered""",
        **HELP,
    ),
)
def _(spark, d):
    df, hot = board(spark, d)
    return lb.snapshot(df, ["contest"], hot=hot)


@query(
    "ema",
    oracle(
        "select contributor, round(ema, 6) as ema, rounds from h_user",
        h_user=EMA_SQL.format(keys="contributor"),
    ),
)
def _(spark, d):
    return user_board(spark, d).withColumn("ema", rounded("ema"))


@query(
    "ema_trajectory",
    oracle("""select contributor, event_id, round(states[i], 6) as ema from (
      select contributor, unnest(ids) as event_id, unnest(range(1, len(ids) + 1)) as i, states from (
        select contributor, ids, list_transform(range(1, len(xs) + 1), lambda n:
          list_sum(list_transform(range(1, n + 1), lambda j: 0.2::double * xs[j] * pow(0.8::double, n - j)))) as states
        from (select contributor, list(event_id order by micros, event_id) as ids,
          list(greatest(0e0, least(1e0, raw)) order by micros, event_id) as xs
          from v_scores group by contributor)))"""),
)
def _(spark, d):
    out = lb.ema_trajectory(
        view(spark, d, "v_scores"), ["contributor"], ["micros", "event_id"], "raw"
    )
    return out.select("contributor", "event_id", rounded("ema").alias("ema"))


ASSIGNED = """select distinct u.contributor, dd.day from (select distinct contributor from v_scores) u
  cross join (select distinct day from v_scores) dd"""
RESPONDED = """select contributor, day, max(raw) as score from v_scores where contest = 'purchase'
  group by contributor, day"""


def assigned(spark, d):
    """Every contributor in every round from its first to its last event day."""
    v = view(spark, d, "v_scores")
    span = v.groupBy("contributor").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    return span.select("contributor", F.explode(F.sequence("lo", "hi")).alias("day"))


def responses(spark, d):
    v = view(spark, d, "v_scores").filter("contest = 'purchase'")
    return v.groupBy("contributor", "day").agg(F.max("raw").alias("score"))


@query(
    "nonresponder_zeros",
    oracle(
        """select a.contributor, a.day, coalesce(r.score, 0e0) as score from (
        select contributor, unnest(range(min(day), max(day) + 1)) as day from v_scores group by contributor) a
        left join h_resp r on r.contributor = a.contributor and r.day = a.day""",
        h_resp=RESPONDED,
    ),
)
def _(spark, d):
    return lb.with_nonresponders(assigned(spark, d), responses(spark, d), ["contributor", "day"])


@query(
    "ema_with_resets",
    oracle("""select contributor, hotkey, count(*) as rounds, any_value(resets) as resets,
      round(sum(0.2::double * greatest(0e0, least(1e0, raw)) * pow(0.8::double, last - i)), 6) as ema from (
      select *, max(case when changed then i end) over (partition by contributor) as cut,
        count(*) over (partition by contributor) as last,
        sum(case when changed then 1 else 0 end) over (partition by contributor)::bigint as resets from (
        select *, row_number() over w as i, coalesce(lag(hotkey) over w <> hotkey, false) as changed
        from v_scores window w as (partition by contributor order by micros, event_id)))
      where cut is null or i >= cut group by contributor, hotkey"""),
)
def _(spark, d):
    out = lb.ema_with_resets(
        view(spark, d, "v_scores"), ["contributor"], ["micros", "event_id"], "hotkey", "raw"
    )
    return out.withColumn("ema", rounded("ema"))


@query(
    "prune_stale",
    oracle(
        """select contributor, round(ema, 6) as ema, rounds from h_user
        where contributor in (select uid from v_nodes)""",
        h_user=EMA_SQL.format(keys="contributor"),
    ),
)
def _(spark, d):
    nodes = view(spark, d, "v_nodes").select(F.col("uid").alias("contributor"))
    return lb.prune_stale(user_board(spark, d), nodes, "contributor").withColumn(
        "ema", rounded("ema")
    )


MEDIANS = """select contest, day, quantile_cont(greatest(0e0, least(1e0, raw)), 0.5) as median
  from v_scores group by contest, day"""


@query(
    "population_quality",
    oracle(
        """select a.contest, a.day, round(a.median, 6) as median,
          round(sum(0.05::double * b.median * pow(0.95::double, a.i - b.i)) + any_value(0.3::double * pow(0.95::double, a.i)), 6)
          as quality from h_num a join h_num b on a.contest = b.contest and b.i <= a.i
        group by a.contest, a.day, a.median""",
        h_med=MEDIANS,
        h_num="select *, row_number() over (partition by contest order by day) as i from h_med",
    ),
)
def _(spark, d):
    out = lb.population_quality(view(spark, d, "v_scores"), ["contest"], "day", "raw")
    return out.select(
        "contest", "day", rounded("median").alias("median"), rounded("quality").alias("quality")
    )


@query(
    "power_weight",
    oracle(
        """select contributor, round(case when ema > 0 then ema * ema else 0 end, 6) as weight
        from h_user""",
        h_user=EMA_SQL.format(keys="contributor"),
    ),
)
def _(spark, d):
    return user_board(spark, d).select(
        "contributor", rounded(lb.power_weight("ema")).alias("weight")
    )


@query(
    "tiered_weights",
    oracle(
        "select contest, contributor, tier, round(weight, 6) as weight from h_tiered where ema > 0",
        **HELP,
    ),
)
def _(spark, d):
    df, hot = board(spark, d)
    w = lb.tiered_weights(df, ["contest"], hot=hot).filter("ema > 0")
    return w.select("contest", "contributor", "tier", rounded("weight").alias("weight"))


@query(
    "leaderboard_summary",
    oracle(
        """select contest, count(*) as total, count(*) filter (weight > 0) as with_weight,
        count(*) filter (tier = 'elite') as elite_count,
        round(coalesce(sum(weight) filter (tier = 'elite'), 0), 4) as elite_share,
        round(avg(ema), 6) as ema_mean, round(max(ema), 6) as ema_max,
        round(coalesce(avg(weight) filter (ema > 0), 0), 6) as weight_mean,
        round(coalesce(max(weight) filter (ema > 0), 0), 6) as weight_max
        from h_tiered group by contest""",
        **HELP,
    ),
)
def _(spark, d):
    df, hot = board(spark, d)
    out = lb.summary(df, ["contest"], hot=hot)
    means = ["ema_mean", "ema_max", "weight_mean", "weight_max"]
    return out.withColumns({c: rounded(c) for c in means})


WEIGHTS = "select publication, key, sum(price) as w from v_orders group by publication, key"
SHIFTED = "select publication, key, w - 1e5 as w from h_weights"


def weights(spark, d):
    return view(spark, d, "v_orders").groupBy("publication", "key").agg(F.sum("price").alias("w"))


@query(
    "normalize_weights",
    oracle(
        """select publication, key, round(case when t > 0 then greatest(w, 0) / t else 1e0 / n end, 6) as share
        from (select *, sum(greatest(w, 0)) over (partition by publication) as t,
          count(*) over (partition by publication) as n from h_shift)""",
        h_weights=WEIGHTS,
        h_shift=SHIFTED,
    ),
)
def _(spark, d):
    shifted = weights(spark, d).withColumn("w", F.col("w") - 100000.0)
    out = lb.normalize_weights(shifted, ["publication"])
    return out.select("publication", "key", rounded("share").alias("share"))


@query(
    "cap_weights",
    oracle(
        # Ascending cumulative sums over the whole partition; Spark uses the top list.
        """select publication, key, round(case when total = 0 or n * 1e-2 <= 1 then 1e0 / n
            when mx / total <= 1e-2 then w / total else least(w, cut) / sum(least(w, cut)) over (partition by publication) end, 6) as share
        from (select *, (1e-2 * cs_at - 1e-7) / (1e0 - 1e-2 * (n - n_below)) * total as cut from (
          select *, max(case when asc_i = n_below then cs end) over (partition by publication) as cs_at from (
            select *, count(*) filter (e / ((n - asc_i) * e + cs + 1e-7) < 1e-2) over (partition by publication) as n_below from (
              select *, sum(e) over (partition by publication order by asc_i) as cs from (
                select *, w / total as e from (
                  select *, sum(w) over (partition by publication) as total,
                    count(*) over (partition by publication) as n, max(w) over (partition by publication) as mx,
                    row_number() over (partition by publication order by w, key desc) as asc_i
                  from h_weights))))))""",
        h_weights=WEIGHTS,
    ),
)
def _(spark, d):
    out = lb.cap_weights(weights(spark, d), ["publication"], limit=0.01)
    return out.select("publication", "key", rounded("share").alias("share"))


@query(
    "reserve_share",
    oracle(
        """select publication, key, round(w * 95e-2, 4) as w from h_weights where key <> 7
        union all select distinct publication, 7, 5e-2 from h_weights""",
        h_weights=WEIGHTS,
    ),
)
def _(spark, d):
    out = lb.reserve_share(weights(spark, d), ["publication"], reserved_key=7, fraction=0.05)
    return out.withColumn("w", rounded("w", 4))


@query(
    "smooth_weights",
    oracle(
        """select publication, key, round(s / sum(s) over (partition by publication), 6) as share from (
          select p.publication, w.key, sum(w.w) / least(p.i, 5) as s from h_pub p join h_num w
            on w.i between p.i - 4 and p.i group by p.publication, p.i, w.key)""",
        h_weights=WEIGHTS,
        h_pub="select publication, row_number() over (order by publication) as i from (select distinct publication from h_weights)",
        h_num="select h_weights.*, i from h_weights join h_pub using (publication)",
    ),
)
def _(spark, d):
    out = lb.smooth_weights(weights(spark, d))
    return out.select("publication", "key", rounded("share").alias("share"))


@query(
    "min_gap_select",
    oracle("""select contest, unnest(list_reduce(list([block] order by block), lambda x, y:
        case when y[1] - x[-1] >= 115 then list_append(x, y[1]) else x end)) as block
      from (select distinct contest, sec // 12 as block from v_scores) group by contest"""),
)
def _(spark, d):
    v = view(spark, d, "v_scores").withColumn("block", F.floor(F.col("sec") / 12))
    return lb.min_gap_select(v, "contest", "block")


@query(
    "densify_weights",
    oracle(
        """select p.publication, nd.uid as key, round(coalesce(w.w, 0) / p.t, 6) as share from (
          select publication, sum(w) as t from h_weights where key in (select uid from v_nodes)
          group by publication having sum(w) > 0) p cross join v_nodes nd
        left join h_weights w on w.publication = p.publication and w.key = nd.uid""",
        h_weights=WEIGHTS,
    ),
)
def _(spark, d):
    nodes = view(spark, d, "v_nodes").select(F.col("uid").alias("key"))
    out = lb.densify(weights(spark, d), nodes, ["publication"], "key")
    return out.withColumn("share", rounded("share"))


@query(
    "event_summary",
    oracle("""select day, count(distinct contributor) as participants,
      count(distinct case when latency < 80 then contributor end) as available,
      count(distinct case when ok then contributor end) as successful, max(latency) as duration
      from v_scores group by day"""),
)
def _(spark, d):
    pings = view(spark, d, "v_scores").select(
        "day",
        F.col("contributor").alias("participant"),
        (F.col("latency") < 80).alias("available"),
        "ok",
        "latency",
    )
    return lb.event_summary(pings, ["day"])


@query(
    "round_stats",
    oracle("""select count(*) as total_rounds, count(*) filter (completed) as completed_rounds,
      round(avg(responses) filter (completed), 6) as avg_responses,
      round(avg(duration) filter (completed), 6) as avg_duration,
      count(distinct genre) as distinct_genres from (
        select request, count(*) as responses, count(*) > 2 as completed, max(requested) as duration,
          request % 17 as genre from v_submissions group by request order by request desc limit 100)"""),
)
def _(spark, d):
    rounds = (
        view(spark, d, "v_submissions")
        .groupBy("request")
        .agg(F.count(F.lit(1)).alias("responses"), F.max("requested").alias("duration"))
        .withColumns({"completed": F.col("responses") > 2, "genre": F.col("request") % 17})
    )
    out = lb.round_stats(rounds, ["request"])
    return out.withColumns({c: rounded(c) for c in ("avg_responses", "avg_duration")})


STATS = """select contributor as uid, count(*) filter (ok) as success_count,
  count(*) filter (not ok) as failure_count, count(*) filter (ok) * 1e0 / count(*) as success_rate,
  coalesce(sum(latency) filter (ok), 0) * 1e0 / greatest(count(*) filter (ok), 1) as avg_latency,
  max(micros) filter (ok) as last_success, max(micros) filter (not ok) as last_failure
  from v_scores group by contributor"""


def stats(spark, d):
    v = view(spark, d, "v_scores").select(
        F.col("contributor").alias("uid"), "ok", "latency", F.col("micros").alias("ts")
    )
    return lb.reliability_stats(v)


@query(
    "reliability_stats",
    oracle(
        """select uid, success_count, failure_count, round(success_rate, 6) as success_rate,
        round(avg_latency, 6) as avg_latency, last_success, last_failure from h_stats""",
        h_stats=STATS,
    ),
)
def _(spark, d):
    out = stats(spark, d)
    return out.withColumns({c: rounded(c) for c in ("success_rate", "avg_latency")})


@query(
    "route_candidates",
    oracle(
        """select request, row_number() over (partition by request order by effective desc, uid) as attempt,
          uid, round(effective, 6) as effective from (
          select r.request, t.uid, t.effective from (select distinct request from v_submissions) r
          cross join (select b.uid, b.ema * (case when s.success_count + s.failure_count >= 3
              then s.success_rate * s.success_rate else 1e0 end) / (1e0 + (b.uid % 4) * 5e-1) as effective
            from (select contributor as uid, ema * 6e0 as ema from h_user) b
            left join h_stats s on s.uid = b.uid
            where b.ema >= 45e-2 and b.uid % 4 < 3 and b.uid in (select uid from v_nodes where serving)) t
          where not exists (select 1 from v_submissions x where x.request = r.request and x.contributor = t.uid))
        qualify attempt <= 3""",
        h_stats=STATS,
        h_user=EMA_SQL.format(keys="contributor"),
    ),
)
def _(spark, d):
    subs = view(spark, d, "v_submissions").select("request", F.col("contributor").alias("uid"))
    b = user_board(spark, d).select(
        F.col("contributor").alias("uid"), (F.col("ema") * 6.0).alias("ema")
    )
    s = stats(spark, d).withColumns(
        {
            "total_requests": F.col("success_count") + F.col("failure_count"),
            "active": F.col("uid") % 4,
        }
    )
    out = lb.route_candidates(
        subs.select("request").distinct(),
        b,
        s,
        view(spark, d, "v_nodes"),
        tried=subs.distinct(),
    )
    return out.withColumn("effective", rounded("effective"))


@query(
    "top_k_serving",
    oracle(
        """select contributor as uid, round(ema, 6) as ema from h_user
        where contributor in (select uid from v_nodes where serving) and ema > 0
        order by h_user.ema desc, contributor limit 10""",
        h_user=EMA_SQL.format(keys="contributor"),
    ),
)
def _(spark, d):
    b = user_board(spark, d).withColumnRenamed("contributor", "uid")
    out = lb.top_k_serving(b, view(spark, d, "v_nodes"), 10, "seed")
    return out.withColumn("ema", rounded("ema"))


@query(
    "top_k_serving_fallback",
    oracle("""select uid, 0e0 as ema from (select uid from v_nodes where serving
      order by sha256(concat('seed', cast(uid as varchar))), uid limit 10)"""),
)
def _(spark, d):
    none = user_board(spark, d).select(
        F.col("contributor").alias("uid"), F.lit(0.0).alias("ema")
    )
    return lb.top_k_serving(none, view(spark, d, "v_nodes"), 10, "seed")


@query(
    "fastest_response",
    oracle("""select request, contributor, elapsed from (select request, contributor, elapsed,
      row_number() over (partition by request order by elapsed, contributor) as r
      from v_submissions where rms >= 1e-2) where r = 1"""),
)
def _(spark, d):
    s = view(spark, d, "v_submissions").withColumn("valid", F.col("rms") >= 0.01)
    return lb.fastest_response(s)


@query(
    "top_n_per_request",
    oracle("""select request, contributor, part, score, rank, wanted, count(*) over (partition by request) as delivered
      from (select request, contributor, part, clap as score, 1 + request % 9 as wanted, row_number()
        over (partition by request order by clap desc, contributor * 1000000 + part) as rank from v_submissions)
      where rank <= wanted"""),
)
def _(spark, d):
    s = view(spark, d, "v_submissions").select(
        "request",
        "contributor",
        "part",
        (F.col("contributor") * 1000000 + F.col("part")).alias("_k"),
        F.col("clap").alias("score"),
        (1 + F.col("request") % 9).alias("wanted"),
    )
    return lb.top_n_per_request(s, key="_k").drop("_k")


@query(
    "merge_peer_scores",
    oracle("""select event_id as id, contributor as uid, raw as score from v_scores
      where day >= 19737 and contest <> 'error' and contributor in (select uid from v_nodes)
        and event_id % 10 <> 3"""),
)
def _(spark, d):
    v = view(spark, d, "v_scores")
    incoming = v.select(
        F.col("event_id").alias("id"),
        F.col("contributor").alias("uid"),
        F.col("raw").alias("score"),
        F.col("contest").alias("source"),
        F.col("day").alias("ts"),
        F.lit("").alias("hotkey"),
    )
    seen = v.filter("event_id % 10 = 3").select(F.col("event_id").alias("id"))
    doubled = incoming.unionAll(incoming.filter("id % 3 = 0"))
    out = lb.merge_peer_scores(doubled, seen, view(spark, d, "v_nodes"), 19737, "error")
    return out.select("id", "uid", "score")


@query(
    "errors_last_hour",
    oracle("""select event_id, contributor, count(*) filter (is_error) over (partition by contributor
      order by sec range between 3599 preceding and current row) as errors from v_scores"""),
)
def _(spark, d):
    out = lb.errors_last_hour(
        view(spark, d, "v_scores"), "contributor", "sec", "is_error", "event_id"
    )
    return out.select("event_id", "contributor", "errors")


@query(
    "top_by_incentive",
    oracle("""select uid, hotkey, incentive from v_nodes where serving
      order by incentive desc, uid limit 20"""),
)
def _(spark, d):
    return lb.top_by_incentive(view(spark, d, "v_nodes"), 20).select("uid", "hotkey", "incentive")
