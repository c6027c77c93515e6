"""Streaming forms run over the tables as streams, and the user hooks.

A stream is drained into a table below the shared checkpoint folder; what is
returned is that table's last state per key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from contest_analytics.functions.curves import rounded
from contest_analytics.functions.hooks import ScorerRegistry, batch_scorer, expand_rows
from contest_analytics.plans.adapters import SPARK_VIEWS, oracle, view
from contest_analytics.plans.embedding_queries import PLANE_DISTANCE, PLANE_H, plane, plane_reference, reference
from contest_analytics.plans.leaderboard_queries import EMA_SQL
from contest_analytics.plans.preference_queries import VOTE
from contest_analytics.plans.registry import ORACLES, query
from contest_analytics.sources.snapshots import read_snapshot
from contest_analytics.streaming import annotations, sinks, stateful, windows


def stream(spark, d, name):
    """A view over its table read as a stream."""
    source, exprs = SPARK_VIEWS[name]
    schema = spark.read.parquet(f"{d}/{source}.parquet").schema
    # A table is one file or a folder of them; a stream takes either by a pattern, and no file by its path.
    return spark.readStream.schema(schema).parquet(f"{d}/{{{source}.parquet}}").selectExpr(*exprs)


@query("stream_leaderboard", ORACLES["ema_with_resets"].replace(", any_value(resets) as resets", ""))
def _(spark, d):
    stateful.use_rocksdb(spark)
    board = stateful.stream_leaderboard(stream(spark, d, "v_scores"))
    return sinks.drain(board, keys=["contributor"]).withColumn("ema", rounded("ema"))


@query("stream_dedup", oracle("select event_id, contributor from v_scores"))
def _(spark, d):
    once = windows.timed(stream(spark, d, "v_scores")).select("event_id", "contributor", "ts")
    twice = once.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = windows.stream_dedup(twice, "event_id")
    return sinks.drain(out.select("event_id", "contributor"), mode="append")


@query(
    "stream_nonresponders",
    oracle("""select a.event_id, a.contributor, a.micros,
        coalesce(arg_min(r.raw, struct_pack(m := r.micros, s := r.raw)), 0e0) as score
      from v_scores a left join (select * from v_scores where contest = 'purchase') r
        on r.contributor = a.contributor and r.micros between a.micros and a.micros + 3600000000
      where a.contest = 'view' group by 1, 2, 3"""),
)
def _(spark, d):
    def sides(v):
        asked = v.filter("contest = 'view'").select("contributor", "event_id", "ts")
        return asked, v.filter("contest = 'purchase'").select("contributor", "ts", F.col("raw").alias("score"))

    asked, _ = sides(windows.timed(stream(spark, d, "v_scores")))
    _, got = sides(windows.timed(stream(spark, d, "v_scores")))
    matched = sinks.drain(windows.stream_nonresponders(asked, got, ["contributor"]), mode="append")
    out = windows.settle(matched, *sides(windows.timed(view(spark, d, "v_scores"))), ["contributor"], "event_id")
    return out.select("event_id", "contributor", F.unix_micros("ts").alias("micros"), "score")


@query("stream_window_distance")
def _(spark, d):
    stateful.use_rocksdb(spark)
    row = reference(spark, d).first()
    out = stateful.stream_window_distance(
        stream(spark, d, "v_vectors"), (row["mean"], row["cov"]) if row else None
    )
    flat = sinks.drain(out, keys=["contributor"])
    return flat.select("contributor", "n", rounded("distance").alias("distance"), rounded("penalty").alias("penalty"))


@query(
    "stream_window_distance_plane",
    oracle(
        f"""select contributor, n, round(distance, 6) as distance, round(case when distance is null then 1e0
            else 5e-1 + 5e-1 / (1e0 + pow(distance / 15e0, 2)) end, 6) as penalty from (
          select p.k as contributor, p.n, case when p.n >= 10 and r.n >= 10 then {PLANE_DISTANCE} end as distance
          from h_last p cross join h_ref r)""",
        **PLANE_H,
    ),
)
def _(spark, d):
    """In five micro-batches, so that the windows of fifty vectors move on."""
    stateful.use_rocksdb(spark)
    row = plane_reference(spark, d).first()
    rows = sinks.feed(plane(spark, d).select("contributor", "seq", "vec"), "seq", 5)
    out = stateful.stream_window_distance(rows, (row["mean"], row["cov"]) if row else None)
    flat = sinks.drain(out, keys=["contributor"])
    return flat.select("contributor", "n", rounded("distance").alias("distance"), rounded("penalty").alias("penalty"))


@query(
    "stream_epoch_agg",
    oracle("""select sec - e as epoch_start, case when e < 60 then 'sync' when (e - 60) // 240 < 4 then 'round' else 'cooldown' end as phase,
      case when e >= 60 and (e - 60) // 240 < 4 then (e - 60) // 240 end as round, count(*) as n, round(avg(greatest(0e0, least(1e0, raw))), 6) as mean_score
      from (select *, sec % 1080 as e from v_scores) group by 1, 2, 3"""),
)
def _(spark, d):
    out = windows.stream_epoch_agg(windows.timed(stream(spark, d, "v_scores")))
    flat = sinks.drain(out, keys=["epoch_start", "phase", "round"])
    return flat.withColumn("mean_score", rounded("mean_score"))


@query(
    "stream_error_rate",
    oracle("""select contributor, w as window_start, count(*) as errors from (
      select contributor, unnest(range(sec - sec % 300 - 3300, sec - sec % 300 + 1, 300)) as w from v_scores where is_error) group by 1, 2"""),
)
def _(spark, d):
    out = windows.stream_error_rate(windows.timed(stream(spark, d, "v_scores")), "contributor")
    return sinks.drain(out, keys=["window_start", "contributor"])


@query(
    "publish_snapshots",
    oracle(
        """select contributor, rank, case when rank <= 10 then 'elite' else 'rest' end as tier, rounds, round(ema, 6) as ema from (
          select *, row_number() over (order by ema desc, contributor) as rank from h_user)""",
        h_user=EMA_SQL.format(keys="contributor"),
    ),
)
def _(spark, d):
    stateful.use_rocksdb(spark)
    v = stream(spark, d, "v_scores").withColumn("hotkey", F.lit("same"))
    path = sinks.scratch(spark, "snapshots")
    sinks.publish_snapshots(
        stateful.stream_leaderboard(v), path, sinks.scratch(spark, "publish")
    ).awaitTermination()
    return read_snapshot(spark, path).select("contributor", "rank", "tier", "rounds", "ema")


@query(
    "stream_votes",
    oracle(
        """select pair, case when coalesce(wa, 0) / wt > 0.6::double then 'a'
        when (wt - coalesce(wa, 0)) / wt > 0.6::double then 'b' end as winner,
        round(coalesce(wa, 0) / wt, 6) as share_a from h_vote""",
        h_vote=VOTE,
    ),
)
def _(spark, d):
    w = F.when(F.col("annotator") % 3 == 0, 0.5).otherwise(1.0)
    out = windows.stream_votes(stream(spark, d, "v_votes").withColumn("weight", w))
    return sinks.drain(out, keys=["pair"]).withColumn("share_a", rounded("share_a"))


@query("stream_reliability", ORACLES["annotator_reliability"])
def _(spark, d):
    stateful.use_rocksdb(spark)
    v = stream(spark, d, "v_votes").withColumn("agreed", F.col("choice") == "a")
    out = sinks.drain(stateful.stream_reliability(v, ("ts", "event_id")), keys=["annotator"])
    return out.withColumn("reliability", rounded("reliability"))


#: A task of the annotators lasts a day: 40 pairs for each.
DAILY_VOTES = "select * replace (ts // 86400000000 * 40 + pair % 40 as pair) from v_votes"


@query(
    "stream_annotations",
    oracle(
        """select annotator, round(list_reduce(list_prepend(1e0, list(case when agreed then 1e-1 else 0e0 end order by ts, event_id)),
        lambda r, g: greatest(g + 9e-1 * r, 1e-1)), 6) as reliability, count(*) as votes from h_agree group by annotator""",
        h_agree="""select v.*, v.choice = r.winner as agreed from h_daily v join (
          select pair, case when avg(case when choice = 'a' then 1e0 else 0e0 end) > 0.6::double then 'a'
            when avg(case when choice = 'b' then 1e0 else 0e0 end) > 0.6::double then 'b' end as winner
          from h_daily group by pair) r using (pair) where r.winner is not null""",
        h_daily=DAILY_VOTES,
    ),
)
def _(spark, d):
    """Pairs close two days after their last vote, so most are settled before the stream ends."""
    stateful.use_rocksdb(spark)
    v = view(spark, d, "v_votes")
    daily = v.withColumn("pair", F.floor(F.col("ts") / 86_400_000_000) * 40 + F.col("pair") % 40)
    votes = sinks.feed(daily, "ts", 5)
    out = annotations.stream_annotations(votes, keep=2 * 86_400, delay="8 days")
    last = sinks.drain(out, mode="append", keys=["annotator"]).filter("votes > 0")
    return last.select("annotator", rounded("reliability").alias("reliability"), "votes")


@query(
    "publish_snapshots_gap",
    ORACLES["publish_snapshots"].replace("select contributor, rank,", "select 4 as published_at, contributor, rank,"),
)
def _(spark, d):
    """Five batches at times 0 to 4, versions two apart: the last one holds what waited."""
    stateful.use_rocksdb(spark)
    v = view(spark, d, "v_scores").select("contributor", "micros", "event_id", "raw", F.lit("same").alias("hotkey"))
    path = sinks.scratch(spark, "snapshots")
    board = stateful.stream_leaderboard(sinks.feed(v, "micros", 5))
    sinks.publish_snapshots(
        board, path, sinks.scratch(spark, "publish"), gap=2, clock=lambda batch: batch
    ).awaitTermination()
    return read_snapshot(spark, path).select("published_at", "contributor", "rank", "tier", "rounds", "ema")


# --- hooks ------------------------------------------------------------------


@query(
    "register_scorer",
    oracle("""select request, line, part, contributor, requested, round(clap * 6e-1 + melody * 4e-1, 6) as tune,
      round(vocal * 5e-1 + 5e-1 * 5e-1, 6) as voice from v_submissions"""),
)
def _(spark, d):
    keys = ["request", "line", "part", "contributor", "requested"]

    def pick(*cols):
        def fn(df):
            return df.unpivot(keys, list(cols), "metric", "value")

        return fn

    registry = ScorerRegistry()
    registry.register_scorer("tune", pick("clap", "melody"), {"clap": 0.6, "melody": 0.4})
    registry.register_scorer("voice", pick("vocal"), {"vocal": 0.5, "absent": 0.5}, neutral=True)
    out = registry.score(view(spark, d, "v_submissions"), keys)
    return out.withColumns({"tune": rounded("tune"), "voice": rounded("voice")})


@query(
    "batch_scorer",
    oracle("select seq, round(list_sum(list_transform(vec, lambda x: x * 2e0)), 6) as score from v_vectors"),
)
def _(spark, d):
    score = batch_scorer(spark, lambda w, x: x @ np.full(x.shape[1], w), 2.0)
    return view(spark, d, "v_vectors").select("seq", rounded(score("vec")).alias("score"))


@query(
    "expand_rows",
    oracle("""select id, n, length(w) as size from (select id, unnest(string_split(text, chr(10))) as w,
      unnest(range(0, len(string_split(text, chr(10))))) as n from v_text)"""),
)
def _(spark, d):
    def lines(pdf):
        out = pdf.assign(w=pdf["text"].str.split("\n")).explode("w")
        out["n"] = out.groupby(out.index).cumcount()
        out["size"] = out["w"].str.len()
        return out[["id", "n", "size"]]

    return expand_rows(view(spark, d, "v_text").select("id", "text"), lines, "id long, n long, size long")
