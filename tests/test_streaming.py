"""Streams fed in several batches against the batch operators."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contest_analytics.operators import leaderboard as lb
from contest_analytics.operators import preference as pf
from contest_analytics.plans.adapters import view
from contest_analytics.sources.snapshots import read_snapshot, versions
from contest_analytics.streaming import annotations, sinks, stateful, windows


@pytest.fixture
def fed(spark, sf_dir, tmp_path):
    """Events in time order as four files, one per micro-batch."""

    def make(df, order, parts=4):
        path = str(tmp_path / f"feed{len(list(tmp_path.iterdir()))}")
        n = df.count()
        rows = df.orderBy(order).withColumn("_i", F.monotonically_increasing_id())
        rows = df.sparkSession.createDataFrame(rows.orderBy("_i").toPandas().drop(columns="_i"), df.schema)
        rows = rows.coalesce(1).withColumn("_i", F.monotonically_increasing_id())
        for p in range(parts):
            piece = rows.filter((F.col("_i") >= p * n // parts) & (F.col("_i") < (p + 1) * n // parts))
            piece.drop("_i").coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return make


def test_leaderboard(spark, sf_dir, fed):
    stateful.use_rocksdb(spark)
    v = view(spark, sf_dir, "v_scores").drop("value")
    got = sinks.drain(stateful.stream_leaderboard(fed(v, "micros")), keys=["contributor"])
    want = lb.ema_with_resets(v, ["contributor"], ["micros", "event_id"], "hotkey", "raw")
    a = {r["contributor"]: (round(r["ema"], 9), r["rounds"], r["hotkey"]) for r in got.collect()}
    b = {r["contributor"]: (round(r["ema"], 9), r["rounds"], r["hotkey"]) for r in want.collect()}
    assert a == b


def test_published_snapshots(spark, sf_dir, fed, tmp_path):
    stateful.use_rocksdb(spark)
    v = view(spark, sf_dir, "v_scores").drop("value").withColumn("hotkey", F.lit("h"))
    path = str(tmp_path / "published")
    board = stateful.stream_leaderboard(fed(v, "micros"))
    sinks.publish_snapshots(board, path, str(tmp_path / "ckpt")).awaitTermination()
    assert len(versions(spark, path)) == 4
    got = {r["contributor"]: (r["rank"], r["ema"]) for r in read_snapshot(spark, path).collect()}
    one = lb.ema(v, ["contributor"], ["micros", "event_id"], "raw").withColumn("contest", F.lit("all"))
    want = {r["contributor"]: (r["rank"], r["ema"]) for r in lb.snapshot(one, ["contest"]).collect()}
    assert got == want


def test_reliability(spark, sf_dir, fed):
    stateful.use_rocksdb(spark)
    v = view(spark, sf_dir, "v_votes").withColumn("agreed", F.col("choice") == "a")
    got = sinks.drain(
        stateful.stream_reliability(fed(v, "ts"), ("ts", "event_id")), keys=["annotator"]
    )
    want = pf.annotator_reliability(v, order=["ts", "event_id"])
    a = {r["annotator"]: (round(r["reliability"], 9), r["votes"]) for r in got.collect()}
    b = {r["annotator"]: (round(r["reliability"], 9), r["votes"]) for r in want.collect()}
    assert a == b


def test_dedup_across_batches(spark, sf_dir, fed):
    v = view(spark, sf_dir, "v_scores").select("event_id", "micros")
    doubled = v.unionAll(v.filter("event_id % 2 = 0"))
    out = windows.stream_dedup(windows.timed(fed(doubled, "micros")), "event_id")
    rows = sinks.drain(out.select("event_id"), mode="append")
    assert rows.count() == v.count() == rows.distinct().count()


def test_nonresponders(spark, fed):
    minute, day0 = 60_000_000, 1_700_000_000_000_000
    asked = spark.createDataFrame([(k, day0 + k * minute) for k in range(200)], "k long, micros long")
    replies = spark.createDataFrame(
        [(k, day0 + k * minute + 5 * minute, 0.5) for k in range(200) if k % 3 == 0]
        + [(k, day0 + k * minute + 90 * minute, 0.9) for k in range(200) if k % 3 == 1]
        + [(1000 + i, day0 + (400 + i) * minute, 0.0) for i in range(3)],
        "k long, micros long, score double",
    )
    late = spark.createDataFrame([(2000 + i, day0 + (400 + i) * minute) for i in range(3)], "k long, micros long")
    out = windows.stream_nonresponders(
        windows.timed(fed(asked.unionAll(late), "micros")).select("k", "ts"),
        windows.timed(fed(replies, "micros")).select("k", "ts", "score"),
        ["k"],
    )
    got = {r["k"]: r["score"] for r in sinks.drain(out, mode="append").collect()}
    assert {k: got[k] for k in range(200)} == {k: 0.5 if k % 3 == 0 else 0.0 for k in range(200)}


def test_every_assignment_is_settled_once(spark, fed):
    minute, day0 = 60_000_000, 1_700_000_000_000_000
    asked = spark.createDataFrame([(k, day0 + k * minute) for k in range(50)], "k long, micros long")
    answers = [(k, day0 + (k + wait) * minute, wait / 100.0) for k in range(50) for wait in (7, 5, 90)[: k % 4]]
    replies = spark.createDataFrame(answers, "k long, micros long, score double")
    side = lambda df: windows.timed(df).drop("micros")
    out = windows.stream_nonresponders(side(fed(asked, "micros")), side(fed(replies, "micros")), ["k"])
    matched = sinks.drain(out, mode="append")
    rows = windows.settle(matched, side(asked), side(replies), ["k"], "k").collect()
    assert sorted((r["k"], r["score"]) for r in rows) == [(k, [0.0, 0.07, 0.05, 0.05][k % 4]) for k in range(50)]


def test_snapshots_keep_a_minimum_gap(spark, sf_dir, fed, tmp_path):
    stateful.use_rocksdb(spark)
    v = view(spark, sf_dir, "v_scores").drop("value").withColumn("hotkey", F.lit("h"))
    path = str(tmp_path / "published")
    board = stateful.stream_leaderboard(fed(v, "micros"))
    sinks.publish_snapshots(
        board, path, str(tmp_path / "ckpt"), gap=3, clock=lambda batch: batch
    ).awaitTermination()
    assert versions(spark, path) == [0, 3]
    got = {r["contributor"]: r["ema"] for r in read_snapshot(spark, path).collect()}
    one = lb.ema(v, ["contributor"], ["micros", "event_id"], "raw").withColumn("contest", F.lit("all"))
    assert got == {r["contributor"]: r["ema"] for r in lb.snapshot(one, ["contest"]).collect()}
    # A replay with another checkpoint leaves complete versions as they are.
    before = read_snapshot(spark, path).first()
    again = stateful.stream_leaderboard(fed(v, "micros"))
    sinks.publish_snapshots(again, path, str(tmp_path / "again"), clock=lambda batch: batch).awaitTermination()
    assert 3 in versions(spark, path) and read_snapshot(spark, path, before=4).first() == before


def test_window_distance_keeps_fifty(spark, sf_dir, fed):
    stateful.use_rocksdb(spark)
    v = view(spark, sf_dir, "v_vectors").withColumn("contributor", F.lit(1))
    out = stateful.stream_window_distance(fed(v, "seq"), None)
    row = sinks.drain(out, keys=["contributor"]).first()
    assert row["n"] == 50 and row["distance"] is None and row["penalty"] == 1.0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.1]), max_size=70), st.floats(0.1, 1), st.booleans())
def test_fold_without_a_loop(gains, start, clipped):
    low, r = (0.1 if clipped else -np.inf), start
    for g in gains:
        r = max(0.9 * r + g, low)
    assert stateful.clipped_fold(start, np.array(gains), 0.9, low) == pytest.approx(r, abs=1e-12)


DAY, START = 86_400_000_000, 1_700_000_000_000_000


def plain_reliability(votes):
    """Final winners of all votes, then each annotator's fold in the order of the votes."""
    sides = {}
    for pair, _, choice, _, _ in votes:
        sides.setdefault(pair, []).append(choice)
    winner = {p: annotations.decide(c.count("a"), c.count("b"), 0.6) for p, c in sides.items()}
    state = {}
    for pair, who, choice, _, _ in sorted(votes, key=lambda v: (v[3], v[4])):
        if winner[pair]:
            r, n = state.get(who, (1.0, 0))
            state[who] = (max(0.1 * (choice == winner[pair]) + 0.9 * r, 0.1), n + 1)
    return state


@pytest.mark.parametrize("batches", [1, 4])
def test_annotations_follow_winners_that_change(spark, batches):
    """Votes come in any order of time; winners appear, flip and vanish between batches."""
    stateful.use_rocksdb(spark)
    rng = np.random.default_rng(batches)
    rows = [
        (int(rng.integers(0, 25)), int(rng.integers(0, 9)), "ab"[int(rng.random() < 0.5)], START + int(rng.integers(0, 20)) * DAY, n)
        for n in range(400)
    ]
    votes = spark.createDataFrame(rows, "pair long, annotator long, choice string, ts long, event_id long")
    shuffled = votes.withColumn("arrives", F.pmod(F.xxhash64("event_id"), F.lit(1000)))
    fed = sinks.feed(shuffled, "arrives", batches, files=2).drop("arrives")
    out = sinks.drain(annotations.stream_annotations(fed, keep=100 * 86_400, delay="100 days"), mode="append", keys=["annotator"])
    got = {r["annotator"]: (r["reliability"], r["votes"], r["open"]) for r in out.collect()}
    want = plain_reliability(rows)
    assert {a: (pytest.approx(r), n) for a, (r, n) in want.items()} == {a: g[:2] for a, g in got.items() if g[1]}
    assert sum(g[2] for g in got.values()) == len(rows)


def test_annotations_close_and_forget(spark):
    """State holds only the pairs that are still open, and an old pair that comes back is a new one."""
    stateful.use_rocksdb(spark)
    rng = np.random.default_rng(1)
    rows = [(day * 10 + n % 5, n % 4, "ab"[int(rng.random() < 0.4)], START + day * DAY + n, day * 100 + n) for day in range(40) for n in range(30)]
    votes = spark.createDataFrame(rows, "pair long, annotator long, choice string, ts long, event_id long")
    fed = sinks.feed(votes, "ts", 20, files=1)
    changes = sinks.drain(annotations.stream_annotations(fed, keep=86_400, delay="1 day"), mode="append")
    assert changes.agg(F.max("open")).first()[0] < 0.25 * len(rows) / 4
    last = changes.orderBy("annotator", F.desc(F.col("votes"))).dropDuplicates(["annotator"])
    assert {r["annotator"]: r["votes"] for r in last.collect()} == {a: n for a, (_, n) in plain_reliability(rows).items()}


def test_annotators_of_empty_streams(spark):
    stateful.use_rocksdb(spark)
    votes = spark.createDataFrame([], "pair long, annotator string, choice string, ts long, event_id long")
    out = annotations.stream_annotations(sinks.feed(votes, "ts", 1))
    assert out.columns == ["annotator", "reliability", "votes", "open"] and out.isStreaming


def test_votes_of_many_annotators_share_a_group():
    """A vote is as first settled, or else as told last; annotators meet in far fewer groups than there are of them."""
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(0, 6)), int(rng.integers(0, 4)), int(rng.integers(-1, 2)), bool(rng.random() < 0.3)) for _ in range(200)]
    held, seen = {}, set()
    for ts, event_id, agreed, settled in rows:
        if not held.get((ts, event_id), (0, False))[1]:
            held[ts, event_id] = (agreed, settled)
        seen.add((ts, event_id))
    votes = np.array(rows, annotations.HELD)
    got = annotations._merged(annotations._merged(votes[:0], votes[:120]), votes[120:])
    assert [tuple(v) for v in got.tolist()] == [(*k, *held[k]) for k in sorted(seen)]
    assert annotations.BUCKETS <= 4096
