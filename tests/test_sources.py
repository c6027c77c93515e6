"""Files: annotation lines, binary scans, state documents, snapshots."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from contest_analytics.operators import leaderboard as lb
from contest_analytics.sources import snapshots, tables


def test_annotations(spark, tmp_path):
    good = {"pair_id": "p1", "audio_a": "s/1/a.wav", "audio_b": "s/1/b.wav", "preferred": "a",
            "timestamp": "2024-05-01T10:00:00"}
    (tmp_path / "a.jsonl").write_text(
        json.dumps(good) + "\n\n" + json.dumps(good)[:20] + "\n"
        + json.dumps({**good, "preferred": "skip", "timestamp": "never"}) + "\n"
    )
    ok, bad = tables.read_annotations(spark, str(tmp_path / "a.jsonl"))
    rows = ok.orderBy("preferred").collect()
    assert [r["preferred"] for r in rows] == ["a", "skip"]
    assert rows[0]["timestamp"].hour == 10 and rows[1]["timestamp"] is None
    assert bad.count() == 1
    assert [r[0] for r in tables.referenced_assets(ok).collect()] == ["s/1/a.wav", "s/1/b.wav"]


def test_scan_files(spark, tmp_path):
    for name in ("b/2.WAV", "a/1.wav", "a/notes.txt", "c/3.flac"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x" * len(name))
    found = [r["path"] for r in tables.scan_files(spark, str(tmp_path), ("wav", ".flac")).collect()]
    assert [f.split("/", 3)[-1][-8:].lstrip("/") for f in found] == sorted(
        f.split("/", 3)[-1][-8:].lstrip("/") for f in found
    )
    assert len(found) == 3
    assert tables.scan_files(spark, str(tmp_path), ("wav",), 1).count() == 1


def test_path_to_key(spark):
    cases = {"storage/3/abc123.wav": "3/abc123", "x.wav": "x", "/a/b.c/d": "b.c/d",
             "q/.hidden": "q/.hidden", "s/t/": "s/t", "s/v1.2.wav": "s/v1.2"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r["p"]: r["k"] for r in df.select("p", tables.path_to_key("p").alias("k")).collect()}
    assert got == cases


def test_rounds_keep_empty(spark, tmp_path):
    docs = [
        {"challenge_id": "c1", "prompt": "p", "genre": "g", "duration_seconds": 5.0,
         "responses": [{"uid": 1, "hotkey": "h", "payload_b64": "eA==", "generation_time_ms": 5}]},
        {"challenge_id": "c2", "prompt": "p", "genre": "g", "duration_seconds": 5.0, "responses": []},
    ]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, docs)))
    out = tables.explode_responses(tables.read_rounds(spark, str(tmp_path / "r.json"), "json"))
    assert {(r["challenge_id"], r["uid"]) for r in out.collect()} == {("c1", 1), ("c2", None)}


STATE = {
    "version": 2,
    "ema": {"1": 0.5, "-2": 0.1, "x": 0.2, "4": 1.5, "5": "bad", "6": 0.25},
    "rounds": {"1": 3, "6": -1},
    "hotkeys": {"1": "hk", "6": ""},
}


def test_state(spark, tmp_path):
    path = tmp_path / "state.json"
    path.write_text(json.dumps(STATE, indent=2))
    ok, rejected = snapshots.load_state(spark, str(path))
    assert {(r["uid"], r["ema"], r["rounds"], r["hotkey"]) for r in ok.collect()} == {
        (1, 0.5, 3, "hk"),
        (6, 0.25, 0, None),
    }
    assert {(r["uid"], r["reason"]) for r in rejected.collect()} == {
        ("-2", "negative_uid"), ("x", "uid"), ("4", "ema_range"), ("5", "ema"),
    }


def test_state_backup_and_version(spark, tmp_path):
    path = tmp_path / "state.json"
    path.write_text("{ not json")
    assert snapshots.load_state(spark, str(path)) is None
    (tmp_path / "state.json.bak").write_text(json.dumps({**STATE, "version": 999}))
    ok, rejected = snapshots.load_state(spark, str(path))
    assert ok.count() == 0
    assert {r["reason"] for r in rejected.collect()} == {"version"}


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "board")
    assert snapshots.read_snapshot(spark, path) is None
    assert snapshots.write_snapshot(spark.range(3), path) == 0
    assert snapshots.write_snapshot(spark.range(5), path) == 1
    assert snapshots.read_snapshot(spark, path).count() == 5
    (tmp_path / "board" / "v000000000001" / "_SUCCESS").unlink()
    assert snapshots.read_snapshot(spark, path).count() == 3


def test_cache_adds_nothing_twice(spark, tmp_path):
    keys = spark.range(6).select(F.col("id").alias("key"))
    path = str(tmp_path / "cache")
    empty = spark.createDataFrame([], "key long, vec array<double>")

    def compute(todo):
        return todo.select("key", F.when(F.col("key") != 4, F.array(F.col("key") * 1.0)).alias("vec"))

    new, failed = tables.cache_missing(keys, empty, compute)
    new.write.parquet(path)
    assert new.count() == 5 and [r[0] for r in failed.collect()] == [4]
    again, failed = tables.cache_missing(keys, spark.read.parquet(path), compute)
    assert again.count() == 0 and failed.count() == 1


def test_identity_reset_and_first_sighting(spark):
    rows = [(1, 1, "a", 1.0), (1, 2, "a", 1.0), (1, 3, "b", 0.5), (2, 1, "z", 1.0)]
    df = spark.createDataFrame(rows, "k int, t int, h string, x double")
    got = {r["k"]: r for r in lb.ema_with_resets(df, ["k"], ["t"], "h", "x").collect()}
    assert got[1]["rounds"] == 1 and abs(got[1]["ema"] - 0.1) < 1e-12 and got[1]["resets"] == 1
    assert got[2]["resets"] == 0 and abs(got[2]["ema"] - 0.2) < 1e-12


def test_python_stages_run_from_another_folder(tmp_path):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = """
from pyspark.sql import SparkSession
from contest_analytics.operators import gates
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
rows = spark.createDataFrame([("a b c", "a x c")], "ref string, hyp string")
assert abs(gates.word_error_rate(rows).first().wer - 1 / 3) < 1e-9
"""
    env = {**os.environ, "PYTHONPATH": root}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=180)


def test_round_tree(spark, tmp_path):
    for name in ("c1/7.wav", "c1/8.mp3", "c1/notes.txt", "c2/9.wav", "c2/x.wav", "challenge=c3/uid=10/part-0.wav"):
        p = tmp_path / "tree" / name
        p.parent.mkdir(exist_ok=True, parents=True)
        p.write_bytes(name.encode())
    (tmp_path / "tree/c1/metadata.json").write_text(json.dumps({"prompt": "p", "genre": "g", "duration_seconds": 3, "mood": "m"}, indent=2))
    (tmp_path / "tree/c1/older.json").write_text(json.dumps({"prompt": "second"}))
    (tmp_path / "tree/challenge=c3/metadata.json").write_text(json.dumps({"prompt": "q"}))
    rows = tables.read_round_tree(spark, str(tmp_path / "tree")).collect()
    got = {(r["challenge_id"], r["uid"]): (r["prompt"], r["genre"], r["duration_seconds"], bytes(r["payload"]).decode()) for r in rows}
    assert got == {
        ("c1", 7): ("p", "g", 3.0, "c1/7.wav"),
        ("c1", 8): ("p", "g", 3.0, "c1/8.mp3"),
        ("c2", 9): (None, None, None, "c2/9.wav"),
        ("c2", None): (None, None, None, "c2/x.wav"),
        ("c3", 10): ("q", None, None, "challenge=c3/uid=10/part-0.wav"),
    }
    assert all(r["length"] == len(r["payload"]) for r in rows)
