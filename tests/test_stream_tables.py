"""Tables that a stream reads: one file, or a folder of files."""

from __future__ import annotations

import pytest

from __spark_entry__ import queries


@pytest.mark.parametrize("files", [1, 3])
def test_window_distance_of_a_folder(spark, sf_dir, tmp_path, files):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    table.repartition(files).write.parquet(f"{tmp_path}/embeddings.parquet")
    run = queries()["stream_window_distance"]
    got, want = run(spark, str(tmp_path)).collect(), run(spark, sf_dir).collect()
    assert sorted((r.contributor, r.n) for r in got) == sorted((r.contributor, r.n) for r in want)
