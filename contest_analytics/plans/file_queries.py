"""Readers of file trees, over a tree that is written from the tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from contest_analytics.plans.adapters import oracle, table
from contest_analytics.plans.registry import query
from contest_analytics.sources import tables as src
from contest_analytics.streaming.sinks import scratch


def round_tree(spark, d):
    """A folder for each region, a file for each of its nations with what its suppliers add up to.

    Regions get a sidecar, but for every third one; notes beside the files are no responses.
    """
    path = scratch(spark, "rounds")
    nations = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    sums = nations.groupBy("n_regionkey", "n_nationkey").agg(
        F.count("s_suppkey").alias("n"), F.coalesce(F.sum(F.round(F.col("s_acctbal") * 100).cast("long")), F.lit(0)).alias("cents")
    )
    files = sums.select(
        F.col("n_regionkey").alias("challenge"), F.col("n_nationkey").alias("uid"), F.concat_ws(":", "n", "cents").alias("value")
    )
    files.write.partitionBy("challenge", "uid").option("extension", "wav").csv(path)
    files.filter("uid % 2 = 0").write.mode("append").partitionBy("challenge", "uid").text(path)
    regions = table(spark, d, "region").filter("r_regionkey % 3 <> 0")
    regions.select(
        F.col("r_regionkey").alias("challenge"),
        F.col("r_name").alias("prompt"),
        F.lower("r_name").alias("genre"),
        (F.col("r_regionkey") * 1.5).alias("duration_seconds"),
    ).write.mode("append").partitionBy("challenge").json(path)
    return path


SUMS = """select n_regionkey, n_nationkey, count(s_suppkey) as n, coalesce(sum(round(s_acctbal * 100)::bigint), 0)::bigint as cents
  from nation left join supplier on n_nationkey = s_nationkey group by all"""


@query(
    "read_round_tree",
    oracle(
        """select n_regionkey::varchar as challenge_id, case when n_regionkey % 3 <> 0 then r_name end as prompt,
          case when n_regionkey % 3 <> 0 then lower(r_name) end as genre, case when n_regionkey % 3 <> 0 then n_regionkey * 15e-1 end as duration_seconds,
          n_nationkey::bigint as uid, n || ':' || cents as content, length(n || ':' || cents) + 1 as length
        from h_sums join region on r_regionkey = n_regionkey""",
        h_sums=SUMS,
    ),
)
def _(spark, d):
    rows = src.read_round_tree(spark, round_tree(spark, d))
    content = F.trim(F.regexp_replace(F.col("payload").cast("string"), "\n", ""))
    return rows.select("challenge_id", "prompt", "genre", "duration_seconds", "uid", content.alias("content"), "length")


@query(
    "scan_files",
    oracle(
        """select kind, count(*) as files, sum(length(n || ':' || cents) + 1)::bigint as bytes from (
          select 'wav' as kind, * from h_sums union all select 'txt', * from h_sums where n_nationkey % 2 = 0
          union all select 'first', * from (select * from h_sums where n_nationkey % 2 = 0
            order by '/challenge=' || n_regionkey || '/uid=' || n_nationkey || '/' limit 5)) group by kind""",
        h_sums=SUMS,
    ),
)
def _(spark, d):
    path = round_tree(spark, d)
    found = [("wav", ["WAV"], None), ("txt", [".txt"], None), ("first", ["txt"], 5)]
    parts = [src.scan_files(spark, path, exts, most).select(F.lit(kind).alias("kind"), "length") for kind, exts, most in found]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
