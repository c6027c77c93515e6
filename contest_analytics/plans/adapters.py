"""Operator inputs derived from the driver's tables.

Each view is a list of expressions over one table, written so that Spark and
DuckDB read them alike (integer arithmetic, casts, 1e3-style doubles); where a
function differs between the two, the view gives both spellings.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from contest_analytics import config as C

PRIMES = [101, 103, 107, 109, 113, 127, 131, 137, 139, 149, 151, 157, 163, 167, 173, 179]


def _k(engine: str) -> str:
    found = "regexp_extract(props, '([0-9]+)', 1)"
    return f"cast({found} as bigint)"


def _views(engine: str) -> dict[str, tuple[str, list[str]]]:
    spark = engine == "spark"
    micros = (
        "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
        if spark
        else "epoch_us(ts)"
    )
    seconds = f"cast(floor({micros} / 1e6) as bigint)"
    day = f"cast(floor({micros} / 86400e6) as bigint)"
    month = "date_format(o_orderdate, 'yyyy-MM')" if spark else "strftime(o_orderdate, '%Y-%m')"
    doubles = "cast(embedding as array<double>)" if spark else "cast(embedding as double[])"
    # All numbers of a vector folded into twelve: sums of squares by position modulo 12.
    folded = (
        f"transform(sequence(0, 11), i -> aggregate(transform({doubles}, (x, j) -> if(j % 12 = i, x * x, 0D)),"
        " 0D, (s, y) -> s + y))"
        if spark
        else f"list_transform(range(0, 12), lambda i: list_sum(list_transform({doubles}, lambda x, j:"
        " case when (j - 1) % 12 = i then x * x else 0e0 end)))"
    )
    mapped = (
        "transform({1}, x -> {0})" if spark else "list_transform({1}, lambda x: {0})"
    )
    signals = [
        f"((l_partkey * {p}) % 1000) / 1e3 as {s}" for s, p in zip(C.SIGNALS, PRIMES)
    ]
    return {
        "v_scores": (
            "events",
            [
                "user_id as contributor",
                "event_id",
                f"{micros} as micros",
                f"{seconds} as sec",
                f"{day} as day",
                "least(value / 5e2, 1e0) as raw",
                "value",
                f"{_k(engine)} as latency",
                "event_type <> 'error' as ok",
                "event_type = 'error' as is_error",
                "event_type as contest",
                f"concat(cast(user_id as varchar(20)), '-', cast(cast(floor(({day} - 19723) / 10e0)"
                " as bigint) as varchar(20))) as hotkey",
            ],
        ),
        "v_submissions": (
            "lineitem",
            [
                "l_orderkey as request",
                "l_linenumber as line",
                "l_suppkey as contributor",
                "l_partkey as part",
                "l_quantity as requested",
                "l_quantity * (4e-1 + 12e0 * abs(l_discount)) as actual",
                "l_quantity * abs(l_tax) * 1e2 as elapsed",
                "l_partkey % 5 = 0 as vocals",
                "case when l_partkey % 7 = 0 then null else 5e-1 + (l_partkey % 40) / 1e2 end"
                " as accuracy",
                "l_partkey % 11 = 0 as bootstrap",
                "((l_partkey * 107) % 1000) / 1e3 as artifact_penalty",
                "5e-1 + ((l_suppkey * 31) % 500) / 1e3 as fad_penalty",
                "case when l_partkey % 50 = 0 then 0e0 else 1e0 end as fingerprint_penalty",
                "((l_partkey * 13) % 100) / 1e3 as rms",
                "((l_partkey * 17) % 100) / 1e2 as peak",
                "(l_partkey * 29) % 3000 as size",
                *signals,
            ],
        ),
        "v_nodes": (
            "supplier",
            [
                "s_suppkey as uid",
                "s_name as hotkey",
                "s_acctbal as stake",
                "s_nationkey % 2 = 0 as permit",
                "s_suppkey % 5 <> 0 as serving",
                "s_acctbal as incentive",
            ],
        ),
        "v_orders": (
            "orders",
            [
                f"{month} as publication",
                "o_custkey as key",
                "o_totalprice as price",
                "o_orderkey as request",
                "o_orderpriority as priority",
            ],
        ),
        "v_vectors": (
            "embeddings",
            [
                "vec_id as seq",
                "label as contributor",
                "cast(floor(vec_id / 10e0) as bigint) as batch",
                f"{doubles} as vec",
            ],
        ),
        "v_levels": (
            "part",
            [
                "p_partkey as id",
                "p_size / 50e0 as x",
                "p_type as tag",
                "p_name as name",
                "p_size * 8 as tempo",
                "p_size * 5e0 as duration",
                "p_size as size",
            ],
        ),
        "v_text": ("documents", ["doc_id as id", "text", "lang as tag", "n_chars"]),
        "v_turns": (
            "conversations",
            ["conv_id", "turn", "role", "text as words", "text"],
        ),
        "v_votes": (
            "events",
            [
                "event_id % 200 as pair",
                "user_id as annotator",
                f"case when {_k(engine)} % 2 = 0 then 'a' else 'b' end as choice",
                f"{micros} as ts",
                "event_id",
            ],
        ),
        "v_series": (
            "events",
            [
                "user_id as series_id",
                "event_id",
                f"{micros} as micros",
                f"{micros} / 1e6 as t",
                "value as x",
                f"{_k(engine)} * 1e0 as y",
            ],
        ),
        "v_vec_series": (
            "embeddings",
            ["label as series_id", "vec_id", f"{doubles} as vec"],
        ),
        "v_spectra": (
            "embeddings",
            ["label as series_id", "vec_id", f"{mapped.format('abs(x)', doubles)} as vec"],
        ),
        "v_chroma": (
            "embeddings",
            [
                "label as series_id",
                "vec_id",
                f"{folded} as vec",
            ],
        ),
    }


SPARK_VIEWS = _views("spark")
DUCK_VIEWS = {
    name: f"select {', '.join(exprs)} from {table}"
    for name, (table, exprs) in _views("duckdb").items()
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, exprs = SPARK_VIEWS[name]
    return table(spark, sf_dir, source).selectExpr(*exprs)


def oracle(body: str, **extra: str) -> str:
    """Full SQL text: the views and helper relations ``body`` refers to, then ``body``."""
    known = {**DUCK_VIEWS, **extra}
    needed: list[str] = []

    def need(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(known[name])
                if name not in needed:
                    needed.append(name)

    need(body)
    if not needed:
        return body
    # Helpers may come with their own WITH list; they are nested as sub-selects.
    return "with " + ",\n".join(f"{n} as ({known[n]})" for n in needed) + "\n" + body
