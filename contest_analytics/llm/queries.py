"""Registered queries of this package; each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contest_analytics.llm import (
    ann,
    bpe,
    hard_negatives,
    langid,
    merkle,
    packing,
    quality,
    quality_rules,
    secret_scan,
    sharding,
    simhash,
    toxicity,
    vector_codes,
)
from contest_analytics.llm.common import read

#: The tokenizer file of the packing and encoding queries; it is never copied.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_check(read(spark, sf_dir, "documents"))


#: Shards of the sharding query.
SHARDS = [f"shard-{n:03d}" for n in range(128)]


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document goes: ``doc_id``, ``slot``, ``shard``."""
    return sharding.place(read(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SHARDS)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), TOKENIZER)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), TOKENIZER)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label is moved on, so that some of the best rows have another label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_ann": op2_ann,
    "op3_merkle": op3_merkle,
    "op4_sharding": op4_sharding,
    "op5_secrets": op5_secrets,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_bpe": op8_bpe,
    "op9_quality": op9_quality,
    "op10_langid": op10_langid,
    "op11_vector_codes": op11_vector_codes,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_quality_rules": op13_quality_rules,
}
#: A private-use sign stands for the cuts; the documents hold none.
_CUT = "chr(57344)"
_TREES = f"""
    list_transform(string_split(regexp_replace({{0}}, '(\\n|[[:punct:]] )', '\\1' || {_CUT}, 'g'), {_CUT}), lambda p: sha256(p))"""
_ROOT = """
    sha256(array_to_string(list_transform(string_split(array_to_string(list_transform({0},
      lambda h: case when h < '4' then h || '|' else h end), ''), '|'), lambda s: sha256(s)), ''))"""
_LIKE = """
    case when {0}_root = {1}_root then 1e0 else len(list_distinct(list_intersect({0}_leaves, {1}_leaves)))
      / len(list_distinct(list_concat({0}_leaves, {1}_leaves))) end"""
#: Equal paragraphs from the start, and from the end of what is left.
_ALIKE = "coalesce(list_position([{0}[i] = {1}[i] for i in range(1, least(len({0}), len({1})) + 1)], false) - 1, least(len({0}), len({1})))"
_PAIRED = """
    select doc_id, text, length(text) as n_chars, coalesce(lead(text) over line, first_value(text) over line) as next_text
    from (select doc_id, coalesce(text, '') as text from documents) window line as (order by doc_id nulls last, sha256(text))"""

_SCALED = """
  select vec_id, label, [floor(256 * x::double)::bigint for x in embedding] as c from embeddings
    where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0"""
#: One assignment of all parts to the codebook {0}: the nearest entry, ties to the lower index.
_ASSIGNED = """
  select vec_id, any_value(label) as label, p, any_value(v) as v, min(gap * 64 + entry) as best from (
    select parts.*, b.entry, list_sum([(v[i] - b.w[i]) * (v[i] - b.w[i]) for i in range(1, 5)])::bigint as gap
    from parts join {0} b using (p)) group by vec_id, p"""
#: Floored means of the parts of each entry; entries without parts stay.
_MOVED = """
  select p, entry, coalesce(any_value(m.w), any_value({0}.w)) as w from {0} left join (
    select p, best % 64 as entry, list((s - ((s % n) + n) % n) // n order by i) as w from (
      select p, best, i, sum(v[i])::bigint as s, count(*) as n from (
        select p, best % 64 as best, v, unnest(range(1, 5)) as i from {1}) group by p, best, i) group by p, best) m
    using (p, entry) group by p, entry"""

ORACLES: dict[str, str] = {
    "op11_vector_codes": f"""
  with kept as ({_SCALED}),
  parts as (select vec_id, label, p, c[p * 4 + 1 : p * 4 + 4] as v from kept, (select unnest(range(16)) as p)),
  book0 as (select p, entry, v as w from parts
    join (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept order by vec_id limit 64) using (vec_id)),
  near0 as ({_ASSIGNED.format("book0")}), book1 as ({_MOVED.format("book0", "near0")}),
  near1 as ({_ASSIGNED.format("book1")}), book2 as ({_MOVED.format("book1", "near1")}),
  near2 as ({_ASSIGNED.format("book2")}),
  coded as (select vec_id, any_value(label) as label, string_agg(printf('%02x', best % 64), '' order by p) as code,
    sum(best // 64)::bigint as error from near2 group by vec_id),
  name as (select sha256(string_agg(x::varchar, ',' order by p, entry, i)) as codebooks_sha256 from (
    select p, entry, unnest(w) as x, unnest(range(4)) as i from book2))
  select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
    from coded, name""",
    "op12_hard_negatives": f"""
  with kept as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, c::double[] as c
    from ({_SCALED}) where label is not null),
  scores as (select a.vec_id as anchor_id, o.vec_id, a.label = o.label as same, list_dot_product(a.c, o.c)::bigint as score
    from kept a join kept o on a.vec_id <> o.vec_id where a.vec_id % 50 = 0),
  positives as (select anchor_id, vec_id as positive_id, score as positive_score from scores where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
  select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id)::int
    as rank, vec_id as negative_id, positive_score, score as negative_score
    from positives p join scores s on s.anchor_id = p.anchor_id and not same
      and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
    qualify rank <= 3""",
    "op3_merkle": f"""
  with paired as ({_PAIRED}),
  edits as (select *, substr(text, 1, n_chars - n_chars // 4) || substr(next_text, 1, n_chars // 4) as edited from paired),
  leaves as (select doc_id, n_chars, sha256(edited) as edited_sha256, {_TREES.format("text")} as a_leaves,
    {_TREES.format("edited")} as b_leaves, {_TREES.format("next_text")} as c_leaves from edits),
  roots as (select *, {_ROOT.format("a_leaves")} as a_root, {_ROOT.format("b_leaves")} as b_root,
    {_ROOT.format("c_leaves")} as c_root from leaves),
  fronts as (select *, {_ALIKE.format("a_leaves", "b_leaves")} as front from roots),
  rests as (select *, list_reverse(a_leaves[front + 1 :]) as a_rest, list_reverse(b_leaves[front + 1 :]) as b_rest from fronts),
  ends as (select *, {_ALIKE.format("a_rest", "b_rest")} as back from rests)
  select doc_id, n_chars, edited_sha256, a_root as fingerprint, b_root as edited_fingerprint,
    {_LIKE.format("a", "b")} as near_edited, {_LIKE.format("a", "c")} as near_next,
    case when a_root = b_root then '' else front || ':' || (len(a_rest) - back) || ':' || (len(b_rest) - back) end as edit from ends"""
}
