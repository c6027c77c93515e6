"""Queries over embeddings, and known-content matching over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from contest_analytics.functions.curves import rounded
from contest_analytics.functions.vectors import norm
from contest_analytics.operators import embeddings as em
from contest_analytics.plans.adapters import oracle, table, view
from contest_analytics.plans.registry import query

UNIT = """select *, list_transform(vec, lambda x: x / (sqrt(list_dot_product(vec, vec)) + 1e-8)) as u from v_vectors"""
UNIT1 = """select *, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) as u from v_vectors"""


@query(
    "normalize_vectors",
    oracle("""select seq, contributor, round(u[1], 6) as first, round(sqrt(list_dot_product(u, u)), 6) as length
      from (select seq, contributor, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from (
        select seq, contributor, case when seq % 9 = 0 then null when seq % 9 = 1
          then list_transform(vec, lambda x: x * 1e-10) else list_transform(vec, lambda x: x * 3e0) end as v
        from v_vectors) where v is not null and list_dot_product(v, v) >= 1e-16)"""),
)
def _(spark, d):
    m = F.col("seq") % 9
    v = view(spark, d, "v_vectors").withColumn(
        "vec",
        F.when(m == 0, None)
        .when(m == 1, F.transform("vec", lambda x: x * 1e-10))
        .otherwise(F.transform("vec", lambda x: x * 3.0)),
    )
    out = em.normalize_vectors(v)
    return out.select(
        "seq", "contributor", rounded(F.col("vec")[0]).alias("first"), rounded(norm("vec")).alias("length")
    )


def neighbours(spark, d):
    v = view(spark, d, "v_vectors")
    other = v.select((F.col("seq") - 1).alias("seq"), F.col("vec").alias("other"))
    return v.join(other, "seq")


@query(
    "cosine_score",
    oracle(
        """select a.seq, round(greatest(0e0, least(1e0, (list_dot_product(a.u, b.u) - 5e-2) / 5e-1)), 6) as score
        from h_u a join h_u b on b.seq = a.seq + 1""",
        h_u=UNIT1,
    ),
)
def _(spark, d):
    return neighbours(spark, d).select("seq", rounded(em.cosine_score("vec", "other")).alias("score"))


OWN = """select a.seq, coalesce(avg(case when b.u is not null then greatest(0e0, least(1e0, 1e0 - list_dot_product(a.u, b.u))) end), 5e-1) as own
  from h_i a left join h_i b on a.contributor = b.contributor and b.i between a.i - 50 and a.i - 1 group by a.seq"""
POP = """select a.seq, coalesce(avg(case when b.u is not null then greatest(0e0, least(1e0, 1e0 - list_dot_product(a.u, b.u))) end), 5e-1) as pop
  from h_u a left join h_u b on a.batch = b.batch and a.contributor <> b.contributor group by a.seq"""
DIV = {
    "h_u": UNIT,
    "h_i": "select *, row_number() over (partition by contributor order by seq) as i from h_u",
    "h_own": OWN,
    "h_pop": POP,
}


@query(
    "history_diversity",
    oracle("select seq, round(own, 6) as own_diversity from h_own", **DIV),
)
def _(spark, d):
    out = em.history_diversity(view(spark, d, "v_vectors"), "contributor", ["seq"])
    return out.select("seq", rounded("own_diversity").alias("own_diversity"))


@query(
    "population_diversity",
    oracle("select seq, round(pop, 6) as population_diversity from h_pop", **DIV),
)
def _(spark, d):
    out = em.population_diversity(view(spark, d, "v_vectors"), "batch", "contributor", "seq")
    return out.select("seq", rounded("population_diversity").alias("population_diversity"))


@query(
    "diversity",
    oracle(
        """select seq, round(greatest(0e0, least(1e0, 7e-1 * own + 3e-1 * pop)), 6) as diversity
        from h_own join h_pop using (seq)""",
        **DIV,
    ),
)
def _(spark, d):
    out = em.diversity(view(spark, d, "v_vectors"), "contributor", "batch", ["seq"], "seq")
    return out.select("seq", rounded("diversity").alias("diversity"))


def reference(spark, d):
    """Moments of the vectors of labels 0..4: the reference distribution."""
    return em.fit_distribution(view(spark, d, "v_vectors").filter("contributor < 5"))


ENTRIES = """select seq, unnest(u) as x, unnest(range(1, len(u) + 1)) as i from h_u where contributor < 5"""


@query(
    "fit_distribution",
    oracle(
        """select a.i, b.i as j, round(covar_samp(a.x, b.x) + case when a.i = b.i then 1e-6 else 0e0 end, 6) as cov,
        count(*) as n from h_e a join h_e b using (seq) group by a.i, b.i""",
        h_u=UNIT1,
        h_e=ENTRIES,
    ),
)
def _(spark, d):
    rows = reference(spark, d).select("n", F.posexplode("cov").alias("i", "row"))
    return rows.select("n", "i", F.posexplode("row").alias("j", "cov")).select(
        (F.col("i") + 1).cast("long").alias("i"),
        (F.col("j") + 1).cast("long").alias("j"),
        rounded("cov").alias("cov"),
        "n",
    )


@query(
    "vector_moments",
    oracle(
        "select i, round(avg(x), 6) as mean, count(*) as n from h_e group by i",
        h_e="select unnest(vec) as x, unnest(range(1, len(vec) + 1)) as i from v_vectors",
    ),
)
def _(spark, d):
    m = em.vector_moments(view(spark, d, "v_vectors"))
    return m.select("n", F.posexplode("mean").alias("i", "mean")).select(
        (F.col("i") + 1).cast("long").alias("i"), rounded("mean").alias("mean"), "n"
    )


@query(
    "vector_covariance",
    oracle(
        """select a.i, b.i as j, round(covar_samp(a.x, b.x), 6) as cov, count(*) as n from h_e a join h_e b using (seq)
          group by a.i, b.i""",
        h_e="select seq, unnest(vec) as x, unnest(range(1, len(vec) + 1)) as i from v_vectors",
    ),
)
def _(spark, d):
    m = em.vector_moments(view(spark, d, "v_vectors")).select("n", F.posexplode("cov").alias("i", "row"))
    return m.select("n", "i", F.posexplode("row").alias("j", "cov")).select(
        (F.col("i") + 1).cast("long").alias("i"), (F.col("j") + 1).cast("long").alias("j"), rounded("cov").alias("cov"), "n"
    )


@query("frechet_distance")
def _(spark, d):
    out = em.frechet_distance(
        view(spark, d, "v_vectors"), reference(spark, d), "contributor", ["seq"]
    )
    return out.select("contributor", "n", rounded("distance").alias("distance"))


#: Moments of unit vectors in the plane. The root of a 2 x 2 matrix M with roots of its own has the
#: trace sqrt(tr M + 2 sqrt(det M)), so the distance of two normal distributions has a closed form.
PLANE = "select * replace ([vec[1], vec[2]] as vec) from v_vectors"


def plane_moments(rows: str, key: str) -> str:
    return f"""select {key} as k, count(*) as n, avg(x) as mx, avg(y) as my, var_samp(x) + 1e-6 as a, var_samp(y) + 1e-6 as b,
      covar_samp(x, y) as c from (select {key}, vec[1] / sqrt(vec[1] ** 2 + vec[2] ** 2) as x, vec[2] / sqrt(vec[1] ** 2 + vec[2] ** 2) as y
      from {rows}) group by {key}"""


PLANE_DISTANCE = """greatest(0e0, (p.mx - r.mx) ** 2 + (p.my - r.my) ** 2 + p.a + p.b + r.a + r.b - 2e0 * sqrt(
  p.a * r.a + 2e0 * p.c * r.c + p.b * r.b + 2e0 * sqrt(greatest(0e0, (p.a * p.b - p.c * p.c) * (r.a * r.b - r.c * r.c)))))"""
PLANE_H = {
    "h_last": plane_moments("h_recent", "contributor"),
    "h_recent": "select * from h_plane qualify row_number() over (partition by contributor order by seq desc) <= 50",
    "h_ref": plane_moments("(select *, 0 as one from h_plane where contributor < 5)", "one"),
    "h_plane": PLANE,
}


def plane(spark, d):
    return view(spark, d, "v_vectors").withColumn("vec", F.slice("vec", 1, 2))


def plane_reference(spark, d):
    return em.fit_distribution(plane(spark, d).filter("contributor < 5"))


@query(
    "frechet_distance_plane",
    oracle(
        f"""select p.k as contributor, p.n, round(case when p.n >= 10 and r.n >= 10 then {PLANE_DISTANCE} end, 6) as distance
          from h_last p cross join h_ref r""",
        **PLANE_H,
    ),
)
def _(spark, d):
    out = em.frechet_distance(plane(spark, d), plane_reference(spark, d), "contributor", ["seq"])
    return out.select("contributor", "n", rounded("distance").alias("distance"))


@query(
    "distance_penalty",
    oracle("""select id, round(case when id % 6 = 0 then 1e0 else
      5e-1 + 5e-1 / (1e0 + pow(size / 15e0, 2)) end, 6) as penalty from v_levels"""),
)
def _(spark, d):
    x = F.when(F.col("id") % 6 != 0, F.col("size").cast("double"))
    return view(spark, d, "v_levels").select("id", rounded(em.distance_penalty(x)).alias("penalty"))


@query(
    "label_presence",
    oracle(
        """select v.seq as item, round(case when v.seq % 4 = 0 then 5e-1 else avg(case when
          greatest(0e0, least(1e0, (list_dot_product(v.u, l.u) - 5e-2) / 5e-1)) > 25e-2 then 1e0 else 0e0 end) end, 6) as presence
        from h_u v join (select contributor as label, u, row_number() over (partition by contributor order by seq) as r
          from h_u) l on l.r = 1 and (v.seq % 4 = 0 or l.label in (v.contributor, (v.contributor + 1) % 10, (v.contributor + 2) % 10))
        group by v.seq""",
        h_u=UNIT1,
    ),
)
def _(spark, d):
    v = view(spark, d, "v_vectors")
    labels = v.groupBy(F.col("contributor").alias("label")).agg(F.min_by("vec", "seq").alias("vec"))
    c = F.col("contributor")
    asked = v.select(
        F.col("seq").alias("item"),
        "vec",
        F.when(F.col("seq") % 4 != 0, F.array(c, (c + 1) % 10, (c + 2) % 10)).alias("labels"),
    )
    return em.label_presence(asked, labels).withColumn("presence", rounded("presence"))


@query(
    "sequence_coherence",
    oracle(
        """select contributor, round(avg(list_dot_product(u, p)), 6) as coherence from (
          select *, lag(u) over (partition by contributor order by seq) as p from h_u) group by contributor""",
        h_u=UNIT1,
    ),
)
def _(spark, d):
    out = em.sequence_coherence(view(spark, d, "v_vectors"), "contributor", ["seq"])
    return out.withColumn("coherence", rounded("coherence"))


@query(
    "activation_strength",
    oracle("""select contributor, round(avg(sqrt(list_dot_product(vec, vec))), 6) as strength
      from v_vectors group by contributor"""),
)
def _(spark, d):
    out = em.activation_strength(view(spark, d, "v_vectors"), "contributor")
    return out.withColumn("strength", rounded("strength"))


@query(
    "group_agreement",
    oracle(
        """select a.contributor, round(avg(list_dot_product(a.m, b.m) / sqrt(list_dot_product(a.m, a.m) * list_dot_product(b.m, b.m))), 6) as agreement
        from h_m a join h_m b on a.contributor = b.contributor and a.layer < b.layer group by a.contributor""",
        h_m="""select contributor, layer, list(x order by i) as m from (
          select contributor, layer, i, avg(x) as x from (
            select contributor, seq % 5 as layer, unnest(vec) as x, unnest(range(1, len(vec) + 1)) as i from v_vectors)
          group by contributor, layer, i) group by contributor, layer""",
    ),
)
def _(spark, d):
    v = view(spark, d, "v_vectors").withColumn("layer", F.col("seq") % 5)
    return em.group_agreement(v, "contributor", "layer").withColumn("agreement", rounded("agreement"))


@query(
    "sequence_periodicity",
    oracle(
        """select contributor, round(max(m), 6) as periodicity from (
          select a.contributor, b.i - a.i as lag, avg(list_dot_product(a.u, b.u)) as m, any_value(a.t) as t
          from h_i a join h_i b on a.contributor = b.contributor and b.i > a.i group by a.contributor, b.i - a.i)
        where lag < t // 2 and t >= 8 group by contributor""",
        h_u=UNIT1,
        h_i="""select *, row_number() over (partition by contributor order by seq) as i,
          count(*) over (partition by contributor) as t from h_u""",
    ),
)
def _(spark, d):
    out = em.sequence_periodicity(view(spark, d, "v_vectors"), "contributor", ["seq"])
    return out.withColumn("periodicity", rounded("periodicity"))


@query(
    "calibrate",
    oracle("""select contest as metric, count(*) as n, round(avg(raw), 6) as mean, round(stddev_pop(raw), 6) as std,
      round(quantile_cont(raw, 0.5), 6) as median, min(raw) as min, max(raw) as max,
      round(quantile_cont(raw, 0.5), 6) as center,
      round(1e0 / (2e0 * pow(greatest(stddev_pop(raw), 1e-6), 2)), 4) as width from v_scores group by contest"""),
)
def _(spark, d):
    v = view(spark, d, "v_scores").select(F.col("contest").alias("metric"), F.col("raw").alias("value"))
    out = em.calibrate(v)
    return out.withColumns(
        {**{c: rounded(c) for c in ("mean", "std", "median", "center")}, "width": rounded("width", 4)}
    )


@query(
    "dual_vectors",
    oracle("""select a.seq, len(list_concat(a.vec, b.vec)) as size, round(list_sum(list_concat(a.vec, b.vec)), 6) as total
      from v_vectors a join v_vectors b on b.seq = a.seq where a.seq % 3 <> 0 and b.seq % 5 <> 0"""),
)
def _(spark, d):
    v = view(spark, d, "v_vectors")
    out = em.dual_vectors(v.filter("seq % 3 <> 0"), v.filter("seq % 5 <> 0"), "seq")
    whole = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    return out.select("seq", F.size("vec").cast("long").alias("size"), rounded(whole).alias("total"))


@query(
    "fingerprint_hash",
    oracle("""select id, substr(sha256(unhex(array_to_string(list_transform(fp[1:64],
        lambda n: lpad(hex(n), 8, '0')), ''))), 1, 16) as hash
      from (select id, list_transform(string_split(text, ' '), lambda w: length(w)) as fp from v_text)"""),
)
def _(spark, d):
    fp = F.transform(F.split("text", " "), lambda w: F.length(w))
    return view(spark, d, "v_text").select("id", em.fingerprint_hash(fp).alias("hash"))


@query(
    "known_content_penalty",
    oracle(
        """select d.id, m.best as best_match, case when m.best is null then 1e0 else 0e0 end as penalty
        from v_text d left join (select id, round(max(c), 6) as best from (
          select g.id, i.item, count(*) * 1e0 / any_value(s.n) as c from h_doc g
          join h_item i on i.t = g.t join (select item, count(*) as n from h_item group by item) s on s.item = i.item
          group by g.id, i.item) where c >= 0.8::double group by id) m on m.id = d.id""",
        h_doc="""select distinct id, array_to_string(w[i:i + 4], ' ') as t from (
          select id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from (
            select id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') as w from v_text))""",
        h_item="""select distinct item, array_to_string(w[i:i + 4], ' ') as t from (
          select item, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from (
            select item_id as item, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') as w from benchmark))""",
    ),
)
def _(spark, d):
    items = table(spark, d, "benchmark").withColumnRenamed("item_id", "item")
    out = em.known_content_penalty(view(spark, d, "v_text"), items)
    return out.withColumn("best_match", rounded("best_match"))
