"""Queries over vector sequences: the embeddings of each label in id order."""

from __future__ import annotations

from pyspark.sql import functions as F

from contest_analytics import config as C
from contest_analytics.operators import series_vectors as ss
from contest_analytics.plans.adapters import oracle, view
from contest_analytics.plans.registry import query
from contest_analytics.plans.series_queries import _clip, tidy

ID = "series_id"
ORDER = ["vec_id"]
BANDS = [(0, 8), (8, 20), (20, 40), (40, 64)]
W = "partition by series_id order by vec_id"


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / (sqrt(list_dot_product({v}, {v})) + 1e-8))"


def _flux(source: str) -> dict[str, str]:
    return {
        "h_flux": f"""select series_id, i, n, list_distance(vec, p) as f from (select *, lag(vec) over ({W}) as p,
          row_number() over ({W}) as i, count(*) over (partition by series_id) as n from {source}) where p is not null"""
    }


@query(
    "discontinuity",
    oracle(
        """select series_id, round(ratio, 6) as ratio, round(case when mad < 1e-10 or n < 3 then 1e0 when ratio <= 1e-1 then 1e0 when ratio >= 4e-1 then 0e0
          else 1e0 - (ratio - 1e-1) / 3e-1 end, 6) as score from (
          select series_id, any_value(mad) as mad, count(*) as n, avg(case when f > med + 1e0 * 14826e-4 * mad then 1e0 else 0e0 end) as ratio from (
            select h_flux.*, med, mad from h_flux join h_med using (series_id) join (
              select series_id, quantile_cont(abs(f - med), 0.5) as mad from h_flux join h_med using (series_id) group by series_id) using (series_id))
          group by series_id)""",
        h_med="select series_id, quantile_cont(f, 0.5) as med from h_flux group by series_id",
        **_flux("v_vec_series"),
    ),
)
def _(spark, d):
    return tidy(ss.discontinuity(view(spark, d, "v_vec_series"), ID, ORDER, k=1.0))


@query(
    "flux_consistency",
    oracle(
        f"""select series_id, round(cv, 6) as cv, round(case when n < 3 or m < 1e-10 then 0e0 else {_clip(
          "case when cv < 5e-2 then 1e-1 when cv < 2e-1 then 1e-1 + 7e-1 * ((cv - 5e-2) / 15e-2) when cv <= 2 then 8e-1 + 2e-1 * least((cv - 2e-1) / 3e-1, 1e0) else greatest(5e-1, 1e0 - (cv - 2) / 4e0) end")} end, 6) as score
        from (select series_id, count(*) as n, avg(f) as m, stddev_pop(f) / avg(f) as cv from h_flux group by series_id)""",
        **_flux("v_spectra"),
    ),
)
def _(spark, d):
    return tidy(ss.flux_consistency(view(spark, d, "v_spectra"), ID, ORDER))


@query(
    "chunk_repetition",
    oracle(
        f"""select series_id, round(ratio, 6) as ratio, round({_clip("1e0 - ratio / 5e-1")}, 6) as score from (
          select c.series_id, case when c.k < 3 then 0e0 else coalesce(r.m, 0) / (c.k * 1e0) end as ratio from (
            select series_id, count(*) // 4 as k from v_series group by series_id) c left join (
            select series_id, count(distinct c) as m from (
              select a.series_id, unnest([a.c, b.c]) as c from h_u a join h_u b on a.series_id = b.series_id and b.c >= a.c + 2
              where list_dot_product(a.u, b.u) > 98e-2) group by series_id) r using (series_id))""",
        h_u="""select series_id, c, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from (
          select series_id, (i - 1) // 4 as c, list(x order by i) as v from (
            select series_id, x, row_number() over (partition by series_id order by micros, event_id) as i from v_series)
          group by 1, 2 having count(*) = 4)""",
    ),
)
def _(spark, d):
    v = view(spark, d, "v_series").select(ID, "micros", "event_id", "x")
    return tidy(ss.chunk_repetition(v, ID, ["micros", "event_id"], chunk=4))


def _windows(source: str, size: int, having: str = "") -> str:
    return f"""select series_id, w, list(x order by j) as m from (
      select series_id, w, j, avg(x) as x, count(*) as k from (
        select series_id, (i - 1) // {size} + 1 as w, unnest(vec) as x, unnest(range(1, len(vec) + 1)) as j from (
          select *, row_number() over ({W}) as i from {source})) group by 1, 2, 3 {having}) group by 1, 2"""


@query(
    "self_similarity_share",
    oracle(
        f"""select series_id, round(case when n >= 2 then r end, 6) as ratio, round(case when n < 2 then 0e0 else {_clip(
          "case when r > 9e-1 then 3e-1 when r < 5e-2 then r / 5e-2 * 4e-1 else exp(-6e0 * (r - 4e-1) * (r - 4e-1)) end")} end, 6) as score from (
          select series_id, n, coalesce(k, 0) / (n * (n - 1) / 2e0) as r from (
            select series_id, count(*) as n from h_w group by series_id) left join (
            select a.series_id, count(*) as k from h_u a join h_u b on a.series_id = b.series_id and a.w < b.w
            where list_dot_product(a.u, b.u) > 9e-1 group by a.series_id) using (series_id))""",
        h_w=_windows("v_chroma", 4, "having count(*) = 4"),
        h_u=f"select *, {_unit('m')} as u from h_w",
    ),
)
def _(spark, d):
    return tidy(ss.self_similarity_share(view(spark, d, "v_chroma"), ID, ORDER, threshold=0.9))


POWER = """select series_id, j, avg(x * x) as p, avg(x) as m from (
  select series_id, unnest(vec) as x, unnest(range(0, len(vec))) as j from v_spectra) group by series_id, j"""


@query(
    "spectral_holes",
    oracle(
        f"""select series_id, round(ratio, 6) as ratio, round(case when ratio < 2e-2 then 1e0 when ratio >= 1e-1 then 5e-1
          else greatest(5e-1, least(1e0, 1e0 - 5e-1 * (ratio - 2e-2) / 8e-2)) end, 6) as score from (
          select series_id, avg(case when 10e0 * log10(greatest(p, 1e-20) / greatest(sm, 1e-20)) < -1e0 then 1e0 else 0e0 end) as ratio from (
            select a.series_id, a.j, any_value(a.p) as p, avg(b.p) as sm from h_p a cross join (select unnest(range(-2, 3)) as o) w
            join h_p b on b.series_id = a.series_id and b.j = case when a.j + o < 0 then -(a.j + o) - 1 when a.j + o >= 64 then 128 - (a.j + o) - 1 else a.j + o end
            group by a.series_id, a.j) group by series_id)""",
        h_p=POWER,
    ),
)
def _(spark, d):
    return tidy(ss.holes(view(spark, d, "v_spectra"), ID, win=5, db=-1.0))


@query(
    "half_similarity",
    oracle(
        f"""select series_id, round(s, 6) as similarity, round({_clip("1e0 - abs(s - 5e-1) / 5e-1")}, 6) as score from (
          select a.series_id, {_clip("avg(list_dot_product(a.u, b.u))")} as s from h_u a join h_u b
            on a.series_id = b.series_id and b.i = a.i + a.n // 2 where a.i <= a.n // 2 group by a.series_id)""",
        h_u=f"""select *, {_unit('vec')} as u, row_number() over ({W}) as i, count(*) over (partition by series_id) as n from v_chroma""",
    ),
)
def _(spark, d):
    return tidy(ss.half_similarity(view(spark, d, "v_chroma"), ID, ORDER))


def _label_sql() -> dict[str, str]:
    rows = ", ".join(f"({i}, '{name}', {t}::double[])" for i, (name, t) in enumerate(ss.triads()))
    return {
        "h_t": f"select * from (values {rows}) as t(i, label, t)",
        "h_l": """select v.series_id, v.vec_id, arg_min(h_t.label, (round(-list_cosine_similarity(v.vec, t), 12), h_t.i)) as label,
          max(list_cosine_similarity(v.vec, t)) as confidence from v_chroma v cross join h_t group by 1, 2""",
    }


@query(
    "classify_template",
    oracle("select series_id, vec_id, label, round(confidence, 6) as confidence from h_l", **_label_sql()),
)
def _(spark, d):
    return tidy(ss.classify_template(view(spark, d, "v_chroma")).drop("vec"))


@query(
    "template_clarity",
    oracle(
        f"select series_id, round({_clip('(avg(confidence) - 5e-1) / 4e-1')}, 6) as score from h_l group by series_id",
        **_label_sql(),
    ),
)
def _(spark, d):
    return tidy(ss.template_clarity(ss.classify_template(view(spark, d, "v_chroma")), ID))


@query(
    "transition_quality",
    oracle(
        f"""select series_id, count(distinct label) as labels, round({_clip('''avg(case when p is null then null when p = label then 7e-1 when rp = rl then 1e0
            when d <= 1 then 1e0 when d <= 2 then 7e-1 when d <= 3 then 5e-1 else 2e-1 end)''')}, 6) as transitions,
          round({_clip("exp(-3e-1 * pow(count(distinct label) * 30e0 / (count(*) * 2e0) - 5e0, 2))")}, 6) as variety from (
          select *, least(abs((rp * 7) % 12 - (rl * 7) % 12), 12 - abs((rp * 7) % 12 - (rl * 7) % 12)) as d from (
            select *, list_position({C.NOTES}, split_part(p, '_', 1)) - 1 as rp, list_position({C.NOTES}, split_part(label, '_', 1)) - 1 as rl from (
              select *, lag(label) over ({W}) as p from h_l))) group by series_id""",
        **_label_sql(),
    ),
)
def _(spark, d):
    labelled = ss.classify_template(view(spark, d, "v_chroma"))
    return tidy(ss.transition_quality(labelled, ID, ORDER, seconds=2.0))


@query(
    "profile_argmax",
    oracle(
        """select series_id, arg_max(name, r) as best, round(max(r), 6) as fit from (
          select h.series_id, p.name, corr(h.x, p.t[h.j]) as r from h_h h cross join h_p p group by 1, 2) group by series_id""",
        h_h="""select series_id, j, sum(x) as x from (select series_id, unnest(vec) as x, unnest(range(1, 13)) as j from v_chroma) group by 1, 2""",
        h_p="select * from (values "
        + ", ".join(
            f"('{n} {m}', {[p[(i - s) % 12] for i in range(12)]}::double[])"
            for s, n in enumerate(C.NOTES)
            for m, p in (("major", C.MAJOR_PROFILE), ("minor", C.MINOR_PROFILE))
        )
        + ") as t(name, t)",
    ),
)
def _(spark, d):
    return tidy(ss.profile_argmax(view(spark, d, "v_chroma"), ID))


PAIRWISE = """select a.series_id, avg(list_cosine_similarity(a.m, b.m)) as g from h_w a join h_w b
  on a.series_id = b.series_id and a.w < b.w group by a.series_id"""


@query(
    "phrase_coherence",
    oracle(
        f"""select series_id, round(g, 6) as agreement, coalesce(round({_clip("(g - 5e-1) / 5e-1")} * 5e-2, 4), 0e0) as bonus
        from (select distinct series_id from v_chroma) left join h_g using (series_id)""",
        h_w=_windows("v_chroma", 8, "having count(*) = 8"),
        h_g=PAIRWISE,
    ),
)
def _(spark, d):
    return tidy(ss.phrase_coherence(view(spark, d, "v_chroma"), ID, ORDER, beats=8))


@query(
    "progression",
    oracle(
        f"""select series_id, dominant, round(s, 6) as similarity, round({_clip(
          "5e-1 * exp(-3e0 * pow(dominant / greatest(2e0, least(12e0, 3e0 * f / 10e0)) - 1e0, 2)) + 5e-1 * exp(-6e0 * pow(s - 6e-1, 2))")}, 6) as score from (
          select series_id, count(distinct list_position(m, list_max(m))) as dominant, avg(list_cosine_similarity(m, p)) as s from (
            select *, lag(m) over (partition by series_id order by w) as p from h_w) group by series_id)
        join (select series_id, count(*) as f from v_chroma group by series_id) using (series_id)""",
        h_w=_windows("v_chroma", 4),
    ),
)
def _(spark, d):
    return tidy(ss.progression(view(spark, d, "v_chroma"), ID, ORDER))


SEGMENTS = f"""select *, (i - 1) // (n // c) as k from (select *, least(8, greatest(4, n // 8)) as c from (
  select *, row_number() over ({W}) as i, count(*) over (partition by series_id) as n from v_chroma)) where (i - 1) // (n // c) < c"""


@query(
    "segment_contrast",
    oracle(
        f"""select series_id, round(r, 6) as contrast, round(g, 6) as agreement, round({_clip(
          "5e-1 * " + _clip("case when r >= 45e-3 then 5e-1 + r * 2e0 else r / (45e-3 + 1e-8) * (5e-1 + 9e-2) end") + " + 5e-1 * exp(-6e0 * pow(g - 6e-1, 2))")}, 6) as score from (
          select series_id, stddev_pop(x) / (avg(x) + 1e-8) as r from (select series_id, k, avg(sqrt(list_sum(list_transform(vec, lambda y: y * y)))) as x from h_s group by 1, 2) group by series_id)
        join h_g using (series_id)""",
        h_s=SEGMENTS,
        h_w="""select series_id, w, list(x order by j) as m from (select series_id, k as w, j, avg(x) as x from (
          select series_id, k, unnest(vec) as x, unnest(range(1, 13)) as j from h_s) group by 1, 2, 3) group by 1, 2""",
        h_g=PAIRWISE,
    ),
)
def _(spark, d):
    v = view(spark, d, "v_chroma").withColumn("x", level("vec"))
    return tidy(ss.segment_contrast(v, ID, ORDER, seconds=0.25))


def level(vec):
    """The length of a vector: its level."""
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, y: s + y * y))


def boundaries(spark, d):
    return ss.section_boundaries(view(spark, d, "v_chroma"), ID, ORDER, k=4, min_gap=4, prominence=0.01)


#: The sections' openings in SQL, from the novelty of unit vectors to the tops that are prominent.
def _boundaries(prominence: str) -> dict[str, str]:
    return {
        "h_open": f"""select series_id, i as idx from (
          select *, (select bool_or(t.v - q.v >= {prominence}::double) from h_nov q where q.series_id = t.series_id and q.i > t.higher and q.i < t.i) as lefts,
            (select bool_or(t.v - q.v >= {prominence}::double) from h_nov q where q.series_id = t.series_id and q.i > t.i and q.i < t.beyond) as rights from (
            select s.series_id, s.i, any_value(s.v) as v, coalesce(max(q.i) filter (q.i < s.i and q.v > s.v), 0) as higher,
              coalesce(min(q.i) filter (q.i > s.i and q.v > s.v), 1000000) as beyond
            from h_apart s join h_nov q using (series_id) group by s.series_id, s.i) t) where lefts and rights and i > 1""",
        "h_apart": """select series_id, i, v from h_tops t where i in (select unnest(stay) from (
          select series_id, list_reduce(list([i] order by v desc, i desc), lambda x, y:
            case when list_min([abs(q - y[1]) for q in x]) >= 4 then list_append(x, y[1]) else x end) as stay
          from h_tops group by series_id) l where l.series_id = t.series_id)""",
        "h_tops": """select series_id, (a + b) // 2 as i, v from (
          select *, lag(v) over w as p, lead(v) over w as q from (
            select series_id, run, min(i) as a, max(i) as b, any_value(v) as v from (
              select *, sum(case when v = before then 0 else 1 end) over (partition by series_id order by i) as run from (
                select *, lag(v) over (partition by series_id order by i) as before from h_nov)) group by series_id, run)
          window w as (partition by series_id order by a)) where p < v and q < v""",
        "h_nov": """select series_id, i, (coalesce(lag(raw) over w, 0) + raw + coalesce(lead(raw) over w, 0)) / 3e0 as v from (
          select series_id, i, case when k >= 2 and i > k and i <= n - k then sum(g * g) / (2e0 * k * k) else 0e0 end as raw from (
            select a.series_id, a.i, a.j, a.n, a.k, sum(case when b.i < a.i then b.x else -b.x end) as g from h_parts a join h_parts b
              on b.series_id = a.series_id and b.j = a.j and b.i >= a.i - a.k and b.i < a.i + a.k group by a.series_id, a.i, a.j, a.n, a.k)
          group by series_id, i, n, k) window w as (partition by series_id order by i)""",
        "h_parts": f"""select series_id, i, n, least(4, n // 2) as k, unnest(u) as x, unnest(range(12)) as j from (
          select series_id, row_number() over ({W}) as i, count(*) over (partition by series_id) as n, {_unit("vec")} as u from v_chroma)""",
    }


#: Rows with the number of openings up to them.
def _sectioned(source: str) -> str:
    return f"""select r.*, (select count(*) from h_open o where o.series_id = r.series_id and o.idx <= r.i) as section from (
      select *, row_number() over ({W}) as i, count(*) over (partition by series_id) as n from {source}) r"""


@query("section_boundaries", oracle("select series_id, idx from h_open", **_boundaries("1e-2")))
def _(spark, d):
    return boundaries(spark, d)


_NEAR = 0.35 * 0.3
_WANT = "greatest(4e0 * f / 3e1, 1e0)"
_LOW = f"greatest(1e0, floor({_WANT} * 5e-1))"
_FILL = "least(1e0, 5e-1 + 5e-1 * least({0} / " + _WANT + ", 15e-1))"


@query(
    "sections",
    oracle(
        f"""select series_id, s as sections, round({_clip(f"case when s >= {_LOW} then {_FILL.format('s')} else s / {_LOW} * {_FILL.format(_LOW)} end")}, 6) as count_score,
          round(case when s < 2 then 25e-2 else {_clip(f"case when 1 - g >= {_NEAR!r}::double then least(1e0, 5e-1 + (1 - g) * 2) else greatest(0e0, (1 - g) / ({_NEAR!r}::double + 1e-8) * 71e-2) end")} end, 6) as variety_score
        from (select series_id, any_value(s) as s, any_value(f) as f, (sum(t * t) - any_value(q)) / (any_value(s) * (any_value(s) - 1e0)) as g from (
          select series_id, j, count(*) as s, any_value(f) as f, sum(x) as t from h_means group by series_id, j)
          join (select series_id, sum(x * x) as q from h_means group by series_id) using (series_id) group by series_id)""",
        h_means="""select series_id, section, j, f, m / (sqrt(sum(m * m) over (partition by series_id, section)) + 1e-8) as x from (
          select series_id, section, j, any_value(n) as f, avg(x) as m from (
            select series_id, section, n, unnest(vec) as x, unnest(range(12)) as j from h_rows) group by series_id, section, j)""",
        h_rows=_sectioned("v_chroma"),
        **_boundaries("5e-2"),
    ),
)
def _(spark, d):
    return tidy(ss.sections(view(spark, d, "v_chroma"), ID, ORDER, k=4, min_gap=4))


@query(
    "edge_sections",
    oracle(
        """select series_id, l + 1 as sections, round(case when l < 2 or m < 1e-8 then 25e-2 when got > 0 then got
            when abs(r0 - m) / (m + 1e-8) > 3e-1 or abs(r1 - m) / (m + 1e-8) > 3e-1 then 3e-1 else 0e0 end, 6) as score from (
          select *, (case when coalesce(r0 / m < 8e-1, false) or (n0 > 8 and e0 > s0 * 13e-1) then 5e-1 else 0e0 end)
              + (case when coalesce(r1 / m < 8e-1, false) or (n1 > 8 and s1 > e1 * 13e-1) then 5e-1 else 0e0 end) as got from (
            select series_id, any_value(last) as l, avg(r) filter (section > 0 and section < last) as m,
              any_value(r) filter (section = 0) as r0, any_value(len) filter (section = 0) as n0,
              any_value(a) filter (section = 0) as s0, any_value(z) filter (section = 0) as e0,
              any_value(r) filter (section = last) as r1, any_value(len) filter (section = last) as n1,
              any_value(a) filter (section = last) as s1, any_value(z) filter (section = last) as e1 from h_spans group by series_id))""",
        h_spans="""select series_id, section, any_value(last) as last, any_value(len) as len, sqrt(avg(x * x)) as r,
            sqrt(avg(x * x) filter (place < len // 4)) as a, sqrt(avg(x * x) filter (place >= len - len // 4)) as z from (
          select *, max(section) over (partition by series_id) as last, count(*) over s as len, i - min(i) over s as place
          from h_levels window s as (partition by series_id, section)) group by series_id, section""",
        h_levels="select series_id, section, i, sqrt(list_dot_product(vec, vec)) as x from h_rows",
        h_rows=_sectioned("v_spectra"),
        **_boundaries("1e-2"),
    ),
)
def _(spark, d):
    v = view(spark, d, "v_spectra").withColumn("x", level("vec"))
    return tidy(ss.edge_sections(v, ID, ORDER, boundaries(spark, d), long=8))


@query(
    "boundary_ratio",
    oracle(
        """select series_id, round(b / med, 6) as ratio,
            round(case when coalesce(n, 0) < 2 or b is null or med < 1e-10 then 25e-2 else 1e0 - least(b / med / 3e0, 1e0) end, 6) as score
          from (select distinct series_id from v_spectra) left join (
            select series_id, count(*) as n, quantile_cont(f, 0.5) as med from h_flux group by series_id) using (series_id) left join (
            select o.series_id, avg(f) as b from (select series_id, least(idx + 1, n) as i from h_open join (
                select series_id, max(i) as n from h_flux group by series_id) using (series_id)) o
              join h_flux f on f.series_id = o.series_id and f.i = o.i group by o.series_id) using (series_id)""",
        **_flux("v_spectra"),
        **_boundaries("1e-2"),
    ),
)
def _(spark, d):
    return tidy(ss.boundary_ratio(view(spark, d, "v_spectra"), ID, ORDER, boundaries(spark, d)))


BANDED = "select *, case when j < 8 then 0 when j < 20 then 1 when j < 40 then 2 else 3 end as b from (select series_id, vec_id, unnest(vec) as x, unnest(range(0, 64)) as j from v_spectra)"
HB = {"h_b": BANDED}


@query(
    "band_balance",
    oracle(
        f"""select series_id, round(cv, 6) as cv, round({_clip("1e0 - abs(cv - 1e0) / 15e-1")}, 6) as score from (
          select series_id, stddev_pop(e) / avg(e) as cv from (select series_id, b, sqrt(avg(x * x)) as e from h_b group by 1, 2) group by series_id)""",
        **HB,
    ),
)
def _(spark, d):
    return tidy(ss.band_balance(view(spark, d, "v_spectra"), ID, BANDS))


@query(
    "band_entropy",
    oracle(
        f"""select series_id, round(e, 6) as entropy, round({_clip("(9e-1 - e) / 6e-1")}, 6) as score from (
          select series_id, quantile_cont(m, 0.5) as e from (select series_id, b, quantile_cont(e, 0.5) as m from (
            select series_id, vec_id, b, -sum(x / s * log2(x / s + 1e-12)) / (log2(count(*)) + 1e-10) as e from (
              select *, sum(x) over (partition by series_id, vec_id, b) + 1e-10 as s from h_b) group by 1, 2, 3) group by 1, 2) group by series_id)""",
        **HB,
    ),
)
def _(spark, d):
    return tidy(ss.band_entropy(view(spark, d, "v_spectra"), ID, BANDS))


@query(
    "band_contrast",
    oracle(
        f"""select series_id, round(v, 6) as contrast, round({_clip("v")}, 6) as score from (
          select a.series_id, 6e-1 * a.cv + 4e-1 * b.cv as v from (
            select series_id, stddev_pop(m) / avg(m) as cv from (select series_id, b, avg(e) as m from h_e group by 1, 2) group by series_id) a
          join (select series_id, avg(cv) as cv from (select series_id, vec_id, stddev_pop(e) / (avg(e) + 1e-10) as cv from h_e group by 1, 2) group by series_id) b using (series_id))""",
        h_e="select series_id, vec_id, b, sqrt(avg(x * x)) as e from h_b group by 1, 2, 3",
        **HB,
    ),
)
def _(spark, d):
    return tidy(ss.band_contrast(view(spark, d, "v_spectra"), ID, BANDS))


@query(
    "band_difference",
    oracle(
        f"""select series_id, round(avg(g), 6) as mean_diff, round(stddev_pop(g), 6) as spread,
          round({_clip("6e-1 * least(avg(g) / 15e-2, 1e0) + 4e-1 * least(stddev_pop(g) / 1e-1, 1e0)")}, 6) as score from (
          select series_id, b, abs(l - r) / (l + r + 1e-10) as g from (
            select series_id, b, sqrt(avg(x * x)) as l, sqrt(avg(x * x * pow(1e0 + j / 64e0, 2))) as r from h_b group by 1, 2)) group by series_id""",
        **HB,
    ),
)
def _(spark, d):
    v = view(spark, d, "v_spectra").select(
        ID,
        F.col("vec").alias("left"),
        F.transform("vec", lambda x, j: x * (1.0 + j / 64.0)).alias("right"),
    )
    return tidy(ss.band_difference(v, ID, BANDS))


@query(
    "spectral_tilt",
    oracle(
        f"""select series_id, round(t, 6) as tilt, round(g, 6) as irregularity, round({_clip(
          "7e-1 * greatest(0e0, 1e0 - abs(t + 3e0) / 35e-1) + 3e-1 * greatest(0e0, 1e0 - greatest(0e0, (g - 15e-1) / 3e0))")}, 6) as score from (
          select series_id, regr_slope(y, x) * (20e0 / ln(10e0)) as t, sqrt(greatest(var_pop(y) - regr_slope(y, x) * covar_pop(x, y), 0e0)) as g from (
            select series_id, log2(j * 5e1) as x, ln(m + 1e-10) as y from h_p where j > 1) group by series_id)""",
        h_p=POWER,
    ),
)
def _(spark, d):
    return tidy(ss.spectral_tilt(view(spark, d, "v_spectra"), ID))


@query(
    "active_share",
    oracle(
        f"""select series_id, round(s, 6) as share, round({_clip("s / 6e-1")}, 6) as score from (
          select series_id, avg(case when 20e0 * log10(m / top + 1e-10) > -2e0 then 1e0 else 0e0 end) as s from (
            select *, max(m) over (partition by series_id) as top from h_p) group by series_id)""",
        h_p=POWER,
    ),
)
def _(spark, d):
    return tidy(ss.active_share(view(spark, d, "v_spectra"), ID, db=-2.0))


@query(
    "band_share",
    oracle(
        f"""select series_id, round(r, 6) as share, round({_clip("exp(-8e0 * (r - 2e-1) * (r - 2e-1))")}, 6) as score from (
          select series_id, sum(x * x) filter (j >= 50) / (sum(x * x) + 1e-10) as r from h_b group by series_id)""",
        **HB,
    ),
)
def _(spark, d):
    return tidy(ss.band_share(view(spark, d, "v_spectra"), ID, 50))


@query(
    "band_ratio",
    oracle(
        f"""select series_id, round(p, 6) as share, round({_clip("greatest(exp(-8e0 * (p - 35e-2) * (p - 35e-2)), 3e-1)")}, 6) as presence,
          round({_clip("case when h <= 15e-2 then 1e0 when h <= 25e-2 then 1e0 - (h - 15e-2) / 1e-1 * 3e-1 else greatest(7e-1 - (h - 25e-2) / 25e-2 * 5e-1, 1e-1) end")}, 6) as harshness from (
          select series_id, sum(x * x) filter (j between 20 and 29) / sum(x * x) as p, sum(x * x) filter (j between 20 and 29) / sum(x * x) filter (j between 8 and 59) as h from h_b group by series_id)""",
        **HB,
    ),
)
def _(spark, d):
    return tidy(ss.band_ratio(view(spark, d, "v_spectra"), ID, (20, 30), (8, 60)))


@query(
    "flatness",
    oracle(
        f"""select series_id, round(f, 6) as flatness, round({_clip("1e0 - least(f / 3e-1, 1e0)")}, 6) as score from (
          select series_id, exp(avg(ln(m + 1e-10))) / avg(m) as f from h_p where j between 8 and 39 group by series_id)""",
        h_p=POWER,
    ),
)
def _(spark, d):
    return tidy(ss.flatness(view(spark, d, "v_spectra"), ID, 8, 40))
