"""Queries over long scalar series: the events of each user in time order."""

from __future__ import annotations

from pyspark.sql import functions as F

from contest_analytics.functions.curves import rounded
from contest_analytics.operators import series_values as sv
from contest_analytics.plans.adapters import oracle, view
from contest_analytics.plans.registry import query

ID = "series_id"
ORDER = ["micros", "event_id"]


def tidy(df):
    """Doubles rounded for the comparison."""
    return df.select(
        *[rounded(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def series(spark, d, *cols):
    return view(spark, d, "v_series").select(ID, *ORDER, *cols)


def _clip(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"


W = "partition by series_id order by micros, event_id"
STEP = f"select *, lag(x) over ({W}) as p, row_number() over ({W}) as i, count(*) over (partition by series_id) as n from v_series"
H = {"h_step": STEP}


@query(
    "series_level",
    oracle("""select series_id, round(sqrt(avg(x * x)), 6) as rms, max(abs(x)) as peak, count(x) / 4e0 as duration
      from v_series group by series_id"""),
)
def _(spark, d):
    return tidy(sv.level(series(spark, d, "x"), ID, rate=4.0))


@query(
    "clipping",
    oracle(
        f"""select a.series_id, a.hard, coalesce(b.soft, 0) as soft, round((a.hard + coalesce(b.soft, 0)) / a.n, 6) as ratio,
        round(case when (a.hard + coalesce(b.soft, 0)) / a.n < 1e-3 then 1e0 else {_clip("1e0 - ((a.hard + coalesce(b.soft, 0)) / a.n - 1e-3) / (5e-2 - 1e-3)")} end, 6) as score
        from (select series_id, count(*) * 1e0 as n, count(*) filter (x > 450) as hard from v_series group by series_id) a
        left join (select series_id, sum(len)::bigint as soft from (select series_id, g, count(*) as len from (
          select series_id, i - row_number() over (partition by series_id order by i) as g from h_step where x > 300)
          group by series_id, g) where len > 2 group by series_id) b using (series_id)""",
        **H,
    ),
)
def _(spark, d):
    return tidy(sv.clipping(series(spark, d, "x"), ID, ORDER, hard=450.0, soft=300.0, run=2))


@query(
    "dynamic_range",
    oracle(f"""select series_id, round(r, 6) as range_db, round(case when n < 2 or r < 1 then 0e0 else
      {_clip("1e0 - abs(r - 3e1) / (3e1 + 5e0)")} end, 6) as score from (
      select series_id, count(*) as n, quantile_cont(db, 0.95) - quantile_cont(db, 0.05) as r from (
        select series_id, 20e0 * log10(x + 1e-10) as db from v_series where x > 1e-8) group by series_id)"""),
)
def _(spark, d):
    return tidy(sv.dynamic_range(series(spark, d, "x"), ID, target=30.0))


@query(
    "event_density",
    oracle(f"""select series_id, events, round(duration, 6) as duration, round(case when duration < 5e-1 then 0e0 else
      {_clip("3e-1 + 7e-1 * least(events / (duration * 5e-5), 1e0)")} end, 6) as score from (
      select series_id, count(*) as events, max(t) - min(t) as duration from v_series group by series_id)"""),
)
def _(spark, d):
    return tidy(sv.event_density(series(spark, d, "t"), ID, ceiling=5e-5))


@query(
    "interval_regularity",
    oracle(f"""select series_id, round(s / m, 6) as cv, round(strength, 6) as strength, round(case when n < 2 then 1e-1 * 3e-1
      else {_clip("(5e-1 * greatest(0e0, 1e0 - s / m / 3e-1) + 5e-1 * strength) * 85e-2 + 3e-1 * 15e-2")} end, 6) as score from (
      select series_id, count(*) as n, avg(g) as m, stddev_pop(g) as s, avg(x) / (max(x) + 1e-8) as strength from (
        select *, t - lag(t) over (partition by series_id order by t, event_id) as g from v_series) group by series_id)"""),
)
def _(spark, d):
    v = series(spark, d, "t", "x")
    return tidy(sv.interval_regularity(v, ID, floor=0.3, unique="event_id"))


LOUD = "case when {0} < 1e-20 then -70e0 else -691e-3 + 10e0 * log10({0}) end"


@query(
    "sliding_loudness",
    oracle(
        f"""select a.series_id, round(a.integrated, 6) as integrated, round(b.window_std, 6) as window_std,
        round(case when a.n < 12 or coalesce(b.w, 0) < 2 then whole
          else 5e-1 * whole + 5e-1 * {_clip("1e0 - abs(b.window_std - 2e0) / 8e0")} end, 6) as score from (
          select *, case when abs(integrated - 40e0) <= 4 then 1e0 else {_clip("1e0 - (abs(integrated - 40e0) - 4e0) / 8e0")} end as whole from (
            select series_id, count(*) as n, {LOUD.format("avg(x * x)")} as integrated from v_series group by series_id)) a
        left join (select series_id, stddev_pop(l) as window_std, count(*) as w from (
          select series_id, {LOUD.format("avg(x * x)")} as l from (
            select s.series_id, s.i as start, e.x from h_step s join h_step e on e.series_id = s.series_id and e.i between s.i and s.i + 11
            where (s.i - 1) % 4 = 0 and s.i + 11 <= s.n) group by series_id, start) where l > -69 group by series_id) b using (series_id)""",
        **H,
    ),
)
def _(spark, d):
    v = series(spark, d, "x")
    return tidy(sv.sliding_loudness(v, ID, ORDER, rate=4, target=40.0, std_target=2.0))


@query(
    "block_jitter",
    oracle(
        f"""select s.series_id, round(jitter, 6) as jitter, round(case when coalesce(w, 0) < 3 or coalesce(a, 0) < 3 then 0e0
          else {_clip("exp(-5e-1 * jitter)")} end, 6) as score from (select distinct series_id from v_series) s left join (
          select series_id, count(*) as w, count(*) filter (db > -60) as a, stddev_pop(db - p) filter (db > -60) as jitter from (
            select *, lag(db) over (partition by series_id, db > -60 order by start) as p from (
              select series_id, start, case when sqrt(avg(x * x)) > 1e-10 then 20e0 * log10(sqrt(avg(x * x))) else -100e0 end as db from (
                select s.series_id, s.i as start, e.x from h_step s join h_step e on e.series_id = s.series_id and e.i between s.i and s.i + 7
                where (s.i - 1) % 4 = 0 and s.i + 7 <= s.n) group by series_id, start)) group by series_id) using (series_id)""",
        **H,
    ),
)
def _(spark, d):
    return tidy(sv.block_jitter(series(spark, d, "x"), ID, ORDER, win=8, hop=4))


@query(
    "step_expressiveness",
    oracle(
        f"""select series_id, round(v, 6) as step_std, round(case when n < 4 then 0e0 else {_clip("exp(-50e0 * (v - 14e-1) * (v - 14e-1))")} end, 6) as score
        from (select series_id, count(*) as n, stddev_pop(x - p) / avg(x) as v from h_step group by series_id)""",
        **H,
    ),
)
def _(spark, d):
    return tidy(sv.step_expressiveness(series(spark, d, "x"), ID, ORDER, target=1.4))


PITCH = f"""select *, 12e0 * log2(x / first(x) over ({W}) + 1e-10) as s, row_number() over ({W}) as i,
  count(*) over (partition by series_id) as n from v_series where x > 0"""
LAGS = """select a.series_id, b.i - a.i as lag, sum(a.c * b.c) as ac, any_value(a.n) as n, any_value(a.z) as z
  from h_c a join h_c b on a.series_id = b.series_id and b.i > a.i group by a.series_id, b.i - a.i"""
CENTRED = "select *, sum(c * c) over (partition by series_id) as z from (select *, {0} - avg({0}) over (partition by series_id) as c from {1})"


@query(
    "interval_mix",
    oracle(
        f"""select series_id, round(list_avg([(d >= 5e-1 and d <= 5e0)::int for d in moves]), 6) as steps,
          round(list_avg([(d > 5e0 and d <= 12e0)::int for d in moves]), 6) as leaps,
          round(list_avg([(d > 12e0)::int for d in moves]), 6) as jumps,
          round(case when n < 2 then 0e0 when len(moves) = 0 or list_unique([round_even(x, 0) for x in notes]) <= 2 then 15e-2 else
            {_clip("""list_avg([(d >= 5e-1 and d <= 5e0)::int for d in moves]) + 5e-1 * list_avg([(d > 5e0 and d <= 12e0)::int for d in moves])
              - 5e-1 * list_avg([(d > 12e0)::int for d in moves]) + least(15e-2, 15e-3 * list_unique([round_even(d, 0) for d in moves]))""")} end, 6) as score from h_moves""",
        h_moves="select *, [abs(notes[j + 1] - notes[j]) for j in range(1, len(notes))] as moves from h_notes",
        h_notes=f"""select series_id, any_value(n) as n, list_reduce(list([s] order by i), lambda x, y:
          case when abs(y[1] - x[-1]) >= 5e-1 then list_append(x, y[1]) else x end) as notes from h_pitch group by series_id""",
        h_pitch=PITCH,
    ),
)
def _(spark, d):
    return tidy(sv.interval_mix(series(spark, d, "x"), ID, ORDER))


@query(
    "contour",
    oracle(
        f"""select f.series_id, round(f.step_std, 6) as step_std, round(g.peak, 6) as peak, round(case when f.n < 4 then 0e0 else
          {_clip('5e-1 * exp(-2e0 * (f.step_std - 1e0) * (f.step_std - 1e0)) + 5e-1 * case when f.n > 10 then greatest(0e0, least(1e0, 1e0 - abs(coalesce(g.peak, 0) - 5e-1) / 5e-1)) else 0e0 end')} end, 6) as score
        from (select series_id, any_value(n) as n, stddev_pop(abs(s - p)) as step_std from (
          select *, lag(s) over ({W}) as p from h_pitch) group by series_id) f
        left join (select series_id, max(ac / z) as peak from h_lags where lag >= greatest(1, n // 10) and lag < n // 2 group by series_id) g using (series_id)""",
        h_pitch=PITCH,
        h_c=CENTRED.format("s", "h_pitch"),
        h_lags=LAGS,
    ),
)
def _(spark, d):
    return tidy(sv.contour(series(spark, d, "x"), ID, ORDER))


@query(
    "half_decay",
    oracle(
        f"""select series_id, round(r, 6) as ratio, round(case when n < 10 then 0e0 else {_clip(
          "case when r < 5e-2 then r / 5e-2 when r > 5e-1 then greatest(1e0 - (r - 5e-1) / 5e-1, 0) else 6e-1 + 4e-1 * (r - 5e-2) / 45e-2 end")} end, 6) as score
        from (select series_id, n, coalesce(first_lag, n) / (n * 1e0) as r from (select distinct series_id, n from h_step)
          left join (select series_id, min(lag) as first_lag from h_lags where ac / (z + 1e-10) < 5e-1 group by series_id) using (series_id))""",
        h_step=STEP,
        h_c=CENTRED.format("x", "h_step"),
        h_lags=LAGS,
    ),
)
def _(spark, d):
    return tidy(sv.half_decay(series(spark, d, "x"), ID, ORDER))


@query(
    "entropy_motif",
    oracle(
        f"""select e.series_id, round(e.entropy, 6) as entropy, round(m.dominance, 6) as dominance, round(case when e.n < 5 then 0e0 else {_clip(
          "5e-1 * exp(-8e0 * (e.entropy - 7e-1) * (e.entropy - 7e-1)) + 5e-1 * case when m.top = 0 then 2e-1 else exp(-8e0 * (m.dominance - 35e-2) * (m.dominance - 35e-2)) end")} end, 6) as score
        from (select series_id, sum(c) as n, -sum(c / t * log2(c / t + 1e-10)) / case when count(*) > 1 then log2(count(*)) else 1e0 end as entropy from (
          select *, sum(c) over (partition by series_id) as t from (
            select series_id, round_even(12e0 * log2(x / 440e0 + 1e-10) + 69e0, 0) as note, count(*) as c from v_series where x > 0 group by 1, 2)) group by series_id) e
        left join (select series_id, arg_max(k, (c, -k)) as top, max(c) * 1e0 / sum(c) as dominance from (
          select series_id, round_even(abs(s - p), 0) as k, count(*) as c from (select *, lag(s) over ({W}) as p from h_pitch)
          where p is not null group by 1, 2) group by series_id) m using (series_id)""",
        h_pitch=PITCH,
    ),
)
def _(spark, d):
    return tidy(sv.entropy_motif(series(spark, d, "x"), ID, ORDER))


@query(
    "arc_fit",
    oracle(
        f"""select series_id, round(fit, 6) as fit, coalesce(round({_clip("greatest(0e0, fit) * 7e-1 + " + _clip("v / 25e-2") + " * 3e-1")} * 5e-2, 4), 0e0) as bonus
        from (select distinct series_id from v_series) left join (
          select series_id, corr(a, b) as fit, stddev_pop(a) as v from (
            select series_id, (x - lo) / (hi - lo) as a, case when i - 1 < k then 2e-1 + 8e-1 * (i - 1) / k else 1e0 - 7e-1 * (i - 1 - k) / greatest(n - k - 1, 1) end as b from (
              select *, case when floor(n * 6e-1) < 1 or floor(n * 6e-1) >= n - 1 then n // 2 else floor(n * 6e-1) end as k,
                min(x) over (partition by series_id) as lo, max(x) over (partition by series_id) as hi from h_step)
            where n >= 3 and hi - lo >= 1e-8) group by series_id) using (series_id)""",
        **H,
    ),
)
def _(spark, d):
    return tidy(sv.arc_fit(series(spark, d, "x"), ID, ORDER))


@query(
    "two_channel",
    oracle(f"""select series_id, round(case when c > 95e-2 then 2e-1 when c between 3e-1 and 8e-1 then 1e0 when c < 1e-1 then 5e-1
        when c > 8e-1 then 1e0 - (c - 8e-1) / 15e-2 * 8e-1 else 5e-1 + (c - 1e-1) / 2e-1 * 5e-1 end, 6) as width,
      round(case when m < 1e-10 then 0e0 when m / s >= 3 then 1e0 when m / s >= 1 then 5e-1 + 5e-1 * (m / s - 1) / 2e0 else {_clip("m / s * 5e-1")} end, 6) as phase,
      round({_clip("exp(-3e-1 * (m / s - 4e0) * (m / s - 4e0))")}, 6) as balance from (
      select series_id, corr(x, y) as c, sum((x + y) * (x + y) / 4) as m, sum((x - y) * (x - y) / 4) + 1e-10 as s from v_series group by series_id)"""),
)
def _(spark, d):
    return tidy(sv.two_channel(series(spark, d, "x", "y"), ID))


@query(
    "quartile_contrast",
    oracle(f"""select series_id, round(db, 6) as contrast_db, round(case when n < 4 then 0e0 else {_clip("db / 40e0")} end, 6) as score from (
      select series_id, any_value(n) as n, 10e0 * log10(avg(x * x) filter (r > n - ceil(n / 4e0)) / (avg(x * x) filter (r <= n // 4) + 1e-10)) as db from (
        select *, row_number() over (partition by series_id order by x, event_id) as r, count(*) over (partition by series_id) as n from v_series) group by series_id)"""),
)
def _(spark, d):
    return tidy(sv.quartile_contrast(series(spark, d, "x"), ID, unique="event_id"))


@query(
    "cv_consistency",
    oracle(f"""select series_id, round(stddev_pop(y) / avg(y), 6) as cv, round({_clip("1e0 - stddev_pop(y) / avg(y) / 5e-1")}, 6) as score
      from v_series group by series_id"""),
)
def _(spark, d):
    return tidy(sv.cv_consistency(series(spark, d, "y"), ID, "y"))


@query(
    "small_move_share",
    oracle(
        f"""select a.series_id, round(a.n / a.al, 6) as present, round(b.small, 6) as small, round(case when a.n < 3 then 0e0 else
          {_clip("a.n / a.al * b.small * case when b.still > 9e-1 then 5e-1 else 1e0 end")} end, 6) as score
        from (select series_id, count(*) * 1e0 as al, count(*) filter (x > 0) as n from h_gap group by series_id) a
        left join (select series_id, avg(case when d <= 105e-1 then 1e0 else 0e0 end) as small, avg(case when d < 5e-1 then 1e0 else 0e0 end) as still from (
          select series_id, abs(s - lag(s) over ({W})) as d from h_pitch) where d is not null group by series_id) b using (series_id)""",
        h_gap="select series_id, micros, event_id, case when event_id % 6 <> 0 then x end as x from v_series",
        h_pitch=f"select *, 12e0 * log2(x / first(x) over ({W}) + 1e-10) as s from h_gap where x > 0",
    ),
)
def _(spark, d):
    v = series(spark, d, F.when(F.col("event_id") % 6 != 0, F.col("x")).alias("x"))
    return tidy(sv.small_move_share(v, ID, ORDER, tolerance=1.5))


@query(
    "active_expressiveness",
    oracle(
        f"""select a.series_id, round(b.cv, 6) as cv, round(case when a.n < 4 then 5e-1 when coalesce(b.k, 0) < 4 then 3e-1 else {_clip(
          '''6e-1 * case when cv < 5e-2 then cv / 5e-2 * 3e-1 when cv <= 6e-1 then 5e-1 + 5e-1 * (cv - 5e-2) / 55e-2 else greatest(3e-1, least(1e0, 1e0 - (cv - 6e-1) / 6e-1)) end
            + 4e-1 * case when dv < 1e-2 then 2e-1 when dv <= 15e-2 then 4e-1 + 6e-1 * (dv - 1e-2) / 14e-2 else greatest(3e-1, least(1e0, 1e0 - (dv - 15e-2) / 2e-1)) end''')} end, 6) as score
        from (select series_id, count(*) as n from v_series group by series_id) a left join (
          select series_id, count(*) as k, stddev_pop(x) / avg(x) as cv, stddev_pop(x - p) / avg(x) as dv from (
            select *, lag(x) over ({W}) as p from (select *, max(x) over (partition by series_id) as m from v_series) where x > m * 5e-2)
          group by series_id) b using (series_id)"""
    ),
)
def _(spark, d):
    return tidy(sv.active_expressiveness(series(spark, d, "x"), ID, ORDER))


@query(
    "step_jitter",
    oracle(
        f"""select series_id, round(sd, 6) as step_std, round(m, 6) as median_cents, round(case when n < 2 then 5e-1 else {_clip("exp(-2e0 * (sd - 15e-1) * (sd - 15e-1))")} end, 6) as score,
          round(case when n < 10 then 4e-1 when m < 2 then 3e-1 + 2e-1 * m / 2e0 when m <= 30 then 7e-1 + 3e-1 * (1e0 - abs(m - 15e0) / 15e0)
            else greatest(0e0, least(5e-1, 1e0 - (m - 30e0) / 100e0)) end, 6) as stability
        from (select series_id, count(*) as n, stddev_pop(abs(12e0 * log2(x / (p + 1e-10) + 1e-10))) as sd,
          quantile_cont(1200e0 * abs(log2(x + 1e-10) - log2(p + 1e-10)), 0.5) as m from h_step group by series_id)""",
        **H,
    ),
)
def _(spark, d):
    return tidy(sv.step_jitter(series(spark, d, "x"), ID, ORDER))
