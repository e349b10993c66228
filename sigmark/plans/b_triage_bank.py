"""Triage, the model bank, half-times, regimes and their roll-up."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bank, curves, triage
from ..sources.tables import Tables
from .registry import PTS, SHORT, query, r6, rounded

_W = "(partition by curve_id order by t)"
_FEAT = f"""one as (select * from (select *, row_number() over (partition by curve_id, t order by seq) as r from pts) where r = 1),
p0 as (select curve_id, t, y, row_number() over {_W} as i, count(*) over (partition by curve_id) as n, lag(y) over {_W} as py, lag(t) over {_W} as pt, min(t) over (partition by curve_id) as t0, max(t) over (partition by curve_id) as t1 from one),
p1 as (select *, greatest(1, least(3, n // 5)) as k, greatest(2, round_even(0.2 * n, 0)::integer) as tail, y - py as dy, t - pt as dt from p0),
p2 as (select *, dy / dt as slope, abs(dt - lag(dt) over {_W}) as ddt from p1),
p3 as (select *, case when slope > 0 then row_number() over (partition by curve_id, slope > 0 order by slope) end as up_rank, count(*) filter (slope > 0) over (partition by curve_id) as n_up from p2),
f0 as (select curve_id, count(*) as n_points, min(y) as ymin, max(y) as ymax, arg_min(i, (-y, i)) as i_max, coalesce(median(abs(dy)), 0) as noise,
  median(y) filter (i <= k) as y_start, median(y) filter (i > n - k) as y_end,
  coalesce(max(slope) filter (up_rank = round_even(0.9 * (n_up - 1), 0)::integer + 1), 0) as max_slope,
  coalesce(regr_slope(y, t - t0) filter (i <= tail), 0) as start_slope, coalesce(regr_slope(y, t - t1) filter (i > n - tail), 0) as end_slope,
  coalesce(median(ddt), 0) as mad, median(dt) as mdt from p3 group by 1),
feat as (select curve_id, n_points, ymin, ymax, noise, y_start, y_end, max_slope, start_slope, end_slope,
  case when n_points > 1 then (i_max - 1) / (n_points - 1)::double else 0 end as i_max_frac, ymax - ymin as range, y_end - y_start as net_rise, ymax - y_end as post_peak_drop,
  case when mdt > 0 then mad / mdt else 0 end as cv_dt from f0),
v0 as (select *, n_points < 4 as few, not n_points < 4 and (range <= 3.0 * noise or max_slope <= 0) as flat from feat),
v1 as (select *, not few and not flat and post_peak_drop > 0.2 * range and i_max_frac < 0.88 as wobbly, not few and not flat and start_slope > 0.45 * max_slope as l, not few and not flat and cv_dt > 1.0 as odd from v0),
v2 as (select *, not few and not flat and not wobbly and i_max_frac >= 0.88 and end_slope > 0.15 * max_slope as r, not few and not flat and not wobbly and n_points < 6 as sparse from v1),
verdict as (select *, case when few then 'unfittable' when wobbly or sparse then 'suspect' else 'fittable' end as fittability,
  case when l and r then 'left_right' when l then 'left' when r then 'right' when odd then 'interval' else 'none' end as censoring,
  case when few then 'reject' when flat then 'descriptive_only' when wobbly then 'nonmonotonic_fit' else 'monotonic_fit' end as handling,
  not few and not r and not wobbly as plateau_reached from v2)"""
FEAT, SFEAT = f"with {PTS}, {_FEAT}", f"with {SHORT}, {_FEAT}"


def feats(t: Tables, short: bool = False):
    return triage.features(curves.first_rows(t.short_points() if short else t.points()).select("curve_id", "t", "y"))


def _shown(*names: str) -> str:
    return ", ".join(f"round({n}::double, 6) as {n}" for n in names)


for _name, _cols in {
    "d01_edge_medians": ["y_start", "y_end"], "d02_noise": ["noise"], "d03_max_slope": ["max_slope"], "d04_edge_slopes": ["start_slope", "end_slope"],
    "d05_peak_stats": ["i_max_frac", "range", "net_rise", "post_peak_drop"], "d06_cv_dt": ["cv_dt"],
}.items():
    query(_name, f"{SFEAT} select curve_id, n_points, {_shown(*_cols)} from feat")(lambda t, cols=_cols: rounded(feats(t, True).select("curve_id", "n_points", *cols), *cols))


@query("d07_triage", f"{SFEAT} select curve_id, fittability, handling, plateau_reached, flat, concat_ws(',', case when few then 'too_few_points' end, case when flat then 'flat' end, case when wobbly then 'non_monotonic' end, case when l then 'no_lag_phase' end, case when r then 'right_censored_no_plateau' end, case when odd then 'irregular_sampling' end, case when sparse then 'sparse' end, case when not (few or flat or wobbly or l or r or odd or sparse) then 'clean' end) as reasons from verdict")
def d07(t: Tables):
    return triage.triage(feats(t, True)).select("curve_id", "fittability", "handling", "plateau_reached", "flat", F.array_join("reasons", ",").alias("reasons"))


@query("d08_censoring", f"{SFEAT} select censoring, count(*) as n from verdict group by 1")
def d08(t: Tables):
    return triage.triage(feats(t, True)).groupBy("censoring").agg(F.count("*").alias("n"))


@query("d09_normalize", f"{FEAT} select o.curve_id, round(o.t, 6) as t, round(case when plateau_reached and not flat and range > 0 then (y - ymin) / range else y - ymin end, 6) as y_norm from one o join verdict using (curve_id)")
def d09(t: Tables):
    p = curves.first_rows(t.points()).select("curve_id", "t", "y")
    return triage.normalize(p, triage.triage(triage.features(p))).select("curve_id", r6("t").alias("t"), r6("y_norm").alias("y_norm"))


# monotone curves for the bank: running share of a user's total
_MONO = "mono as (select curve_id, t, sum(y) over (partition by curve_id order by t) / sum(y) over (partition by curve_id) as y, case when max(t) over (partition by curve_id) > min(t) over (partition by curve_id) then (t - min(t) over (partition by curve_id)) / (max(t) over (partition by curve_id) - min(t) over (partition by curve_id)) else 0 end as x from (select * from (select *, row_number() over (partition by curve_id, t order by seq) as r from pts) where r = 1))"
_E = "exp(greatest(-50.0, least(50.0, {0})))"
_Z = _E.format("-p1 * (x - p2)")
_BC = f"1 / (1 + {_E.format('p1 * (ln(greatest(x, 1e-9)) - ln(case when p2 > 0 then p2 else 1 end))')})"
_BASIS = f"case model when 'lnt' then x when 'logistic' then 1 / (1 + {_Z}) when 'gompertz' then {_E.format('-' + _Z)} when 'richards' then 1 / pow(1 + p3 * {_Z}, 1 / p3) when 'exponential' then 1 - {_E.format('-p1 * x')} when 'scaling' then pow(greatest(x, 1e-9), p1) when 'finke_watzky' then p1 * ({_E.format('(p1 + p2) * x')} - 1) / (p1 * {_E.format('(p1 + p2) * x')} + p2) when 'brain_cousens' then {_BC} when 'dr_brain_cousens' then {_BC} when 'dr_lnt' then x when 'dr_threshold' then greatest(x - p1, 0) when 'dr_hill' then 1 / (1 + pow(p1 / greatest(x, 1e-9), p2)) when 'dr_scaling' then pow(greatest(x, 1e-9), p1) end"
_GRID = "grid(model, candidate, p1, p2, p3) as (values " + ", ".join(f"('{m}', {i}, {a!r}::double, {b!r}::double, {c!r}::double)" for m, i, a, b, c in bank.candidates()) + ")"
_P = "case model " + " ".join(f"when '{m}' then {k}.0" for m, k in bank.MODELS.items()) + " end"
_ORDER = "case model " + " ".join(f"when '{m}' then {i}" for i, m in enumerate(bank.MODELS)) + " end"
_BOUND = ", ".join(f"'{m}'" for m in bank.BOUNDED)


def bank_sql(table: str, keys: str) -> str:
    """c: every candidate of the bank on a table of (keys, x, y)."""
    return f"""q0 as (select {keys}, x, y - avg(y) over (partition by {keys}) as y, avg(y) over (partition by {keys}) as mean, max(y) over (partition by {keys}) - min(y) over (partition by {keys}) as range from {table}),
q1 as (select *, {_BASIS} as g from q0, grid),
q2 as (select *, case when model in ('brain_cousens', 'dr_brain_cousens') then x * g else 0 end as h from q1),
q3 as (select {keys}, model, candidate, count(*)::double as n, any_value(mean) as mean, any_value(range) as range, avg(g) as gbar, avg(h) as hbar, avg(y) as ybar, sum(g * g) - sum(g) * sum(g) / count(*) as sgg, sum(g * h) - sum(g) * sum(h) / count(*) as sgh, sum(h * h) - sum(h) * sum(h) / count(*) as shh, sum(g * y) - sum(g) * sum(y) / count(*) as sgy, sum(h * y) - sum(h) * sum(y) / count(*) as shy, sum(y * y) - sum(y) * sum(y) / count(*) as syy from q2 group by {keys}, model, candidate),
q4 as (select *, sgg * shh - sgh * sgh as det, case when sgg > 1e-9 then sgy / sgg else 0 end as one from q3),
q5 as (select *, case when model in ('brain_cousens', 'dr_brain_cousens') and det > 1e-9 then (sgy * shh - shy * sgh) / det when model in ({_BOUND}) then greatest(0, least(3 * range, one)) else one end as amp, case when model in ('brain_cousens', 'dr_brain_cousens') and det > 1e-9 then (shy * sgg - sgy * sgh) / det else 0 end as tilt from q4),
c as (select *, mean + ybar - amp * gbar - tilt * hbar as base, round(greatest(0, syy - 2 * amp * sgy - 2 * tilt * shy + amp * amp * sgg + 2 * amp * tilt * sgh + tilt * tilt * shh), 6) as sse, syy as sst from q5)"""


FITS = f"""with {PTS}, {_MONO}, {_GRID},
{bank_sql("mono", "curve_id")},
best as (select * from (select *, row_number() over (partition by curve_id, model order by sse, candidate) as r from c) where r = 1),
m0 as (select curve_id, model, candidate, base, amp, tilt, gbar, sgg, sse, sst, n, {_P} as p, -0.5 * n * (ln(2 * pi()) + ln(greatest(sse / n, 1e-12)) + 1) as loglik from best),
m1 as (select *, 1 - sse / greatest(sst, 1e-12) as r2, 2 * p - 2 * loglik as aic, p * ln(n) - 2 * loglik as bic from m0),
fits as (select *, case when n - p - 1 > 0 then aic + 2 * p * (p + 1) / (n - p - 1) end as aicc, {_ORDER} as ord from m1),
winner as (select * from (select *, row_number() over (partition by curve_id order by round(aicc, 6), ord) as r from fits where aicc is not null) where r = 1)"""


def mono(t: Tables):
    w = Window.partitionBy("curve_id")
    p = curves.first_rows(t.points())
    return bank.scaled(p.select("curve_id", "t", (F.sum("y").over(w.orderBy("t")) / F.sum("y").over(w)).alias("y")))


def fits(t: Tables):
    return bank.metrics(bank.fit(mono(t).select("curve_id", "x", "y"), bank.grid(t.spark)))


for _i, _m in enumerate(["lnt", "logistic", "gompertz", "richards", "exponential", "scaling", "brain_cousens", "finke_watzky"], 1):
    def _fit(t: Tables, m: str = _m):
        f = bank.fit(mono(t).select("curve_id", "x", "y"), bank.grid(t.spark).where(F.col("model") == m))
        return f.select("curve_id", "candidate", "sse", F.round("base", 4).alias("base"), F.round("amp", 4).alias("amp"))

    query(f"e{_i:02d}_fit_{_m}", f"{FITS} select curve_id, candidate, sse, round(base, 4) as base, round(amp, 4) as amp from best where model = '{_m}'")(_fit)


@query("e11_fit_metrics", f"{FITS} select curve_id, model, round(r2, 4) as r2, round(aicc, 3) as aicc, round(bic, 3) as bic from fits")
def e11(t: Tables):
    return fits(t).select("curve_id", "model", F.round("r2", 4).alias("r2"), F.round("aicc", 3).alias("aicc"), F.round("bic", 3).alias("bic"))


_LIC = "lic(handling, model, n_params) as (values " + ", ".join(f"('{h}', '{m}', {bank.MODELS[m]})" for h, ms in bank.CANDIDATES.items() for m in ms) + ")"


@query("e12_license_candidates", f"{SFEAT}, {_LIC} select model, count(*) as n, count(*) filter (n_points <= n_params) as n_too_few from verdict join lic using (handling) group by 1")
def e12(t: Tables):
    return bank.licensed(triage.triage(feats(t, True))).groupBy("model").agg(F.count("*").alias("n"), F.count(F.when(F.col("too_few_points"), 1)).alias("n_too_few"))


@query("e13_best_by_aicc", f"{FITS} select curve_id, model, candidate, round(aicc, 3) as aicc from winner")
def e13(t: Tables):
    return bank.best_by_aicc(fits(t)).select("curve_id", "model", "candidate", F.round("aicc", 3).alias("aicc"))


@query("e14_akaike_weights", f"{FITS}, r as (select curve_id, model, exp(-0.5 * (aicc - min(aicc) over (partition by curve_id))) as rel from fits where aicc is not null) select curve_id, model, round(rel / sum(rel) over (partition by curve_id), 3) as weight from r")
def e14(t: Tables):
    return bank.akaike_weights(fits(t)).select("curve_id", "model", F.round("weight", 3).alias("weight"))


@query("e15_best_by_family", f"{FITS} select curve_id, arg_min(model, (round(aicc, 6), ord)) filter (model <> 'finke_watzky') as descriptive, arg_min(model, (round(aicc, 6), ord)) filter (model = 'finke_watzky') as mechanistic from fits where aicc is not null group by 1")
def e15(t: Tables):
    f = fits(t).where("aicc is not null")
    key = F.struct(F.round("aicc", 6), bank.bank_order(F.col("model")))
    mech = F.col("model") == "finke_watzky"
    return f.groupBy("curve_id").agg(F.min_by("model", F.when(~mech, key)).alias("descriptive"), F.min_by("model", F.when(mech, key)).alias("mechanistic"))


@query("e25_compare_models", f"{FITS} select curve_id, model, row_number() over (partition by curve_id order by round(aicc, 6), ord)::integer as rank, round(aicc - min(aicc) over (partition by curve_id), 3) as delta, case when model = 'finke_watzky' then 'mechanistic' else 'descriptive' end as family from fits where aicc is not null")
def e25(t: Tables):
    return bank.compare_models(fits(t)).select("curve_id", "model", "rank", F.round("delta", 3).alias("delta"), "family")


@query("f02_first_crossing", f"with {PTS}, {_MONO}, w as (select curve_id, x, y, lead(x) over (partition by curve_id order by x) as nx, lead(y) over (partition by curve_id order by x) as ny, min(y) over (partition by curve_id) as lo, max(y) over (partition by curve_id) as hi from mono), g as (select *, lo + f * (hi - lo) as goal from w, (values (0.1), (0.5), (0.9)) v(f)), c as (select curve_id, f, x, case when y = goal then x when (y - goal) * (ny - goal) < 0 then x + (goal - y) / (ny - y) * (nx - x) end as cross_at from g where nx is not null) select curve_id, f::double as share, round(arg_min(cross_at, x) filter (cross_at is not null), 6) as cross_at from c group by 1, 2 having count(cross_at) > 0")
def f02(t: Tables):
    m, out = mono(t), None
    for s in (0.1, 0.5, 0.9):
        c = bank.first_crossing(m, s).select("curve_id", F.lit(s).alias("share"), r6("at").alias("cross_at"))
        out = c if out is None else out.unionByName(c)
    return out
