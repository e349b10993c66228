"""Features of fitted curves, regimes by shape, replicates of fits, and what of them is told apart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bank, curves, features, regimes, resample, triage
from ..operators.graph import cut
from ..sources.tables import Tables
from .b_triage_bank import _FEAT, _GRID, _MONO, FITS, bank_sql, fits, mono
from .registry import PTS, query, r6, rounded

# triage of the same monotone curves that the bank fits
_VER = "monop as (select curve_id, t, y, 0 as seq from mono), " + _FEAT.replace("from pts)", "from monop)")
_PRED = """case when model = 'brain_cousens' then base + amp * g + tilt * x * g else base + amp * g end"""


def _basis(x: str) -> str:
    from .b_triage_bank import _BASIS

    return _BASIS.replace("(x, 1e-9)", f"({x}, 1e-9)").replace("x - p2", f"{x} - p2").replace("* x", f"* {x}").replace("then x ", f"then {x} ")


DENSE = f"""{FITS}, {_VER},
span as (select curve_id, min(t) as lo, max(t) as hi from mono group by 1),
par as (select w.curve_id, w.model, p1, p2, p3, base, amp, tilt, lo, hi from winner w join grid using (model, candidate) join span using (curve_id)),
d0 as (select *, {_basis('x')} as g from (select *, i / 599.0::double as x from par, range(0, 600) r(i))),
dense as (select curve_id, i, lo + x * (hi - lo) as t, {_PRED} as v from d0),
g0 as (select *, lag(v) over w as pv, lead(v) over w as nv, lag(t) over w as pt, lead(t) over w as nt from dense window w as (partition by curve_id order by i)),
g1 as (select *, case when coalesce(nt, t) - coalesce(pt, t) > 0 then (coalesce(nv, v) - coalesce(pv, v)) / (coalesce(nt, t) - coalesce(pt, t)) else 0 end as slope from g0),
g2 as (select curve_id, arg_max(t, (round(slope, 9), -i)) as st, arg_max(v, (round(slope, 9), -i)) as sv, arg_max(i, (round(slope, 9), -i)) as si, arg_max(slope, (round(slope, 9), -i)) as max_rate, arg_min(slope, i) as s0, arg_max(slope, i) as s1, min(v) as vmin, max(v) as vmax, min(t) as lo, max(t) as hi from g1 group by 1),
infl as (select *, si > 0 and si < 599 and max_rate > 1.15 * greatest(s0, s1, 1e-9) as inflection from g2),
k0 as (select g0.*, s, vmin + s * (vmax - vmin) as goal from g0 join g2 using (curve_id), (values (0.1::double), (0.5::double), (0.9::double)) z(s) where nv is not null),
k1 as (select curve_id, s, i, case when v = goal then t when (v - goal) * (nv - goal) < 0 then t + (goal - v) / (nv - v) * (nt - t) end as hit from k0),
k2 as (select curve_id, arg_min(hit, i) filter (s = 0.1 and hit is not null) as t10, arg_min(hit, i) filter (s = 0.5 and hit is not null) as t50, arg_min(hit, i) filter (s = 0.9 and hit is not null) as t90 from k1 group by 1),
v0f as (select *, vmax - vmin as dynamic_range, t90 - t10 as width, case when inflection and max_rate > 1e-9 then st - (sv - vmin) / max_rate end as lag from infl left join k2 using (curve_id) where vmax - vmin >= 1e-9),
vec as (select *, case when t50 > 1e-9 then lag / t50 end as lag_ratio, case when width > 1e-9 then t50 / width end as sharpness, max_rate * case when hi > lo then hi - lo else 1 end / dynamic_range as max_rate_normalized from v0f),
shp as (select verdict.curve_id, case when winner.curve_id is null then 'no_fit' else 'ok' end as status, flat or vec.curve_id is null as flat, handling = 'nonmonotonic_fit' as wob, inflection, sharpness, lag_ratio from verdict left join winner using (curve_id) left join vec using (curve_id)),
reg as (select curve_id, case when status = 'no_fit' then 'anomalous_unclassified' when flat then 'no_detectable_aggregation' when wob then 'non_monotonic_settling' when not coalesce(inflection, false) then 'gradual_non_cooperative' when sharpness > 5.7 and lag_ratio > 0.97 then 'threshold_driven' else 'cooperative_sigmoidal' end as regime from shp)"""


class Shapes:
    """What these queries share, each part worked out once."""

    def __init__(self, t: Tables) -> None:
        self.cands, self.points = bank.grid(t.spark), mono(t)
        self.fits = cut(bank.metrics(bank.fit(self.points.select("curve_id", "x", "y"), self.cands)), "shape-fits")
        self.winners = bank.best_by_aicc(self.fits)
        self.verdicts = triage.triage(triage.features(self.points.select("curve_id", "t", "y")))

    def dense(self):
        return features.densify(self.winners, self.cands, features.spans(self.points))

    def vectors(self):
        return features.vector(cut(features.marks(self.winners, self.cands, features.spans(self.points)), "shape-marks"))

    def regimes(self):
        return regimes.classify(features.shaped(self.winners, self.vectors(), self.verdicts)).select("curve_id", "regime")


@query("f01_densify", f"{DENSE} select curve_id, i::integer as i, round(t, 4) as t, round(v, 4) as v from dense")
def f01(t: Tables):
    return Shapes(t).dense().select("curve_id", "i", F.round("t", 4).alias("t"), F.round("v", 4).alias("v"))


@query("f03_inflection", f"{DENSE} select curve_id, inflection, round(max_rate, 5) as max_rate, round(case when inflection then st end, 3) as inflection_t from infl")
def f03(t: Tables):
    i = features.inflection(cut(Shapes(t).dense(), "f03"))
    return i.select("curve_id", "inflection", F.round("max_rate", 5).alias("max_rate"), F.round(F.when(F.col("inflection"), F.col("steepest_t")), 3).alias("inflection_t"))


_F4 = ["t10", "t50", "t90", "width", "lag", "lag_ratio", "sharpness", "dynamic_range", "max_rate_normalized"]


@query("f04_feature_vector", f"{DENSE} select curve_id, {', '.join(f'round({x}, 3) as {x}' for x in _F4)} from vec")
def f04(t: Tables):
    return rounded(Shapes(t).vectors().select("curve_id", *_F4), *_F4, digits=3)


@query("f05_feature_status", f"{DENSE} select curve_id, case when censoring in ('right', 'left_right') then 'lower_bound' when censoring = 'left' then 'biased_early' when censoring = 'interval' then 'irregular' else 'point' end as t50_status, case when censoring in ('left', 'left_right') then 'undefined_left_censored' when not inflection then 'undefined_non_cooperative' else 'point' end as lag_status, concat_ws(',', case when not plateau_reached then 'plateau_not_reached_extrapolated' end, case when lag < 0 then 'lag_nonpositive_no_lag_phase' end, case when not inflection then 'non_cooperative_no_interior_inflection' end) as flags, round(case when censoring not in ('left', 'left_right') then lag end, 3) as lag from vec join verdict using (curve_id)")
def f05(t: Tables):
    s = Shapes(t)
    return features.status(s.vectors(), s.verdicts).select("curve_id", "t50_status", "lag_status", F.array_join("flags", ",").alias("flags"), F.round("lag", 3).alias("lag"))


@query("h01_regimes", f"{DENSE} select curve_id, regime from reg")
def h01(t: Tables):
    return Shapes(t).regimes()


_DOM = "dom(regime) as (values " + ", ".join(f"('{r}')" for r in regimes.REGIMES) + ")"


@query("m07_rollup", f"{DENSE}, {_DOM} select regime, count(curve_id) as n_curves from dom left join reg using (regime) group by 1")
def m07(t: Tables):
    return regimes.rollup(Shapes(t).regimes())


@query("v01_triage_of_batches", f"{DENSE} select v.curve_id, n_points, handling, censoring, model, round(t50, 3) as t50, regime from verdict v join reg using (curve_id) left join (select curve_id, model from winner) using (curve_id) left join (select curve_id, t50 from vec) using (curve_id)")
def v01(t: Tables):
    """What the stream of points settles at once all files have arrived: triage, model, half-time and regime."""
    return features.analysis(mono(t).select("curve_id", "t", "y")).select("curve_id", "n_points", "handling", "censoring", "model", F.round("t50", 3).alias("t50"), "regime")


@query("b22_predict", f"{FITS}, par as (select f.curve_id, f.model, p1, p2, p3, base, amp, tilt from best f join grid using (model, candidate)), d0 as (select *, {_basis('x')} as g from (select * from par, (values (0.0::double), (0.25::double), (0.5::double), (1.0::double)) z(x))) select curve_id, model, x, round({_PRED}, 4) as v from d0")
def b22(t: Tables):
    f = bank.fit(mono(t).select("curve_id", "x", "y"), bank.grid(t.spark))
    at = f.select("curve_id", "model", "candidate", "base", "amp", "tilt", F.explode(F.array(F.lit(0.0), F.lit(0.25), F.lit(0.5), F.lit(1.0))).alias("x"))
    rows = at.join(F.broadcast(bank.grid(t.spark)), ["model", "candidate"])
    g = bank.basis(F.col("model"), F.col("p1"), F.col("p2"), F.col("p3"), F.col("x"))
    return rows.withColumn("g", g).select("curve_id", "model", "x", F.round(F.col("base") + F.col("amp") * F.col("g") + F.col("tilt") * bank.second(F.col("model"), F.col("g"), F.col("x")), 4).alias("v"))


@query("y03_curve_overlay", f"{DENSE} select curve_id, i::integer as i, round(lo + i / 19.0 * (hi - lo), 3) as t, round({_PRED}, 4) as v from (select *, {_basis('x')} as g from (select *, i / 19.0::double as x from par, range(0, 20) r(i)))")
def y03(t: Tables):
    s = Shapes(t)
    return features.densify(s.winners, s.cands, features.spans(s.points), 20).select("curve_id", "i", F.round("t", 3).alias("t"), F.round("v", 4).alias("v"))


@query("e16_linear_errors", f"{FITS} select curve_id, model, round(case when n > p and sgg > 1e-9 then sqrt(sse / (n - p) / sgg) end, 4) as se_amp, round(case when n > p and sgg > 1e-9 then sqrt(sse / (n - p) * (1 / n + gbar * gbar / sgg)) end, 4) as se_base from fits where model not in ('brain_cousens', 'scaling')")
def e16(t: Tables):
    return rounded(bank.linear_errors(fits(t)).where(~F.col("model").isin("brain_cousens", "scaling")).select("curve_id", "model", "se_amp", "se_base"), "se_amp", "se_base", digits=4)


_RES = f"""{DENSE}, rs as (select m.curve_id, m.t, m.x, m.y, w.model, w.r2, {_PRED} as v from (select m.*, {_basis('m.x')} as g, p1, p2, p3, base, amp, tilt from mono m join par using (curve_id)) m join winner w using (curve_id, base, amp, tilt)),
sg as (select curve_id, t, case when round(y - v, 9) > 0 then 1 else -1 end as s from rs where round(y - v, 9) <> 0),
ch as (select *, s <> lag(s) over (partition by curve_id order by t) as change from sg),
ru as (select curve_id, count(*)::double as n, count(*) filter (s > 0)::double as n1, count(*) filter (s < 0)::double as n2, 1 + count(*) filter (change) as runs from ch group by 1 having count(*) >= 8),
rz as (select *, 2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1)) as var from ru),
rp as (select *, case when n1 = 0 or n2 = 0 then 0 else 1 - {{sf}} end as p from (select *, case when var > 0 then (runs - (2 * n1 * n2 / n + 1)) / sqrt(var) end as z from rz)),
an as (select rp.curve_id, winner.model, runs, round(rp.p, 6) as p, r2 from rp join winner using (curve_id))"""


def _res() -> str:
    from ..functions import tails

    return _RES.replace("{sf}", tails.norm_sf_sql("z"))


def anomalies(t: Tables):
    """Runs test on the residuals of each curve's selected fit, with its R2."""
    s = Shapes(t)
    fitted = bank.predict(s.winners, s.cands, s.points)
    res = fitted.select("curve_id", "t", F.round(F.col("y") - F.col("v"), 9).alias("r"))
    return regimes.runs_test(res).join(s.winners.select("curve_id", "model", "r2"), "curve_id").select("curve_id", "model", "runs", r6("p").alias("p"), "r2")


@query("h05_residual_anomaly", f"{_res()} select curve_id, model, runs, p, round(r2, 4) as r2 from an")
def h05(t: Tables):
    return anomalies(t).withColumn("r2", F.round("r2", 4))


@query("h07_proposals", f"{_res()}, pv as (select p, count(*) as k from an where p is not null group by 1), pr as (select p, sum(k) over (order by p) as r, sum(k) over () as m from pv), lim as (select max(p) as cutoff from pr where p <= r / m * 0.05) select curve_id, model, runs, p, round(r2, 4) as r2, coalesce(p <= cutoff, false) and r2 < 0.90 as proposed from an, lim")
def h07(t: Tables):
    """Tested curves; a change of the registry is proposed where residuals are structured at the false-discovery rate and the fit is poor."""
    a = regimes.bh_fdr(anomalies(t), "p")
    return a.select("curve_id", "model", "runs", "p", F.round("r2", 4).alias("r2"), (F.col("rejected") & (F.col("r2") < regimes.MISFIT_R2)).alias("proposed"))


#: Replicates of a fit; each is a whole refit of the models near the best.
DRAWS = 20
_BOOT = f"""{DENSE}, near as (select curve_id, model from (select *, aicc - min(aicc) over (partition by curve_id) as delta from fits where aicc is not null) where delta < 10),
rb as (select m.curve_id, m.x, row_number() over (partition by m.curve_id order by m.t) - 1 as i, count(*) over (partition by m.curve_id) as n, m.y, {_PRED} as v from (select m.*, {_basis('m.x')} as g, base, amp, tilt, model from mono m join par using (curve_id)) m),
star as (select curve_id, draw, x, v + (y - v) * case when ('0x' || substr(md5('mammen:' || curve_id || ':' || (i // ceil(pow(n, 1 / 3.0::double))::integer) || ':' || draw), 1, 12))::bigint / 281474976710656.0::double < (sqrt(5) + 1) / (2 * sqrt(5)) then -(sqrt(5) - 1) / 2 else (sqrt(5) + 1) / 2 end as y from rb, range(0, {DRAWS}) r(draw)),
{bank_sql("star", "curve_id, draw").replace("q0 as", "b0 as").replace("q1 as", "b1 as").replace("q2 as", "b2 as").replace("q3 as", "b3 as").replace("q4 as", "b4 as").replace("q5 as", "b5 as").replace("from q0, grid", "from b0, (select grid.*, curve_id as cid from grid join near using (model)) where cid = curve_id").replace("from q1", "from b1").replace("from q2", "from b2").replace("from q3", "from b3").replace("from q4", "from b4").replace("from q5", "from b5").replace("c as (select *, mean", "bc as (select *, mean")},
bb as (select * from (select *, row_number() over (partition by curve_id, draw, model order by sse, candidate) as rk from bc) where rk = 1),
bm as (select *, {{p}} as p, -0.5 * n * (ln(2 * pi()) + ln(greatest(sse / n, 1e-12)) + 1) as loglik from bb),
ba as (select *, case when n - p - 1 > 0 then 2 * p - 2 * loglik + 2 * p * (p + 1) / (n - p - 1) end as aicc, {{ord}} as ord from bm),
bw as (select * from (select *, row_number() over (partition by curve_id, draw order by round(aicc, 6), ord) as rw from ba where aicc is not null) where rw = 1)"""


def _boot() -> str:
    from .b_triage_bank import _ORDER, _P

    return _BOOT.replace("{p}", _P).replace("{ord}", _ORDER)


def replicates(t: Tables):
    """The model selected in each replicate: residuals with block weights on the selected fit, models near the best refitted."""
    s = Shapes(t)
    near = bank.akaike_weights(s.fits).where("delta < 10").select("curve_id", "model")
    w = Window.partitionBy("curve_id")
    rows = bank.predict(s.winners, s.cands, s.points.select("curve_id", "t", "x", "y"))
    rows = rows.withColumns({"i": F.row_number().over(w.orderBy("t")) - 1, "size": F.ceil(F.pow(F.count("*").over(w).cast("double"), F.lit(1 / 3.0))).cast("int")})
    weight = lambda d: resample.block_mammen(F.col("curve_id"), F.floor(F.col("i") / F.col("size")), F.lit(d))
    star = cut(rows.select("curve_id", "x", F.array(*[F.col("v") + (F.col("y") - F.col("v")) * weight(d) for d in range(DRAWS)]).alias("ys")), "replicate-points")
    rows = bank.metrics(bank.fit_draws(star, s.cands, near, DRAWS)).where("aicc is not null")
    best = rows.groupBy("curve_id", "draw").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("curve_id", "draw")]), F.struct(F.round("aicc", 6), bank.bank_order(F.col("model")))).alias("b"))
    return s, cut(best.select("curve_id", "draw", "b.*"), "replicates")


@query("e21_bootstrap_selection", f"{_boot()}, n as (select curve_id, model, count(*) as k from bw group by 1, 2) select curve_id, arg_min(model, (-k, model)) as selected, round(max(k)::double / sum(k), 6) as stability, max(k)::double / sum(k) < 0.6 as multimodal, count(*) as n_models from n group by 1")
def e21(t: Tables):
    n = replicates(t)[1].groupBy("curve_id", "model").agg(F.count("*").alias("k"))
    g = n.groupBy("curve_id").agg(F.min_by("model", F.struct(-F.col("k"), F.col("model"))).alias("selected"), (F.max("k") / F.sum("k")).alias("stability"), F.count("*").alias("n_models"))
    return g.select("curve_id", "selected", r6("stability").alias("stability"), (F.col("stability") < 0.6).alias("multimodal"), "n_models")


_T50 = f"""{_boot()}, bp as (select bw.curve_id, bw.draw, bw.model, p1, p2, p3, base, amp, tilt, lo, hi from bw join grid using (model, candidate) join span using (curve_id)),
bd as (select curve_id, draw, model, lo, hi, i, x, {_PRED} as v from (select *, {_basis('x')} as g from (select *, i / 99.0::double as x from bp, range(0, 100) r(i)))),
bl as (select *, lead(v) over w as nv, lead(x) over w as nx, min(v) over z + 0.5 * (max(v) over z - min(v) over z) as goal from bd window w as (partition by curve_id, draw order by i), z as (partition by curve_id, draw)),
bt as (select curve_id, draw, any_value(model) as model, any_value(lo) + arg_min(hit, i) * (any_value(hi) - any_value(lo)) as t50 from (select *, case when v = goal then x when (v - goal) * (nv - goal) < 0 then x + (goal - v) / (nv - v) * (nx - x) end as hit from bl where nv is not null) where hit is not null group by 1, 2)"""


def t50_draws(t: Tables):
    """(curve_id, draw, model, t50) of the replicates' selected fits, on 100 even times."""
    s, best = replicates(t)
    at = best.join(features.spans(s.points), "curve_id").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("x", F.col("i") / 99)
    rows = at.join(F.broadcast(s.cands), ["model", "candidate"])
    g = bank.basis(F.col("model"), F.col("p1"), F.col("p2"), F.col("p3"), F.col("x"))
    rows = rows.withColumn("g", g).select(F.struct("curve_id", "draw", "model", "lo", "hi").alias("curve_id"), "x", (F.col("base") + F.col("amp") * F.col("g") + F.col("tilt") * bank.second(F.col("model"), F.col("g"), F.col("x"))).alias("v"))
    at = bank.first_crossing(rows, 0.5, "x", "v")
    return at.select("curve_id.curve_id", "curve_id.draw", "curve_id.model", (F.col("curve_id.lo") + F.col("at") * (F.col("curve_id.hi") - F.col("curve_id.lo"))).alias("t50"))


@query("e22_t50_interval", f"{_T50} select curve_id, count(*) as n, round(quantile_cont(t50, 0.025), 2) as lo, round(quantile_cont(t50, 0.5), 2) as mid, round(quantile_cont(t50, 0.975), 2) as hi from bt group by 1 having count(*) >= 10")
def e22(t: Tables):
    g = t50_draws(t).groupBy("curve_id").agg(F.count("*").alias("n"), features.quantiles("t50").alias("q")).where("n >= 10")
    return rounded(g.select("curve_id", "n", F.col("q")[0].alias("lo"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("hi")), "lo", "mid", "hi", digits=2)


@query("f06_feature_ci", f"{_T50} select curve_id, model, count(*) as n, round(quantile_cont(t50, 0.025), 2) as lo, round(quantile_cont(t50, 0.975), 2) as hi from bt join (select curve_id, model from winner) using (curve_id, model) group by 1, 2 having count(*) >= 10")
def f06(t: Tables):
    """Intervals given the selected model: replicates that chose another one don't count."""
    d = t50_draws(t)
    own = d.join(bank.best_by_aicc(fits(t)).select("curve_id", "model"), ["curve_id", "model"])
    g = own.groupBy("curve_id", "model").agg(F.count("*").alias("n"), features.quantiles("t50").alias("q")).where("n >= 10")
    return rounded(g.select("curve_id", "model", "n", F.col("q")[0].alias("lo"), F.col("q")[2].alias("hi")), "lo", "hi", digits=2)


@query("q04_post_selection", f"{_boot()}, n as (select curve_id, model, count(*)::double as k from bw group by 1, 2), w as (select curve_id, model, k / sum(k) over (partition by curve_id) as w from n), e as (select w.*, r2 from w join fits using (curve_id, model) where w >= 0.05) select curve_id, round(sum(w * r2) / sum(w), 4) as score, round(max(r2) - min(r2), 4) as spread, round(max(r2) - min(r2), 6) <= 0.1 as robust, count(*) as n_models from e group by 1")
def q04(t: Tables):
    """A score averaged over the models that replicates choose in 5 % of cases or more, how far those differ, and whether that is little."""
    s, best = replicates(t)
    n = best.groupBy("curve_id", "model").agg(F.count("*").cast("double").alias("k"))
    w = n.withColumn("w", F.col("k") / F.sum("k").over(Window.partitionBy("curve_id"))).where("w >= 0.05").join(s.fits.select("curve_id", "model", "r2"), ["curve_id", "model"])
    g = w.groupBy("curve_id").agg((F.sum(F.col("w") * F.col("r2")) / F.sum("w")).alias("score"), (F.max("r2") - F.min("r2")).alias("spread"), F.count("*").alias("n_models"))
    return g.select("curve_id", F.round("score", 4).alias("score"), F.round("spread", 4).alias("spread"), (F.round("spread", 6) <= 0.1).alias("robust"), "n_models")


@query("m05_model_selection", f"{_boot()}, n as (select curve_id, model, count(*) as k from bw group by 1, 2), s as (select curve_id, arg_min(model, (-k, model)) as selected, max(k)::double / sum(k) as stability from n group by 1) select f.curve_id, coalesce(case when stability >= 0.6 then selected end, winner.model) as model, case when stability >= 0.6 then 'bootstrap' else 'point' end as source, round(stability, 6) as stability from (select distinct curve_id from fits) f left join s using (curve_id) left join winner using (curve_id)")
def m05(t: Tables):
    """The replicates' choice where it is stable, else the point selection."""
    s, best = replicates(t)
    n = best.groupBy("curve_id", "model").agg(F.count("*").alias("k"))
    b = n.groupBy("curve_id").agg(F.min_by("model", F.struct(-F.col("k"), F.col("model"))).alias("selected"), (F.max("k") / F.sum("k")).alias("stability"))
    rows = s.fits.select("curve_id").distinct().join(b, "curve_id", "left").join(s.winners.select("curve_id", "model"), "curve_id", "left")
    stable = F.col("stability") >= 0.6
    return rows.select("curve_id", F.coalesce(F.when(stable, F.col("selected")), F.col("model")).alias("model"), F.when(stable, "bootstrap").otherwise("point").alias("source"), r6("stability").alias("stability"))
