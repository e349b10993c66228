"""Scaling exponents, resampling, information content and what remains of regimes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tails
from ..operators import bank, curves, regimes, resample
from ..sources.tables import Tables
from .b_triage_bank import FITS, fits
from .e_ladders import LADDER, tier_of
from .registry import PTS, query, r6, rounded

_S = "sp as (select p_brand || '/' || l_returnflag as series, l_orderkey * 10 + l_linenumber as k, l_orderkey, l_quantity as conc, l_extendedprice / 1000 as t50, log10(l_quantity) as lc, log10(l_extendedprice / 1000) as lt, l_tax > 0.06 as censored from lineitem join part on l_partkey = p_partkey)"


def series(t: Tables):
    i = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return i.select(F.concat_ws("/", "p_brand", "l_returnflag").alias("series"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_quantity").alias("conc"), (F.col("l_extendedprice") / 1000).alias("t50"), F.log10("l_quantity").alias("lc"), F.log10(F.col("l_extendedprice") / 1000).alias("lt"), (F.col("l_tax") > 0.06).alias("censored"))


@query("g01_series_t50", f"with {_S} select series, count(*) as n, count(*) filter (censored) as n_censored, round(median(t50), 6) as median_t50 from sp where conc > 0 and t50 > 0 group by 1")
def g01(t: Tables):
    return series(t).where("conc > 0 and t50 > 0").groupBy("series").agg(F.count("*").alias("n"), F.count(F.when(F.col("censored"), 1)).alias("n_censored"), r6(F.median("t50")).alias("median_t50"))


@query("g02_gamma_ols", f"with {_S} select series, count(*) as n, count(distinct conc) as n_conc, round(-regr_slope(lt, lc), 6) as gamma, round(regr_r2(lt, lc), 6) as r2 from sp group by 1 having count(distinct conc) >= 3")
def g02(t: Tables):
    return rounded(resample.gamma_ols(series(t), "series"), "gamma", "r2")


def _em(i: int, prev: str) -> str:
    z = "((lt - (a + b * lc)) / s)"
    up = f"((a + b * lc) + s * {tails.ROOT} * exp(-{z} * {z} / 2) / greatest({tails.norm_sf_sql(z)}, 1e-6))"
    return f"f{i} as (select series, regr_slope(v, lc) as b, regr_intercept(v, lc) as a, sqrt(greatest(1e-9, (regr_syy(v, lc) - pow(regr_sxy(v, lc), 2) / nullif(regr_sxx(v, lc), 0)) / count(*))) as s from {prev} group by 1), e{i} as (select series, lc, lt, censored, case when censored then greatest(lt, {up}) else lt end as v from {prev} join f{i} using (series))"


@query("g03_gamma_censored", f"with {_S}, e0 as (select series, lc, lt, censored, lt as v from sp), {_em(1, 'e0')}, {_em(2, 'e1')}, {_em(3, 'e2')} select series, round(-regr_slope(v, lc), 4) as gamma, count(*) filter (censored) as n_censored from e3 group by 1")
def g03(t: Tables):
    return rounded(resample.gamma_censored(series(t), "series"), "gamma", digits=4)


@query("g06_mcrit_profile", f"with {_S}, low as (select series, min(conc) as lo from sp group by 1), gr as (select series, lo, i / 12.0::double * 0.95 * lo as mc from low, range(0, 12) r(i)), s as (select series, mc, lo, round(regr_syy(lt, x) - pow(regr_sxy(lt, x), 2) / nullif(regr_sxx(lt, x), 0), 9) as sse from (select sp.series, mc, lo, lt, log10(conc - mc) as x from sp join gr using (series)) group by 1, 2, 3), g as (select series, arg_min(mc, (sse, mc)) as mc, arg_min(sse, (sse, mc)) as sse, max(sse) filter (mc = 0) as nominal, any_value(lo) as lo from s group by 1) select series, round(mc, 6) as mc, round(sse, 5) as sse, sse < 0.9 * nominal and mc > 0.05 * lo as accepted from g")
def g06(t: Tables):
    return resample.mcrit_profile(series(t), "series").select("series", r6("mc").alias("mc"), F.round("sse", 5).alias("sse"), "accepted")


_D = 100
_DRAW = f"nb as (select *, row_number() over (partition by series order by k, lt, lc) - 1 as i, count(*) over (partition by series) as n from sp), rp as (select series, n, i as slot, draw from nb, range(0, {_D}) r(draw)), pk as (select series, draw, floor(('0x' || substr(md5('gamma:' || draw || ':' || series || ':' || slot), 1, 12))::bigint / 281474976710656.0::double * n)::integer as i from rp), dr as (select pk.series, draw, -regr_slope(lt, lc) as g from pk join nb on pk.series = nb.series and pk.i = nb.i group by 1, 2)"


@query("g07_gamma_ci", f"with {_S}, {_DRAW} select series, count(*) filter (g is not null and abs(g) <= 5) as n_draws, count(*) filter ((g is not null and abs(g) <= 5) is not true) as n_rejected, case when count(*) filter (g is not null and abs(g) <= 5) >= 20 then round(quantile_cont(g, 0.025) filter (abs(g) <= 5), 5) end as lo, case when count(*) filter (g is not null and abs(g) <= 5) >= 20 then round(quantile_cont(g, 0.975) filter (abs(g) <= 5), 5) end as hi from dr group by 1")
def g07(t: Tables):
    return rounded(resample.gamma_ci(series(t), "series", "k,lt,lc", _D), "lo", "hi", digits=5)


@query("g08_gamma_gates", f"with {_S}, g as (select series, count(*) filter (not censored) as usable, count(distinct conc) filter (not censored) as n_conc, -regr_slope(lt, lc) filter (not censored) as gamma from sp group by 1) select series, usable, n_conc, round(gamma, 6) as gamma, case when usable < 3 or n_conc < 3 then 'too_few' when gamma < 0 then 'non_physical' else 'ok' end as status from g")
def g08(t: Tables):
    ok = ~F.col("censored")
    g = series(t).groupBy("series").agg(F.count(F.when(ok, 1)).alias("usable"), F.countDistinct(F.when(ok, F.col("conc"))).alias("n_conc"), (-F.regr_slope(F.when(ok, F.col("lt")), F.when(ok, F.col("lc")))).alias("gamma"))
    return g.select("series", "usable", "n_conc", r6("gamma").alias("gamma"), F.when((F.col("usable") < 3) | (F.col("n_conc") < 3), "too_few").when(F.col("gamma") < 0, "non_physical").otherwise("ok").alias("status"))


@query("g12_gamma_significance", f"with {_S}, {_DRAW}, c as (select series, quantile_cont(g, 0.025) as lo, quantile_cont(g, 0.975) as hi from dr where abs(g) <= 5 group by 1) select series, lo > 0 or hi < 0 as significant from c")
def g12(t: Tables):
    c = resample.gamma_ci(series(t), "series", "k,lt,lc", _D, least=0).where("n_draws > 0")
    return c.select("series", ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("significant"))


@query("g14_gamma_points", f"with {_S} select series, k, round(lc, 6) as x, round(lt, 6) as y from sp where not censored")
def g14(t: Tables):
    return series(t).where("not censored").select("series", "k", r6("lc").alias("x"), r6("lt").alias("y"))


@query("e20_block_mammen", f"with {PTS}, n as (select curve_id, seq, ceil(pow(count(*) over (partition by curve_id), 1 / 3.0::double))::integer as len, row_number() over (partition by curve_id order by t, seq) - 1 as i from pts), w as (select curve_id, i // len as block, draw, case when ('0x' || substr(md5('mammen:' || curve_id || ':' || (i // len) || ':' || draw), 1, 12))::bigint / 281474976710656.0::double < (sqrt(5) + 1) / (2 * sqrt(5)) then -(sqrt(5) - 1) / 2 else (sqrt(5) + 1) / 2 end as weight from n, range(0, 3) r(draw)) select curve_id, draw::integer as draw, count(*) as n, round(sum(weight), 6) as total from w group by 1, 2")
def e20(t: Tables):
    p = t.points()
    w = Window.partitionBy("curve_id")
    p = p.withColumn("len", F.ceil(F.pow(F.count("*").over(w).cast("double"), F.lit(1 / 3.0))).cast("int")).withColumn("i", F.row_number().over(w.orderBy("t", "seq")) - 1)
    p = p.join(F.broadcast(t.spark.range(3).select(F.col("id").cast("int").alias("draw"))))
    p = p.withColumn("weight", resample.block_mammen(F.col("curve_id"), F.floor(F.col("i") / F.col("len")), F.col("draw")))
    return p.groupBy("curve_id", "draw").agg(F.count("*").alias("n"), r6(F.sum("weight")).alias("total"))


_LEV = f"with {PTS}, x as (select curve_id, seq, t - avg(t) over (partition by curve_id) as c, count(*) over (partition by curve_id) as n, t, min(t) over (partition by curve_id) as lo, max(t) over (partition by curve_id) as hi from pts), d as (select curve_id, seq, t, lo, hi, 1.0::double / n + c * c / sum(c * c) over (partition by curve_id) as lev from x)"


def leverage(t: Tables):
    """Leverage of each point in a straight-line basis, in closed form."""
    w = Window.partitionBy("curve_id")
    x = t.points().withColumn("c", F.col("t") - F.avg("t").over(w))
    return x.select("curve_id", "seq", "t", F.min("t").over(w).alias("lo"), F.max("t").over(w).alias("hi"), (1 / F.count("*").over(w) + F.col("c") * F.col("c") / F.sum(F.col("c") * F.col("c")).over(w)).alias("lev"))


@query("q01_information_density", f"{_LEV} select curve_id, round(sum(lev) filter ((t - lo) / (hi - lo) < 1 / 3.0::double) / sum(lev), 6) as lag, round(sum(lev) filter ((t - lo) / (hi - lo) >= 2 / 3.0::double) / sum(lev), 6) as plateau from d group by 1")
def q01(t: Tables):
    s = (F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    part = lambda c: F.sum(F.when(c, F.col("lev"))) / F.sum("lev")
    return leverage(t).groupBy("curve_id").agg(r6(part(s < 1 / 3.0)).alias("lag"), r6(part(s >= 2 / 3.0)).alias("plateau"))


@query("q02_redundancy", f"{_LEV}, r as (select *, sum(lev) over (partition by curve_id order by lev desc, seq rows unbounded preceding) / sum(lev) over (partition by curve_id) as run from d) select curve_id, round(pow(sum(lev), 2) / sum(lev * lev), 4) as n_eff, count(*) filter (run < 0.9) + 1 as n_for_90 from r group by 1")
def q02(t: Tables):
    w = Window.partitionBy("curve_id")
    r = leverage(t).withColumn("run", F.sum("lev").over(w.orderBy(F.desc("lev"), "seq").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("lev").over(w))
    return r.groupBy("curve_id").agg(F.round(F.pow(F.sum("lev"), 2) / F.sum(F.col("lev") * F.col("lev")), 4).alias("n_eff"), (F.count(F.when(F.col("run") < 0.9, 1)) + 1).alias("n_for_90"))


@query("q03_next_time", f"with {PTS}, s as (select curve_id, avg(t) as m, count(*) as n, var_pop(t) * count(*) as sxx, min(t) as lo, max(t) as hi from pts group by 1), g as (select curve_id, i::integer as step, 1.0::double / n + pow(lo + (hi - lo) * 1.5 * i / 10 - m, 2) / sxx as gain from s, range(0, 11) r(i)) select curve_id, arg_max(step, (round(gain, 9), step)) as step, round(max(gain), 6) as gain from g group by 1")
def q03(t: Tables):
    s = t.points().groupBy("curve_id").agg(F.avg("t").alias("m"), F.count("*").alias("n"), (F.var_pop("t") * F.count("*")).alias("sxx"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    g = s.join(F.broadcast(t.spark.range(11).select(F.col("id").cast("int").alias("step"))))
    g = g.withColumn("gain", 1 / F.col("n") + F.pow(F.col("lo") + (F.col("hi") - F.col("lo")) * 1.5 * F.col("step") / 10 - F.col("m"), 2) / F.col("sxx"))
    return g.groupBy("curve_id").agg(F.max_by("step", F.struct(F.round("gain", 9), F.col("step"))).alias("step"), r6(F.max("gain")).alias("gain"))


@query("q05_info_rollup", f"{_LEV}, c as (select curve_id, pow(sum(lev), 2) / sum(lev * lev) as n_eff from d group by 1) select count(*) as n, round(median(n_eff), 4) as median, round(quantile_cont(n_eff, 0.25), 4) as q25, round(quantile_cont(n_eff, 0.75), 4) as q75 from c")
def q05(t: Tables):
    c = leverage(t).groupBy("curve_id").agg((F.pow(F.sum("lev"), 2) / F.sum(F.col("lev") * F.col("lev"))).alias("n_eff"))
    q = lambda p: F.round(F.percentile("n_eff", F.lit(p)), 4)
    return c.agg(F.count("*").alias("n"), q(0.5).alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"))


@query("h02_mechanism_gates", f"{LADDER} select part, concat_ws(',', case when no_conc then 'assay_mass_unknown' when no_ph then 'assay_not_mass_proportional' end, case when tier <> 'scaling' then 'no_nucleated_transition' end, 'agitation_or_seeding_unknown') as gates, false as licensed from tier")
def h02(t: Tables):
    r = tier_of(t).select("part", F.when(~F.col("no_conc"), ~F.col("no_ph")).alias("mass"), F.when(F.col("tier") == "scaling", "threshold_driven").otherwise("flat").alias("regime"), F.lit(None).cast("boolean").alias("agitation"), F.lit(None).cast("boolean").alias("seeded"))
    return regimes.mechanism_gates(r).select("part", F.array_join("gates_failed", ",").alias("gates"), "licensed")


@query("h08_confidence", f"{FITS} select curve_id, case when r2 < 0.8 then 'low' when r2 >= 0.95 then 'high' else 'medium' end as confidence from winner")
def h08(t: Tables):

    b = bank.best_by_aicc(fits(t)).select("curve_id", "r2", F.lit(False).alias("anomalous"), F.lit(None).cast("double").alias("stability"))
    return regimes.confidence(b).select("curve_id", "confidence")


@query("h09_series_regime", f"{LADDER}, n as (select protein as series_id, tier, count(*) as n from tier group by 1, 2) select series_id, arg_min(tier, (-n, tier)) as modal, sum(n)::bigint as n_members, round(max(n)::double / sum(n), 6) as agreement from n group by 1")
def h09(t: Tables):
    m = tier_of(t).select(F.col("protein").alias("series_id"), F.col("tier").alias("regime"))
    return regimes.series_regime(m).select("series_id", "modal", "n_members", r6("agreement").alias("agreement"))
