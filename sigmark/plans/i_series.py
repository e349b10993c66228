"""Dose models, curvature, censoring, master curves, and joins of scaling exponents with what else is known."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tails
from ..operators import bank, resample
from ..sources.tables import Tables
from .b_triage_bank import _MONO, bank_sql, mono
from .g_scaling import _S, series
from .registry import COND, PTS, query, r6

_DOSE = "dose as (select protein, conc, t50 as rate from cond where assay = 'R' and line = 'F' group by all), dg as (select *, count(*) over (partition by protein) as n_pairs from dose), dp as (select protein as curve_id, conc / max(conc) over (partition by protein) as x, rate as y from dg where n_pairs >= 3)"
_DGRID = "grid(model, candidate, p1, p2, p3) as (values " + ", ".join(f"('{m}', {i}, {a!r}::double, {b!r}::double, {c!r}::double)" for m, i, a, b, c in bank.dose_candidates()) + ")"


def dose_points(t: Tables):
    """Distinct (dose, rate) pairs of rate rows, of proteins with three or more."""
    d = t.conditions().where("assay = 'R' and line = 'F'").select("protein", "conc", F.col("t50").alias("rate")).distinct()
    return d.withColumn("n_pairs", F.count("*").over(Window.partitionBy("protein"))).where("n_pairs >= 3")


@query("e10_dose_points", f"with {COND}, {_DOSE} select protein, count(*) as n_pairs, count(distinct conc) as n_doses, round(max(rate), 6) as max_rate from dg where n_pairs >= 3 group by 1")
def e10(t: Tables):
    return dose_points(t).groupBy("protein").agg(F.count("*").alias("n_pairs"), F.countDistinct("conc").alias("n_doses"), r6(F.max("rate")).alias("max_rate"))


@query("e09_dose_bank", f"with {COND}, {_DOSE}, {_DGRID}, {bank_sql('dp', 'curve_id')} select curve_id as protein, model, candidate, round(sse, 1) as sse, round(base, 3) as base, round(amp, 3) as amp from (select *, row_number() over (partition by curve_id, model order by sse, candidate) as rk from c) where rk = 1")
def e09(t: Tables):
    p = dose_points(t).select(F.col("protein").alias("curve_id"), (F.col("conc") / F.max("conc").over(Window.partitionBy("protein"))).alias("x"), F.col("rate").alias("y"))
    return bank.fit(p, bank.grid(t.spark, dose=True)).select(F.col("curve_id").alias("protein"), "model", "candidate", F.round("sse", 1).alias("sse"), F.round("base", 3).alias("base"), F.round("amp", 3).alias("amp"))


_CURV = f"""cv0 as (select series, count(*)::double as n, count(distinct round(lc, 6)) as k, covar_pop(lc, lc) as xx, covar_pop(lc * lc, lc * lc) as zz, covar_pop(lc, lc * lc) as xz, covar_pop(lc, lt) as xy, covar_pop(lc * lc, lt) as zy, covar_pop(lt, lt) as yy from sp where not censored group by 1),
cv1 as (select *, xx * zz - xz * xz as det, (zy * xx - xy * xz) / nullif(xx * zz - xz * xz, 0) as c, (xy * zz - zy * xz) / nullif(xx * zz - xz * xz, 0) as b from cv0 where k >= 4 and n > 3),
cv2 as (select *, c / sqrt(greatest((yy - b * xy - c * zy) * n / (n - 3) * xx / (n * det), 1e-30)) as tstat from cv1 where det > 1e-12),
curv as (select series, n::bigint as n, c, tstat, 2 * {tails.norm_sf_sql('abs(tstat)')} as p from cv2)"""


def curvature(points, by: str):
    """Quadratic term of log t50 on log concentration over uncensored points, by normal equations of centred sums."""
    x, z, y = F.col("lc"), F.col("lc") * F.col("lc"), F.col("lt")
    s = points.where("not censored").groupBy(by).agg(F.count("*").cast("double").alias("n"), F.countDistinct(F.round("lc", 6)).alias("k"), F.covar_pop(x, x).alias("xx"), F.covar_pop(z, z).alias("zz"), F.covar_pop(x, z).alias("xz"), F.covar_pop(x, y).alias("xy"), F.covar_pop(z, y).alias("zy"), F.covar_pop(y, y).alias("yy")).where("k >= 4 and n > 3")
    s = s.withColumn("det", F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")).where("det > 1e-12")
    s = s.withColumns({"c": F.expr("(zy * xx - xy * xz) / det"), "b": F.expr("(xy * zz - zy * xz) / det")})
    s = s.withColumn("tstat", F.expr("c / sqrt(greatest((yy - b * xy - c * zy) * n / (n - 3) * xx / (n * det), 1e-30D))"))
    return s.withColumn("p", 2 * tails.norm_sf(F.abs("tstat"))).select(by, F.col("n").cast("long").alias("n"), "c", "tstat", "p")


@query("g04_curvature_test", f"with {_S}, {_CURV} select series, n, round(c, 4) as curvature, round(tstat, 3) as t_stat, round(p, 4) as p, p < 0.05 as significant from curv")
def g04(t: Tables):
    c = curvature(series(t), "series")
    return c.select("series", "n", F.round("c", 4).alias("curvature"), F.round("tstat", 3).alias("t_stat"), F.round("p", 4).alias("p"), (F.col("p") < 0.05).alias("significant"))


#: Permutations of the censoring test.
PERMS = 199
_PERM = f"pm as (select series, k, lc, censored, perm, row_number() over (partition by series, perm order by md5('perm:' || perm || ':' || series || ':' || k), k, lc) as r, count(*) filter (censored) over (partition by series, perm) as nc from sp, range(0, {PERMS}) z(perm)), pc as (select series, perm, round(corr(lc, case when r <= nc then 1 else 0 end), 9) as c from pm group by 1, 2), oc as (select series, round(corr(lc, case when censored then 1 else 0 end), 9) as obs, count(*) filter (censored) as nc, count(*) filter (not censored) as nu from sp group by 1)"


@query("g05_informative_censoring", f"with {_S}, {_PERM} select series, nc as n_censored, round(any_value(obs), 5) as correlation, round((count(*) filter (abs(c) >= abs(obs)) + 1) / {PERMS + 1}.0::double, 6) as p from oc join pc using (series) where nc >= 2 and nu >= 2 group by 1, 2")
def g05(t: Tables):
    """Is the censor flag correlated with log concentration?  In each permutation the flags go to the rows with the least hashes."""
    sp = series(t)
    oc = sp.groupBy("series").agg(F.round(F.corr("lc", F.col("censored").cast("int")), 9).alias("obs"), F.count(F.when(F.col("censored"), 1)).alias("nc"), F.count(F.when(~F.col("censored"), 1)).alias("nu")).where("nc >= 2 and nu >= 2")
    c = resample.flag_correlations(sp, "series", "k", "lc", "censored", PERMS).withColumn("c", F.round("c", 9)).join(oc, "series")
    g = c.groupBy("series", F.col("nc").alias("n_censored")).agg(F.first("obs").alias("obs"), F.count(F.when(F.abs("c") >= F.abs("obs"), 1)).alias("hits"))
    return g.select("series", "n_censored", F.round("obs", 5).alias("correlation"), r6((F.col("hits") + 1) / (PERMS + 1)).alias("p"))


_GST = "gst as (select series, count(*) filter (not censored) as usable, count(distinct conc) filter (not censored) as n_conc, -regr_slope(lt, lc) filter (not censored) as gamma from sp group by 1)"


@query("h03_degeneracy", f"with {_S}, {_GST}, {_CURV} select gst.series, case when usable < 3 or n_conc < 3 then 'broad_gamma_unavailable' when coalesce(p < 0.05, false) then 're_broadened_saturating_or_mcrit' when gamma >= 0 and gamma <= 5 and n_conc >= 4 then 'evidence_reduced_by_reliable_gamma' else 'broad_gamma_unreliable' end as degeneracy from gst left join curv using (series)")
def h03(t: Tables):
    ok = ~F.col("censored")
    g = series(t).groupBy("series").agg(F.count(F.when(ok, 1)).alias("usable"), F.countDistinct(F.when(ok, F.col("conc"))).alias("n_conc"), (-F.regr_slope(F.when(ok, F.col("lt")), F.when(ok, F.col("lc")))).alias("gamma"))
    r = g.join(curvature(series(t), "series").select("series", "p"), "series", "left")
    c = F.col
    return r.select("series", F.when((c("usable") < 3) | (c("n_conc") < 3), "broad_gamma_unavailable").when(F.coalesce(c("p") < 0.05, F.lit(False)), "re_broadened_saturating_or_mcrit").when(c("gamma").between(0, 5) & (c("n_conc") >= 4), "evidence_reduced_by_reliable_gamma").otherwise("broad_gamma_unreliable").alias("degeneracy"))


# master curves: series of ten users each; the concentration of a user is its place in the series
_KS, _AS, _GS = [2.0, 4.0, 8.0, 16.0], [90.0, 180.0, 360.0, 540.0], [0.0, 0.25, 0.5, 1.0]
_COL = f"""mem as (select curve_id, curve_id % 10 as series, 1 + curve_id // 10 as conc, t, y from mono),
cg as (select k, a, g from (values {', '.join(f'({k}::double)' for k in _KS)}) x(k), (values {', '.join(f'({a}::double)' for a in _AS)}) y(a), (values {', '.join(f'({g}::double)' for g in _GS)}) z(g)),
cs as (select series, curve_id, k, a, g, count(*)::double as n, sum(s) as sg, sum(s * s) as sgg, sum(y) as sy, sum(s * y) as sgy, sum(y * y) as syy from (select *, 1 / (1 + exp(greatest(-50.0, least(50.0, -k * (t / (a * pow(conc, -g)) - 1))))) as s from mem, cg) group by all),
cr as (select series, k, a, g, sum(n - sg * sg / sgg) as den, sum(sy - sg * sgy / sgg) as num, sum(syy - sgy * sgy / sgg) as rest, sum(syy) - sum(sy) * sum(sy) / sum(n) as sst from cs where sgg > 1e-12 group by all),
cf as (select *, round(rest - case when den > 1e-9 then num * num / den else 0 end, 6) as sse from cr),
col as (select series, arg_min(g, (sse, k, a, g)) as gamma, arg_min(k, (sse, k, a, g)) as k, arg_min(a, (sse, k, a, g)) as a, min(sse) as sse, any_value(sst) as sst from cf group by 1),
coll as (select *, 1 - sse / sst as r2 from col)"""


def members(t: Tables):
    return mono(t).select("curve_id", (F.col("curve_id") % 10).alias("series"), F.expr("1 + curve_id div 10").alias("conc"), "t", "x", "y")


def collapse(points):
    """A series' curves on one master curve in t / t50(m), t50 = a m**-g: k, a and g from a grid; the shared base and each curve's amplitude drop out of the sums."""
    spark = points.sparkSession
    grid = spark.createDataFrame([(k, a, g) for k in _KS for a in _AS for g in _GS], "k double, a double, g double")
    s = 1 / (1 + bank.clipped_exp(-F.col("k") * (F.col("t") / (F.col("a") * F.pow(F.col("conc").cast("double"), -F.col("g"))) - 1)))
    rows = points.join(F.broadcast(grid)).withColumn("s", s)
    cs = rows.groupBy("series", "curve_id", "k", "a", "g").agg(F.count("*").cast("double").alias("n"), F.sum("s").alias("sg"), F.sum(F.col("s") * F.col("s")).alias("sgg"), F.sum("y").alias("sy"), F.sum(F.col("s") * F.col("y")).alias("sgy"), F.sum(F.col("y") * F.col("y")).alias("syy")).where("sgg > 1e-12")
    cr = cs.groupBy("series", "k", "a", "g").agg(F.expr("sum(n - sg * sg / sgg)").alias("den"), F.expr("sum(sy - sg * sgy / sgg)").alias("num"), F.expr("sum(syy - sgy * sgy / sgg)").alias("rest"), F.expr("sum(syy) - sum(sy) * sum(sy) / sum(n)").alias("sst"))
    cf = cr.withColumn("sse", F.round(F.col("rest") - F.when(F.col("den") > 1e-9, F.col("num") * F.col("num") / F.col("den")).otherwise(0.0), 6))
    best = cf.groupBy("series").agg(F.min_by(F.struct("g", "k", "a", "sse", "sst"), F.struct("sse", "k", "a", "g")).alias("b"))
    return best.select("series", F.col("b.g").alias("gamma"), "b.k", "b.a", "b.sse", "b.sst", (1 - F.col("b.sse") / F.col("b.sst")).alias("r2"))


@query("g09_collapse", f"with {PTS}, {_MONO}, {_COL} select series, gamma, k, a, round(r2, 4) as r2, r2 < 0.8 as poor from coll")
def g09(t: Tables):
    return collapse(members(t)).select("series", "gamma", "k", "a", F.round("r2", 4).alias("r2"), (F.col("r2") < 0.8).alias("poor"))


_DUAL = f"""{_COL}, hw as (select curve_id, t, y, lead(t) over w as nt, lead(y) over w as ny, min(y) over z + 0.5 * (max(y) over z - min(y) over z) as goal from mono window w as (partition by curve_id order by t), z as (partition by curve_id)),
ht as (select curve_id, arg_min(hit, t) as t50 from (select *, case when y = goal then t when (y - goal) * (ny - goal) < 0 then t + (goal - y) / (ny - y) * (nt - t) end as hit from hw where nt is not null) where hit is not null group by 1),
rg as (select curve_id % 10 as series, -regr_slope(log10(t50), log10(1 + curve_id // 10)) as gamma_reg, count(*) as n_curves from ht where t50 > 0 group by 1 having count(distinct curve_id) >= 3),
dual as (select coll.series, gamma_reg, gamma as gamma_global, abs(gamma_reg - gamma) as gap, r2, n_curves from coll left join rg using (series))"""


def dual(t: Tables):
    """Both exponents of each series side by side: regression of half-times, and the master curve."""
    m = members(t)
    half = bank.first_crossing(m.select("curve_id", "t", "y"), 0.5, "t", "y").where("at > 0")
    r = half.groupBy((F.col("curve_id") % 10).alias("series")).agg((-F.regr_slope(F.log10("at"), F.log10(F.expr("1 + curve_id div 10").cast("double")))).alias("gamma_reg"), F.count("*").alias("n_curves")).where("n_curves >= 3")
    d = collapse(m).select("series", F.col("gamma").alias("gamma_global"), "r2").join(r, "series", "left")
    return d.withColumn("gap", F.abs(F.col("gamma_reg") - F.col("gamma_global")))


@query("g10_disagreement", f"with {PTS}, {_MONO}, {_DUAL} select series, round(gap, 4) as gap, coalesce(gap > 0.3, false) as pointwise, r2 < 0.8 as poor, coalesce(gap > 0.3, false) or r2 < 0.8 as disagree, concat_ws(',', case when gap > 0.3 then 'pointwise_gap' end, case when r2 < 0.8 then 'poor_collapse' end) as reasons from dual")
def g10(t: Tables):
    wide, poor = F.coalesce(F.col("gap") > 0.3, F.lit(False)), F.col("r2") < 0.8
    return dual(t).select("series", F.round("gap", 4).alias("gap"), wide.alias("pointwise"), poor.alias("poor"), (wide | poor).alias("disagree"), F.concat_ws(",", F.when(wide, "pointwise_gap"), F.when(poor, "poor_collapse")).alias("reasons"))


@query("g11_dual_gamma", f"with {PTS}, {_MONO}, {_DUAL} select series, n_curves, round(gamma_reg, 4) as gamma_regression, gamma_global, round(r2, 4) as collapse_r2 from dual")
def g11(t: Tables):
    return dual(t).select("series", "n_curves", F.round("gamma_reg", 4).alias("gamma_regression"), "gamma_global", F.round("r2", 4).alias("collapse_r2"))


_PROP = "prop as (select protein, any_value(construct) as pconstruct, min(assay) as passay, avg(t50) as propensity from cond where line = 'F' group by 1)"


@query("j03_refusal_gate", f"with {COND}, {_PROP} select seq, case when pr.protein is null then 'no_record' when passay <> assay then 'assay_mismatch' when pc <> construct then 'construct_mismatch' else 'attached' end as verdict, case when passay <> assay then passay when pc <> construct then pc end as foreign_key from cond left join (select protein, min(construct) as pc, min(assay) as passay from cond where line = 'F' group by 1) pr using (protein)")
def j03(t: Tables):
    """Assay is tested before construct; a refused row keeps the reason and what the record has instead."""
    c = t.conditions()
    rec = c.where("line = 'F'").groupBy("protein").agg(F.min("construct").alias("pc"), F.min("assay").alias("passay"), F.lit(True).alias("known"))
    j = c.join(rec, "protein", "left")
    bad_a, bad_c = F.col("passay") != F.col("assay"), F.col("pc") != F.col("construct")
    return j.select("seq", F.when(F.col("known").isNull(), "no_record").when(bad_a, "assay_mismatch").when(bad_c, "construct_mismatch").otherwise("attached").alias("verdict"), F.when(bad_a, F.col("passay")).when(bad_c, F.col("pc")).alias("foreign_key"))


_GAM = "gam as (select protein || '/' || assay as series_id, -regr_slope(log10(t50), log10(conc)) as gamma from cond group by 1), ser as (select distinct protein || '/' || assay as series_id, protein, assay from cond)"


@query("j06_gamma_join", f"with {COND}, {_GAM} select c.protein, c.assay, count(*) as n_rows, round(any_value(gamma), 5) as gamma from cond c left join (select protein, assay, gamma from gam join ser using (series_id)) g using (protein, assay) group by 1, 2")
def j06(t: Tables):
    """A row of exponents knows its assay through its series."""
    c = t.conditions()
    name = F.concat_ws("/", "protein", "assay")
    g = c.groupBy(name.alias("series_id")).agg((-F.regr_slope(F.log10("t50"), F.log10("conc"))).alias("gamma"))
    known = g.join(c.select(name.alias("series_id"), "protein", "assay").distinct(), "series_id").drop("series_id")
    return c.groupBy("protein", "assay").agg(F.count("*").alias("n_rows")).join(known, ["protein", "assay"], "left").withColumn("gamma", F.round("gamma", 5))


@query("j08_alias_match", "with a as (select distinct lower(p_name) as name from part), e as (select * from (values ('bolt', 'Small BOLT'), ('cold', 'cold'), ('widget', 'Widget'), ('gear', 'gear'), ('nothing', 'unobtainium')) v(entry, alias)), h as (select entry, name, name = lower(alias) as exact from e join a on contains(name, lower(alias))) select entry, name, exact from h where exact or entry not in (select entry from h where exact)")
def j08(t: Tables):
    """Exact lower-case matches of an alias; names that contain it only where there is none.  Aliases are a registry of a few rows."""
    known = t.spark.createDataFrame([("bolt", "Small BOLT"), ("cold", "cold"), ("widget", "Widget"), ("gear", "gear"), ("nothing", "unobtainium")], "entry string, alias string")
    names = t.part.select(F.lower("p_name").alias("name")).distinct()
    h = names.join(F.broadcast(known), F.col("name").contains(F.lower("alias"))).select("entry", "name", (F.col("name") == F.lower("alias")).alias("exact"))
    return h.withColumn("any_exact", F.max("exact").over(Window.partitionBy("entry"))).where("exact or not any_exact").drop("any_exact")


_POL = [("sharpness", 3.0, 5.7), ("lag_ratio", 0.9, 0.97), ("misfit_r2", 0.95, 0.90), ("max_discount", 0.05, 0.07)]


@query("j13_policy_lookup", f"with {COND}, pol(name, previous, applied) as (values {', '.join(f'(\'{n}\', {a}::double, {b}::double)' for n, a, b in _POL)}) select protein, count(*) filter (ph / 100 <= applied) as n_pass, count(*) filter (ph / 100 <= previous) as n_pass_before, any_value(applied) as threshold from cond, pol where name = 'max_discount' group by 1")
def j13(t: Tables):
    """The value in force and the one before it, by name, and how many rows either lets pass."""
    pol = t.spark.createDataFrame(_POL, "name string, previous double, applied double").where("name = 'max_discount'")
    r = t.conditions().join(F.broadcast(pol))
    share = F.col("ph") / 100
    return r.groupBy("protein").agg(F.count(F.when(share <= F.col("applied"), 1)).alias("n_pass"), F.count(F.when(share <= F.col("previous"), 1)).alias("n_pass_before"), F.first("applied").alias("threshold"))


_COH = "coh as (select protein, count(*) as n, count(distinct construct) as n_construct, count(distinct assay) as n_assay, count(distinct conc) as n_conc, count(distinct temp) as n_temp, min(t50) as lo, max(t50) as hi, -regr_slope(log10(t50), log10(conc)) as gamma, avg(ln(t50)) as mu, stddev_samp(ln(t50)) as sd from cond group by protein, study)"


def _cohorts(t: Tables):
    """Gate, mode and licensed analysis of each (protein, study) cohort."""
    # whether values vary is told by the least and the most of them; one distinct count needs no row for each, as several do
    varies = lambda c: F.min(c) < F.max(c)
    rows = t.conditions().select("protein", "study", "assay", "conc", "temp", F.log10("t50").alias("x"), F.log10("conc").alias("lconc"), F.ln("t50").alias("ln"))
    g = rows.groupBy("protein", "study").agg(F.count("*").alias("n"), (F.countDistinct("assay") > 1).alias("assays"), varies("conc").alias("concs"), varies("temp").alias("temps"), (-F.regr_slope("x", "lconc")).alias("gamma"), F.avg("ln").alias("mu"))
    assays, concs, temps = (F.coalesce(c, F.lit(False)) for c in ("assays", "concs", "temps"))
    mode = F.when(F.col("n") < 3, "too_small").when(assays, F.when(concs, "confounded").otherwise("condition")).when(concs & temps, "confounded").when(concs, "series").when(temps, "condition").otherwise("replicates")
    return g.withColumn("mode", mode)


_CM = "cm as (select *, case when n < 3 then 'too_small' when n_assay > 1 then case when n_conc > 1 then 'confounded' else 'condition' end when n_conc > 1 and n_temp > 1 then 'confounded' when n_conc > 1 then 'series' when n_temp > 1 then 'condition' else 'replicates' end as mode from (select protein, study, count(*) as n, count(distinct assay) as n_assay, count(distinct conc) as n_conc, count(distinct temp) as n_temp, -regr_slope(log10(t50), log10(conc)) as gamma, avg(ln(t50)) as mu from cond group by 1, 2))"


@query("c08_cohorts", f"with {COND}, {_CM} select protein, study, n, mode, mode in ('series', 'condition', 'replicates') as licensed, round(case when mode = 'series' then gamma when mode in ('replicates', 'condition') then exp(mu) end, 4) as value from cm")
def c08(t: Tables):
    c = F.col
    value = F.when(c("mode") == "series", c("gamma")).when(c("mode").isin("replicates", "condition"), F.exp("mu"))
    return _cohorts(t).select("protein", "study", "n", "mode", c("mode").isin("series", "condition", "replicates").alias("licensed"), F.round(value, 4).alias("value"))


@query("y09_cohort_request", f"with {COND}, {_CM} select protein, mode, count(*) as n_cohorts, sum(n)::bigint as n_rows, case mode when 'too_small' then 'refused: fewer than three curves' when 'confounded' then 'refused: more than one axis varies' else 'ok' end as answer from cm group by all")
def y09(t: Tables):
    g = _cohorts(t).groupBy("protein", "mode").agg(F.count("*").alias("n_cohorts"), F.sum("n").alias("n_rows"))
    return g.withColumn("answer", F.when(F.col("mode") == "too_small", "refused: fewer than three curves").when(F.col("mode") == "confounded", "refused: more than one axis varies").otherwise("ok"))


_TAU = "ef as (select protein, study, avg(ln(t50)) as y, (0.05 + avg(tax)) * (0.05 + avg(tax)) / count(*) as v from cond group by 1, 2), w as (select protein, count(*)::double as k, sum(1 / v) as w1, sum(1 / (v * v)) as w2, sum(1 / (v * v * v)) as w3, sum(y / v) as wy, sum(y * y / v) as wyy from ef group by 1), q as (select *, wyy - wy * wy / w1 as q, w1 - w2 / w1 as c from w where k >= 3), t2 as (select *, greatest(0, (q - (k - 1)) / c) as tau2 from q), ci as (select *, sqrt(2 * (k - 1) + 4 * tau2 * c + 2 * tau2 * tau2 * (w2 - 2 * w3 / w1 + w2 * w2 / (w1 * w1))) / c as se from t2)"


@query("k06_tau2_interval", f"with {COND}, {_TAU} select protein, k::bigint as k, round(tau2, 5) as tau2, round(greatest(0, tau2 - 1.96 * se), 5) as lo, round(tau2 + 1.96 * se, 5) as hi from ci")
def k06(t: Tables):
    """An interval for the variance between studies, from the moment estimator's own variance: sums of w, w**2 and w**3."""
    e = t.conditions().groupBy("protein", "study").agg(F.avg(F.ln("t50")).alias("y"), (F.pow(0.05 + F.avg("tax"), 2) / F.count("*")).alias("v"))
    w = e.groupBy("protein").agg(F.count("*").cast("double").alias("k"), F.expr("sum(1 / v)").alias("w1"), F.expr("sum(1 / (v * v))").alias("w2"), F.expr("sum(1 / (v * v * v))").alias("w3"), F.expr("sum(y / v)").alias("wy"), F.expr("sum(y * y / v)").alias("wyy")).where("k >= 3")
    w = w.withColumns({"q": F.expr("wyy - wy * wy / w1"), "c": F.expr("w1 - w2 / w1")}).withColumn("tau2", F.expr("greatest(0D, (q - (k - 1)) / c)"))
    w = w.withColumn("se", F.expr("sqrt(2 * (k - 1) + 4 * tau2 * c + 2 * tau2 * tau2 * (w2 - 2 * w3 / w1 + w2 * w2 / (w1 * w1))) / c"))
    return w.select("protein", F.col("k").cast("long").alias("k"), F.round("tau2", 5).alias("tau2"), F.round(F.greatest(F.lit(0.0), F.col("tau2") - 1.96 * F.col("se")), 5).alias("lo"), F.round(F.col("tau2") + 1.96 * F.col("se"), 5).alias("hi"))


@query("l05_gamma_surface", f"with {COND}, {_GAM} select protein, assay, count(distinct construct) as n_constructs, round(any_value(gamma), 5) as gamma, any_value(gamma) is not null and any_value(gamma) >= 0 as attached from cond join ser using (protein, assay) left join gam using (series_id) group by 1, 2")
def l05(t: Tables):
    c = t.conditions()
    g = c.groupBy("protein", "assay").agg(F.countDistinct("construct").alias("n_constructs"), (-F.regr_slope(F.log10("t50"), F.log10("conc"))).alias("gamma"))
    return g.select("protein", "assay", "n_constructs", F.round("gamma", 5).alias("gamma"), (F.col("gamma").isNotNull() & (F.col("gamma") >= 0)).alias("attached"))


_AXES = {"temp": "A", "ph": "N", "tax": "R"}


@query("l06_sequence_axes", f"with {COND} select protein, axis, endpoint, round(avg(v), 6) as value, count(*) filter (assay = endpoint) as n_same_endpoint, count(*) filter (assay = endpoint) >= 3 as comparable from (" + " union all ".join(f"select protein, assay, '{a}' as axis, '{e}' as endpoint, {a} as v from cond" for a, e in _AXES.items()) + ") group by all")
def l06(t: Tables):
    """Predictors are kept apart; one is compared with measurements only of its own endpoint."""
    c = t.conditions()
    long = c.select("protein", "assay", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(e).alias("endpoint"), F.col(a).alias("v")) for a, e in _AXES.items()])).alias("x")).select("protein", "assay", "x.*")
    g = long.groupBy("protein", "axis", "endpoint").agg(r6(F.avg("v")).alias("value"), F.count(F.when(F.col("assay") == F.col("endpoint"), 1)).alias("n_same_endpoint"))
    return g.withColumn("comparable", F.col("n_same_endpoint") >= 3)


@query("l07_structure_linkage", f"with {COND}, s as (select distinct protein, construct from cond), r as (select *, row_number() over (partition by protein order by construct) as r, count(*) over (partition by protein) as n from s) select protein, n as n_structures, string_agg(construct, '|' order by construct) as shown, n > 5 as more from r where r <= 5 group by 1, 2")
def l07(t: Tables):
    """The first five structures of each protein by name, and whether there are more."""
    s = t.conditions().select("protein", "construct").distinct()
    n = s.groupBy("protein").agg(F.count("*").alias("n_structures"))
    top = s.withColumn("r", F.row_number().over(Window.partitionBy("protein").orderBy("construct"))).where("r <= 5").groupBy("protein").agg(F.array_join(F.sort_array(F.collect_list("construct")), "|").alias("shown"))
    return top.join(n, "protein").select("protein", "n_structures", "shown", (F.col("n_structures") > 5).alias("more"))
