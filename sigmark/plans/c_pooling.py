"""Partial pooling, meta-analysis and propensity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tails
from ..operators import pooling, regression, selection
from ..operators.graph import cut, small
from ..sources.tables import Tables
from .registry import query, r6, rounded

# studies = suppliers, proteins = brands
_U = "u as (select p_brand as protein, l_suppkey as study, s_nationkey as author, ln(l_extendedprice) as theta, l_extendedprice as raw, pow(0.05 + l_tax, 2) as s2, log10(l_quantity) as lconc, l_discount as ph, l_returnflag as assay, l_linestatus = 'F' as mutant, l_quantity as conc, p_size::double as temp from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey)"


def units(t: Tables):
    item = t.lineitem.select("l_partkey", F.col("l_suppkey").alias("study"), F.log("l_extendedprice").alias("theta"), F.col("l_extendedprice").alias("raw"), F.pow(0.05 + F.col("l_tax"), 2).alias("s2"), F.log10("l_quantity").alias("lconc"), F.col("l_discount").alias("ph"), F.col("l_returnflag").alias("assay"), (F.col("l_linestatus") == "F").alias("mutant"), F.col("l_quantity").alias("conc"))
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("protein"), F.col("p_size").cast("double").alias("temp"))
    sup = t.supplier.select(F.col("s_suppkey").alias("study"), F.col("s_nationkey").alias("author"))
    return item.join(part, "l_partkey").join(sup, "study").drop("l_partkey")


def dl_sql(table: str, keys: str, name: str) -> str:
    on = " and ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    sel = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""{name}0 as (select {keys}, count(*) as k, sum(1 / s2) as sw, sum(theta / s2) as swt, sum(theta * theta / s2) as swtt, sum(1 / (s2 * s2)) as sww from {table} group by {keys}),
{name}1 as (select *, case when k > 1 then greatest(0.0, swtt - swt * swt / sw) else 0.0 end as q from {name}0),
{name}2 as (select *, case when k > 1 and sw - sww / sw > 1e-9 then greatest(0.0, (q - (k - 1)) / (sw - sww / sw)) else 0.0 end as tau2 from {name}1),
{name} as (select {sel}, any_value(b.k) as k, any_value(b.q) as q, any_value(b.tau2) as tau2, sum(theta / (s2 + tau2)) / sum(1 / (s2 + tau2)) as mu, sqrt(1 / sum(1 / (s2 + tau2))) as se from {table} a join {name}2 b on {on} group by {sel})"""


_DL = f"with {_U}, {dl_sql('u', 'protein, assay', 'dl')}"
KEYS = ["protein", "assay"]
_I2 = "case when k > 1 and q > 0 then greatest(0.0, (q - (k - 1)) / q) else 0.0 end"


@query("p01_poolable", f"with {_U} select protein, count(*) filter (assay = 'N' and raw > 20000) as n_poolable, count(*) filter (assay <> 'N') as n_censored from u group by 1")
def p01(t: Tables):
    ok = F.col("assay") == "N"
    return units(t).groupBy("protein").agg(F.count(F.when(ok & (F.col("raw") > 20000), 1)).alias("n_poolable"), F.count(F.when(~ok, 1)).alias("n_censored"))


@query("p02_sampling_sd", f"with {_U} select source, count(*) as n, round(avg(sd), 6) as mean_sd from (select case when s2 < 0.006 then 'selection_interval' when mutant then 'bootstrap_ci' else 'default' end as source, case when s2 < 0.006 then sqrt(s2) when mutant then sqrt(s2) * 1.1 else 0.15 end as sd from u) group by 1")
def p02(t: Tables):
    narrow = F.col("s2") < 0.006
    first, second = F.when(narrow, F.sqrt("s2")), F.when(F.col("mutant"), F.sqrt("s2") * 1.1)
    s = units(t).select(F.when(first.isNotNull(), "selection_interval").when(second.isNotNull(), "bootstrap_ci").otherwise("default").alias("source"), F.coalesce(first, second, F.lit(0.15)).alias("sd"))
    return s.groupBy("source").agg(F.count("*").alias("n"), r6(F.avg("sd")).alias("mean_sd"))


@query("p03_dersimonian_laird", f"{_DL} select protein, assay, k, round(mu, 6) as mu, round(tau2, 6) as tau2, round(q, 3) as q, round(se, 6) as se from dl")
def p03(t: Tables):
    return rounded(rounded(pooling.dersimonian_laird(units(t), KEYS), "mu", "tau2", "se"), "q", digits=3)


_SHRUNK = f"{_DL}, sh as (select u.*, k, mu, tau2, case when k < 3 then 1.0 else tau2 / (tau2 + s2) end as weight from u join dl using (protein, assay))"


@query("p04_shrink", f"{_SHRUNK} select protein, assay, study, count(*) as n, round(avg(weight), 6) as weight, round(avg(weight * theta + (1 - weight) * mu), 6) as pooled, round(avg(sqrt(weight * s2)), 6) as posterior_sd from sh group by 1, 2, 3")
def p04(t: Tables):
    u = units(t)
    s = pooling.shrink(u, pooling.dersimonian_laird(u, KEYS), KEYS)
    return s.groupBy("protein", "assay", "study").agg(F.count("*").alias("n"), *[r6(F.avg(c)).alias(c) for c in ("weight", "pooled", "posterior_sd")])


@query("p05_pool_stratum", f"with {_U}, {dl_sql('u', 'protein, assay, study, conc', 'dl')} select protein, assay, study, conc, count(*) as n, count(*) >= 3 as pooled_here, round(avg(case when k >= 3 then tau2 / (tau2 + s2) else 1 end), 6) as weight, round(avg(case when k >= 3 then tau2 / (tau2 + s2) * theta + (1 - tau2 / (tau2 + s2)) * mu else theta end), 6) as pooled from u join dl using (protein, assay, study, conc) group by 1, 2, 3, 4")
def p05(t: Tables):
    """Strata alike in all but the replicate: fewer than three units are not pooled and keep weight 1, flagged."""
    keys = [*KEYS, "study", "conc"]
    u = units(t).join(pooling.dersimonian_laird(units(t), keys), keys)
    enough = F.col("k") >= pooling.LEAST
    w = F.when(enough, F.col("tau2") / (F.col("tau2") + F.col("s2"))).otherwise(1.0)
    return u.groupBy(*keys).agg(F.count("*").alias("n"), (F.count("*") >= pooling.LEAST).alias("pooled_here"), r6(F.avg(w)).alias("weight"), r6(F.avg(F.when(enough, w * F.col("theta") + (1 - w) * F.col("mu")).otherwise(F.col("theta")))).alias("pooled"))


@query("p06_i_squared", f"{_DL} select protein, assay, round({_I2}, 6) as i2 from dl")
def p06(t: Tables):
    return pooling.dersimonian_laird(units(t), KEYS).select(*KEYS, r6(pooling.i_squared(F.col("q"), F.col("k"))).alias("i2"))


@query("p07_replicate_meta", f"with {_U}, {dl_sql('u', 'protein, conc', 'dl')}, r as (select protein, conc, count(*) as n, stddev_pop(raw) / avg(raw) as cv from u group by 1, 2 having count(*) >= 2) select protein, conc, n, round(mu, 6) as mu, round(cv, 6) as cv, cv > 0.5 as stochastic from dl join r using (protein, conc)")
def p07(t: Tables):
    return rounded(pooling.replicate_meta(units(t), ["protein", "conc"]).select("protein", "conc", "n", "mu", "cv", "stochastic"), "mu", "cv")


@query("p08_pool_gamma", f"with {_U}, g as (select protein, study, -regr_slope(theta, lconc) as theta, 0.09 as s2 from u group by 1, 2 having count(distinct conc) >= 3), {dl_sql('g', 'protein', 'dl')} select protein, k, round(mu, 6) as mu, round(tau2, 6) as tau2 from dl")
def p08(t: Tables):
    g = units(t).groupBy("protein", "study").agg((-F.regr_slope("theta", "lconc")).alias("theta"), F.countDistinct("conc").alias("n")).where("n >= 3").withColumn("s2", F.lit(0.09))
    return rounded(pooling.dersimonian_laird(g, ["protein"]).select("protein", "k", "mu", "tau2"), "mu", "tau2")


@query("p09_pooling_summary", f"{_SHRUNK} select count(*) as n, round(median(weight), 6) as median_weight, round(avg(weight), 6) as mean_weight, round(max(abs((1 - weight) * (mu - theta))), 6) as largest_move from sh")
def p09(t: Tables):
    u = units(t)
    s = pooling.shrink(u, pooling.dersimonian_laird(u, KEYS), KEYS)
    return s.agg(F.count("*").alias("n"), r6(F.median("weight")).alias("median_weight"), r6(F.avg("weight")).alias("mean_weight"), r6(F.max(F.abs(F.col("pooled") - F.col("theta")))).alias("largest_move"))


@query("k01_effects", f"with {_U} select protein, count(*) as n, count(distinct study) as n_studies, count(*) filter (mutant) as n_mutant, round(avg(theta), 6) as mean_effect, round(avg(s2), 8) as mean_s2 from u group by 1")
def k01(t: Tables):
    return units(t).groupBy("protein").agg(F.count("*").alias("n"), F.countDistinct("study").alias("n_studies"), F.count(F.when(F.col("mutant"), 1)).alias("n_mutant"), r6(F.avg("theta")).alias("mean_effect"), F.round(F.avg("s2"), 8).alias("mean_s2"))


@query("k02_usable_moderators", f"with {_U}, c as (select protein, study, count(distinct round_even(conc, 4)) as nc, count(distinct round_even(ph, 1)) as np, count(distinct mutant) as nm from u group by 1, 2) select protein, study, nc >= 3 as conc, np >= 2 as ph, nm >= 2 as construct from c")
def k02(t: Tables):
    c = units(t).groupBy("protein", "study").agg(F.countDistinct(F.bround("conc", 4)).alias("c"), F.countDistinct(F.bround("ph", 1)).alias("p"), F.countDistinct("mutant").alias("m"))
    return c.select("protein", "study", (F.col("c") >= 3).alias("conc"), (F.col("p") >= 2).alias("ph"), (F.col("m") >= 2).alias("construct"))


#: Moderators with the digits that tell their levels, flags, and levels that each needs.
NUMBERS, FLAGS, LEVELS = {"lconc": 4, "ph": 1, "temp": 1}, ["mutant"], {"lconc": 3, "ph": 2, "temp": 2, "mutant": 2}
MODERATORS = [*NUMBERS, *FLAGS]


def reg_sql(keys: str, name: str) -> str:
    """{name}d: units with centred moderators; {name}: their coefficients by keys, by a sweep over lists."""
    m = len(MODERATORS) + 2
    col = ["1.0", *[f"x_{c}" for c in MODERATORS], "theta"]
    matrix = "[" + ", ".join(f"sum({col[min(i, j)]} * {col[max(i, j)]} / s2)" for i in range(m) for j in range(m)) + "]"
    at = lambda i, j: f"s[{i} * {m} + {j} + 1]"
    k, pivot = "k[1]::bigint", f"s[k[1]::bigint * {m + 1} + 1]"
    first = f"s[{m * m} + 2 + {k}]"
    good = f"(abs({pivot}) >= {regression.LEAST} and abs({pivot}) >= {regression.RELATIVE} * abs({first}))"
    i, j = f"(e // {m})", f"(e % {m})"
    entry = f"case when e < {m * m} then case when k[2] = 1 and {good} then case when {i} = {k} and {j} = {k} then 1 / {pivot} when {i} = {k} then s[e + 1] / {pivot} when {j} = {k} then -s[e + 1] / {pivot} else s[e + 1] - {at(i, k)} * {at(k, j)} / {pivot} end else s[e + 1] end when e = {m * m} and k[2] = 1 and not {good} then 1.0 else s[e + 1] end"
    pivots = "[[0.0::double, 1.0], " + ", ".join(f"[{n}.0::double, use_{c}::integer::double]" for n, c in enumerate(MODERATORS, 1)) + "]"
    coef = [("intercept", 0), *[(c, n) for n, c in enumerate(MODERATORS, 1)]]
    out = []
    for c, n in coef:
        alone = (f"a[{m}] / a[1]", "sqrt(1 / a[1])") if n == 0 else ("null", "null")
        there = "true" if n == 0 else f"use_{c}"
        out.append(f"case when singular then {alone[0]} when {there} then s[{n * m + m}] end as b_{c}, case when singular then {alone[1]} when {there} then sqrt(s[{n * m + n + 1}]) end as se_{c}")
    levels = ", ".join([*[f"count(distinct round_even({c}, {d})) >= {LEVELS[c]} as use_{c}, avg({c}) as m_{c}" for c, d in NUMBERS.items()], *[f"count(distinct {c}) >= {LEVELS[c]} as use_{c}" for c in FLAGS]])
    xs = ", ".join([*[f"case when use_{c} then {c} - m_{c} else 0 end as x_{c}" for c in NUMBERS], *[f"case when use_{c} and {c} then 1.0 else 0.0 end as x_{c}" for c in FLAGS]])
    uses = ", ".join(f"use_{c}" for c in MODERATORS)
    return f"""{name}c as materialized (select {keys}, {levels} from u group by {keys}),
{name}d as materialized (select u.*, {uses}, {xs} from u join {name}c using ({keys})),
{name}a as materialized (select {keys}, {uses}, count(*) as n, {matrix} as a from {name}d group by {keys}, {uses}),
{name}s as materialized (select *, list_reduce({pivots}, lambda s, k: list_transform(range({m * m + 1 + m}), lambda e: {entry}), list_concat(a, [0.0::double, {', '.join(f'a[{q * (m + 1) + 1}]' for q in range(m))}])) as s from {name}a),
{name} as materialized (select {keys}, {uses}, n, {', '.join(out)}, singular from (select *, s[{m * m + 1}] > 0 or n < 1 + {' + '.join(f'use_{c}::integer' for c in MODERATORS)} as singular from {name}s))"""


def moderated(t: Tables, keys: list[str]):
    """Units with centred moderators, and the weighted regression of the effect on them by keys."""
    d = regression.centred(units(t), keys, NUMBERS, FLAGS, LEVELS)
    fit = regression.wls(d, keys, {c: F.col(f"x_{c}") for c in MODERATORS}, F.col("theta"), 1 / F.col("s2"), {c: F.col(f"use_{c}") for c in MODERATORS})
    return d, fit


_STRATA = "protein, study, author, assay, mutant"


@query("k03_wls", f"with {_U}, {reg_sql('protein', 'rg')}, {reg_sql(_STRATA, 'rs')}, b as (select protein, count(*) as n_strata, count(*) filter (singular) as n_singular, avg(b_intercept) filter (singular) as mean_alone from rs group by 1) select protein, n, singular, n_strata, n_singular, round(mean_alone, 6) as mean_alone, " + ", ".join(f"round(b_{c}, 5) as b_{c}, round(se_{c}, 5) as se_{c}" for c in ["intercept", *MODERATORS]) + " from rg join b using (protein)")
def k03(t: Tables):
    """Coefficients of each protein; and how many of its finest strata have a singular design, with the mean of the intercepts that these keep alone."""
    _, whole = moderated(t, ["protein"])
    _, fine = moderated(t, _STRATA.split(", "))
    few = fine.groupBy("protein").agg(F.count("*").alias("n_strata"), F.count(F.when(F.col("singular"), 1)).alias("n_singular"), r6(F.avg(F.when(F.col("singular"), F.col("b_intercept")))).alias("mean_alone"))
    return whole.join(few, "protein").select("protein", "n", "singular", "n_strata", "n_singular", "mean_alone", *[F.round(f"{x}_{c}", 5).alias(f"{x}_{c}") for c in ["intercept", *MODERATORS] for x in ("b", "se")])


_SHIFT = " + ".join(f"coalesce(b_{c}, 0) * x_{c}" for c in MODERATORS)
_STUDY = f"{reg_sql('protein', 'rg')}, ru as materialized (select d.*, theta - ({_SHIFT}) as resid from rgd d join (select * exclude ({', '.join(f'use_{c}' for c in MODERATORS)}) from rg) using (protein)), st as materialized (select protein, study, sum(resid / s2) / sum(1 / s2) as theta, 1 / sum(1 / s2) as s2, count(*) as n_units from ru group by 1, 2)"
STUDY = f"with {_U}, {_STUDY}"
_PM = "pm0 as materialized (select protein, k, tau2, mu as about from dl), " + ", ".join(
    f"pm{i + 1} as materialized (select protein, k, case when k > 1 and wwdd - 2 * wd / w * wwd + wd / w * wd / w * ww > 1e-30 then greatest(0.0, tau2 + (wdd - wd / w * wd - (k - 1)) / (wwdd - 2 * wd / w * wwd + wd / w * wd / w * ww)) else 0.0 end as tau2, about from (select protein, any_value(k) as k, any_value(tau2) as tau2, any_value(about) as about, sum(v) as w, sum(v * d) as wd, sum(v * d * d) as wdd, sum(v * v) as ww, sum(v * v * d) as wwd, sum(v * v * d * d) as wwdd from (select protein, k, tau2, about, 1 / (s2 + tau2) as v, theta - about as d from st join pm{i} using (protein)) group by 1))"
    for i in range(pooling.STEPS)
)
_SDL = f"{STUDY}, {dl_sql('st', 'protein', 'dl')}, {_PM}, re as materialized (select protein, any_value(p.k) as k, any_value(q) as q, any_value(p.tau2) as tau2, sum(st.theta / (s2 + p.tau2)) / sum(1 / (s2 + p.tau2)) as mu, sqrt(1 / sum(1 / (s2 + p.tau2))) as se from st join pm{pooling.STEPS} p using (protein) join dl using (protein) group by 1)"


def residuals(t: Tables):
    """Units with what is left of their effects when the moderators' share is taken away."""
    d, fit = moderated(t, ["protein"])
    share = sum((F.coalesce(f"b_{c}", F.lit(0.0)) * F.col(f"x_{c}") for c in MODERATORS), F.lit(0.0))
    fit = cut(fit.select("protein", *[f"b_{c}" for c in MODERATORS]), "moderators")
    return d.join(small(fit), "protein").withColumn("resid", F.col("theta") - share)


def studies(t: Tables, **more):
    """One effect a study, of the units' residuals; a table, since iterations read it again.  more are further aggregates of a study's units."""
    return cut(pooling.study_effects(residuals(t).withColumn("theta", F.col("resid")), ["protein"], **more), "studies")


@query("k04_study_effects", f"{STUDY} select protein, study, round(theta, 6) as theta, round(s2, 9) as s2, n_units from st")
def k04(t: Tables):
    return rounded(rounded(studies(t), "theta"), "s2", digits=9)


@query("k05_paule_mandel", f"{_SDL} select protein, k, round(tau2, 6) as tau2 from re")
def k05(t: Tables):
    return rounded(pooling.paule_mandel(studies(t), ["protein"]), "tau2")


@query("k07_heterogeneity", f"{_SDL} select protein, k, round(q, 3) as q, round({_I2}, 6) as i2, round(q / (k - 1), 4) as h2, round(case when q > 0 then {tails.chi2_sf_sql('q', '(k - 1)')} else 1.0 end, 5) as p from dl where k > 1")
def k07(t: Tables):
    h = pooling.heterogeneity(pooling.dersimonian_laird(studies(t), ["protein"]))
    return h.select("protein", "k", F.round("q", 3).alias("q"), r6("i2").alias("i2"), F.round("h2", 4).alias("h2"), F.round("p", 5).alias("p"))


@query("k08_pooled_effect", f"{_SDL} select protein, round(mu, 6) as mu, round(mu - 1.96 * se, 6) as lo, round(mu + 1.96 * se, 6) as hi, round(exp(mu), 2) as back from re")
def k08(t: Tables):
    d = pooling.random_effects(studies(t), ["protein"])
    return d.select("protein", r6("mu").alias("mu"), r6(F.col("mu") - 1.96 * F.col("se")).alias("lo"), r6(F.col("mu") + 1.96 * F.col("se")).alias("hi"), F.round(F.exp("mu"), 2).alias("back"))


@query("k09_blup", f"{_SDL} select protein, study, round(case when k < 3 then theta else tau2 / (tau2 + s2) * theta + s2 / (tau2 + s2) * mu end, 6) as blup from st join re using (protein)")
def k09(t: Tables):
    s = studies(t)
    return pooling.shrink(s, pooling.random_effects(s, ["protein"]), ["protein"]).select("protein", "study", r6("pooled").alias("blup"))


_SHARES = ["between_study", "within_study", "measurement", "construct"]


@query("k10_variance_decomposition", f"{_SDL}, w as (select protein, study, var_samp(resid) - avg(s2) as v from ru group by 1, 2 having count(*) >= 2), wi as (select protein, avg(greatest(0.0, v)) as within_study from w group by 1), m as (select protein, avg(s2) as measurement, avg(mutant::integer) as p from u group by 1), x as (select protein, re.tau2 as between_study, coalesce(within_study, 0) as within_study, measurement, coalesce(b_mutant * b_mutant * p * (1 - p), 0) as construct from re join m using (protein) join rg using (protein) left join wi using (protein)) select protein, " + ", ".join(f"round({c}, 6) as {c}, round({c} / ({' + '.join(_SHARES)}), 6) as share_{c}" for c in _SHARES) + " from x")
def k10(t: Tables):
    """Variance between studies, within them beyond sampling, of measurement, and of the construct, with their shares."""
    s = studies(t, v=F.greatest(F.lit(0.0), F.var_samp("resid") - F.avg("s2")), s2s=F.sum("s2"), known=F.count("s2"), mutants=F.count(F.when(F.col("mutant"), 1)), flags=F.count("mutant"), b_mutant=F.first("b_mutant"))
    m = s.groupBy("protein").agg(F.avg(F.when(F.col("n_units") >= 2, F.col("v"))).alias("within_study"), (F.sum("s2s") / F.sum("known")).alias("measurement"), (F.sum("mutants") / F.sum("flags")).alias("p"), F.first("b_mutant").alias("b_mutant"))
    j = pooling.random_effects(s, ["protein"]).select("protein", F.col("tau2").alias("between_study")).join(m, "protein")
    j = j.withColumns({"within_study": F.coalesce("within_study", F.lit(0.0)), "construct": F.coalesce(F.col("b_mutant") * F.col("b_mutant") * F.col("p") * (1 - F.col("p")), F.lit(0.0))})
    total = sum((F.col(c) for c in _SHARES[1:]), F.col(_SHARES[0]))
    return j.select("protein", *[r6(F.col(c)).alias(c) for c in _SHARES], *[r6(F.col(c) / total).alias(f"share_{c}") for c in _SHARES])


@query("k11_lab_effect", f"{STUDY}, a as (select protein, author, count(distinct study) as n, var_samp(st.theta) as v from st join supplier on study = s_suppkey, lateral (select s_nationkey as author) group by 1, 2) select protein, author, n, round(v, 6) as lab_variance, case when n >= 2 then 'estimated' else 'confounded' end as status from a")
def k11(t: Tables):
    s = studies(t).join(t.supplier.select(F.col("s_suppkey").alias("study"), F.col("s_nationkey").alias("author")), "study")
    g = s.groupBy("protein", "author").agg(F.countDistinct("study").alias("n"), F.var_samp("theta").alias("v"))
    return g.select("protein", "author", "n", r6(F.when(F.col("n") >= 2, F.col("v"))).alias("lab_variance"), F.when(F.col("n") >= 2, "estimated").otherwise("confounded").alias("status"))


_LOSO = f"""{_SDL}, sw as (select protein, count(*) as ns, sum(1 / s2) as sw, sum(theta / s2) as swt, sum(theta * theta / s2) as swtt, sum(1 / (s2 * s2)) as sww from st group by 1),
l0 as (select st.*, ns - 1 as k, sw - 1 / s2 as rw, swt - theta / s2 as rwt, swtt - theta * theta / s2 as rwtt, sww - 1 / (s2 * s2) as rww from st join sw using (protein) where ns > 1),
l1 as (select *, case when k > 1 then greatest(0.0, rwtt - rwt * rwt / rw) else 0.0 end as q from l0),
l2 as materialized (select *, case when k > 1 and rw - rww / rw > 1e-9 then greatest(0.0, (q - (k - 1)) / (rw - rww / rw)) else 0.0 end as t2 from l1),
l3 as (select l2.protein, l2.study, sum(st.theta / (st.s2 + t2)) / sum(1 / (st.s2 + t2)) as mu_without from l2 join st on l2.protein = st.protein and l2.study <> st.study group by 1, 2),
l4 as (select l2.*, mu_without, abs(mu_without - re.mu) as delta, (theta - re.mu) / sqrt(s2 + re.tau2) as r from l2 join l3 using (protein, study) join re using (protein)),
l5 as (select *, median(abs(r)) over (partition by protein) as usual, row_number() over (partition by protein order by round(delta, 9) desc, study) as place from l4)"""


@query("k12_leave_one_study_out", f"{_LOSO} select protein, study, round(mu_without, 5) as mu_without, round(t2, 5) as tau2_without, round(case when k > 1 and q > 0 then greatest(0.0, (q - (k - 1)) / q) else 0.0 end, 5) as i2_without, round(delta, 5) as delta, round(r, 5) as residual, abs(r) > 1.96 and abs(r) > 2 * (usual + 1e-9) as outlier, place = 1 as most_influential from l5")
def k12(t: Tables):
    s = studies(t)
    x = pooling.leave_one_out(s, ["protein"], pooling.random_effects(s, ["protein"]))
    return x.select("protein", "study", *[F.round(c, 5).alias(c) for c in ("mu_without", "tau2_without", "i2_without", "delta", "residual")], "outlier", "most_influential")


_T975 = "case when df <= 1 then 12.706 when df <= 2 then 4.303 when df <= 5 then 4.303 + (df - 2) * (2.571 - 4.303) / 3 when df <= 10 then 2.571 + (df - 5) * (2.228 - 2.571) / 5 when df <= 30 then 2.228 + (df - 10) * (2.042 - 2.228) / 20 when df <= 120 then 2.042 + (df - 30) * (1.98 - 2.042) / 90 else 1.96 end"


def t975(df):
    """The 97.5% t quantile, between tabled degrees of freedom by a straight line."""
    table = [(1, 12.706), (2, 4.303), (5, 2.571), (10, 2.228), (30, 2.042), (120, 1.98)]
    out = F.lit(1.96)
    for (a, x), (b, y) in reversed(list(zip(table, table[1:], strict=False))):
        out = F.when(df <= b, F.when(df <= a, x).otherwise(x + (df - a) * (y - x) / (b - a))).otherwise(out)
    return F.when(df <= 1, 12.706).when(df <= 2, 4.303).otherwise(out)


@query("b21_t975", f"select df, round({_T975}, 6) as t975 from (select distinct l_suppkey as df from lineitem)")
def b21(t: Tables):
    return t.lineitem.select(F.col("l_suppkey").alias("df")).distinct().select("df", r6(t975(F.col("df"))).alias("t975"))


@query("k13_prediction_interval", f"{_SDL}, x as (select *, k - 2 as df from re where k > 2) select protein, round(mu - {_T975} * sqrt(tau2 + se * se), 5) as lo, round(mu + {_T975} * sqrt(tau2 + se * se), 5) as hi from x")
def k13(t: Tables):
    d = pooling.random_effects(studies(t), ["protein"]).where("k > 2")
    half = t975(F.col("k") - 2) * F.sqrt(F.col("tau2") + F.col("se") * F.col("se"))
    return d.select("protein", F.round(F.col("mu") - half, 5).alias("lo"), F.round(F.col("mu") + half, 5).alias("hi"))


@query("k14_forest", f"{_SDL} select protein, study::varchar as label, round(theta, 6) as effect, round(100 * (1 / (s2 + tau2)) / sum(1 / (s2 + tau2)) over (partition by protein), 5) as weight_pct from st join re using (protein) union all select protein, 'pooled', round(mu, 6), 100.0 from re")
def k14(t: Tables):
    s = studies(t)
    d = pooling.random_effects(s, ["protein"])
    w = 1 / (F.col("s2") + F.col("tau2"))
    d = cut(d, "pooled")
    of = s.join(small(d.select("protein", "tau2")), "protein")
    total = cut(of.groupBy("protein").agg(F.sum(w).alias("total")), "weights")  # joined back, so no task holds all studies of a protein
    rows = of.join(small(total), "protein").select("protein", F.col("study").cast("string").alias("label"), r6("theta").alias("effect"), F.round(100 * w / F.col("total"), 5).alias("weight_pct"))
    return rows.unionByName(d.select("protein", F.lit("pooled").alias("label"), r6("mu").alias("effect"), F.lit(100.0).alias("weight_pct")))


@query("k15_egger", f"{STUDY}, r as (select protein, theta / sqrt(s2) as y, 1 / sqrt(s2) as x from st), g as (select protein, count(*) as k, regr_intercept(y, x) as b0, regr_syy(y, x) as syy, regr_sxx(y, x) as sxx, regr_sxy(y, x) as sxy, avg(x) as mx from r group by 1), e as (select *, sqrt(greatest(0.0, syy - sxy * sxy / sxx) / (k - 2) * (1.0 / k + mx * mx / sxx)) as se from g where k >= 3 and sxx > 0) select protein, k, round(b0, 3) as intercept, round(2 * {tails.t_sf_sql('abs(b0 / se)', '(k - 2)')}, 4) as p from e")
def k15(t: Tables):
    return pooling.egger(studies(t), ["protein"]).select("protein", "k", F.round("intercept", 3).alias("intercept"), F.round("p", 4).alias("p"))


@query("k16_moderators", f"with {_U}, {reg_sql('protein', 'rg')}, g as (select protein, -regr_slope(log10(raw), lconc) as gamma from u group by 1) select protein, " + ", ".join(f"round(b_{c}, 6) as b_{c}, round(se_{c}, 6) as se_{c}" for c in MODERATORS) + ", round(-b_lconc / ln(10), 6) as implied_gamma, round(gamma, 6) as scaling_gamma, round(-b_lconc / ln(10) - gamma, 6) as gamma_gap, round(exp(b_mutant), 6) as construct_fold from rg join g using (protein)")
def k16(t: Tables):
    """Coefficients of the moderators; the exponent that the concentration's implies beside that of the log-log slope; fold change of the construct."""
    gamma = units(t).groupBy("protein").agg((-F.regr_slope(F.log10("raw"), F.col("lconc"))).alias("scaling_gamma"))
    f = moderated(t, ["protein"])[1].join(gamma, "protein").withColumn("implied_gamma", -F.col("b_lconc") / F.log(F.lit(10.0)))
    f = f.withColumns({"gamma_gap": F.col("implied_gamma") - F.col("scaling_gamma"), "construct_fold": F.exp("b_mutant")})
    cols = [f"{x}_{c}" for c in MODERATORS for x in ("b", "se")] + ["implied_gamma", "scaling_gamma", "gamma_gap", "construct_fold"]
    return rounded(f.select("protein", *cols), *cols)


@query("k17_meta_status", f"with {_U}, c as (select assay, conc, count(distinct study) filter (raw > 90000) as n from u group by 1, 2) select assay, conc, n, case when n = 0 then 'no_data' when n = 1 then 'single_study' else 'pooled' end as status from c")
def k17(t: Tables):
    c = units(t).groupBy("assay", "conc").agg(F.countDistinct(F.when(F.col("raw") > 90000, F.col("study"))).alias("n"))
    return c.withColumn("status", F.when(F.col("n") == 0, "no_data").when(F.col("n") == 1, "single_study").otherwise("pooled"))


_G = f"with {_U}, g as (select protein, study, assay, median(raw) filter (not mutant) as t50, count(*) filter (mutant) as n_bounds, count(*) as n from u group by 1, 2, 3)"


def groups(t: Tables):
    m = F.col("mutant")
    return units(t).groupBy("protein", "study", "assay").agg(F.median(F.when(~m, F.col("raw"))).alias("t50"), F.count(F.when(m, 1)).alias("n_bounds"), F.count("*").alias("n"))


@query("l01_propensity_groups", f"{_G} select protein, study, assay, round(t50, 4) as t50, n_bounds, t50 is null as censored_only from g")
def l01(t: Tables):
    return groups(t).select("protein", "study", "assay", F.round("t50", 4).alias("t50"), "n_bounds", F.col("t50").isNull().alias("censored_only"))


@query("l02_hazen_rank", f"{_G} select protein, study, assay, round(100 * (rank() over (partition by assay order by t50) - 1 + 0.5 * count(*) over (partition by assay, t50)) / count(*) over (partition by assay), 6) as percentile from g where t50 is not null")
def l02(t: Tables):
    """Mid-rank percentile among all groups of the assay."""
    g = selection.hazen(cut(groups(t).where("t50 is not null"), "groups"), ["assay"], "t50")
    return g.select("protein", "study", "assay", r6("percentile").alias("percentile"))


@query("l03_intrinsic_anchor", f"{_G}, c as (select *, count(*) over (partition by assay) - count(*) over (partition by assay, study) as pool from g where t50 is not null) select protein, study, assay, pool, case when pool >= 20 then 'corpus_with_interval' when pool >= 8 then 'corpus' else 'reference_scale' end as anchor from c")
def l03(t: Tables):
    g = groups(t).where("t50 is not null")
    pool = F.count("*").over(Window.partitionBy("assay")) - F.count("*").over(Window.partitionBy("assay", "study"))
    return g.select("protein", "study", "assay", pool.alias("pool")).withColumn("anchor", F.when(F.col("pool") >= 20, "corpus_with_interval").when(F.col("pool") >= 8, "corpus").otherwise("reference_scale"))


@query("l04_cohort_rank", f"{_G}, c as (select *, count(*) over (partition by protein, assay) - 1 as others, rank() over (partition by protein, assay order by t50) - 1 as below, count(*) over (partition by protein, assay, t50) - 1 as equal from g where t50 is not null) select protein, study, assay, others, case when others >= 3 then round(100 * (below + 0.5 * equal) / others, 6) end as percentile from c")
def l04(t: Tables):
    g = groups(t).where("t50 is not null")
    p = ["protein", "assay"]
    g = g.withColumns({"others": F.count("*").over(Window.partitionBy(*p)) - 1, "below": F.rank().over(Window.partitionBy(*p).orderBy("t50")) - 1, "equal": F.count("*").over(Window.partitionBy(*p, "t50")) - 1})
    return g.select("protein", "study", "assay", "others", F.when(F.col("others") >= 3, r6(100 * (F.col("below") + 0.5 * F.col("equal")) / F.col("others"))).alias("percentile"))


@query("j05_leave_study_pool", f"{_G}, c as (select assay, study, count(*) as own from g where t50 is not null group by 1, 2) select assay, study, sum(own) over (partition by assay)::bigint - own as pool from c")
def j05(t: Tables):
    c = groups(t).where("t50 is not null").groupBy("assay", "study").agg(F.count("*").alias("own"))
    return c.select("assay", "study", (F.sum("own").over(Window.partitionBy("assay")) - F.col("own")).alias("pool"))


@query("b20_tails", f"select l_suppkey, round({tails.norm_sf_sql('z')}, 5) as norm, round({tails.chi2_sf_sql('x', 'df')}, 5) as chi2, round({tails.t_sf_sql('z', 'df')}, 5) as t from (select distinct l_suppkey, (l_suppkey % 60) / 10.0 - 3 as z, l_suppkey % 40 + 1.0 as x, l_suppkey % 12 + 1.0 as df from lineitem)")
def b20(t: Tables):
    k = F.col("l_suppkey")
    z, x, df = (k % 60) / 10 - 3, (k % 40 + 1).cast("double"), (k % 12 + 1).cast("double")
    return t.lineitem.select("l_suppkey").distinct().select("l_suppkey", F.round(tails.norm_sf(z), 5).alias("norm"), F.round(tails.chi2_sf(x, df), 5).alias("chi2"), F.round(tails.t_sf(z, df), 5).alias("t"))
