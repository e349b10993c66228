"""Yield tiers, reachability, recommendations and metadata quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bank, design
from ..sources.tables import Tables
from .a_sources import _CURVES, first_conditions
from .b_triage_bank import FITS, mono
from .c_pooling import _U, units
from .d_ranks import _PARTS, parts
from .registry import query, r6, rounded

# Tiers from the lowest rung up, and their rank.
TIERS = ["uninformative", "signal_only", "descriptive", "scaling", "mechanistic"]
# means are compared with limits that they often equal, so they are rounded first: 0.055 comes out of sums in any order
_TIER = "tier as (select part, protein, case when x < 20000 then 'uninformative' when p_size = 50 and lvl = 2 then 'mechanistic' when y > 30 and d < 0.05 then 'scaling' when y > 22 then 'descriptive' else 'signal_only' end as tier, y < 18 as no_conc, d > 0.055 as no_ph, p_size < 10 as no_temp from (select * replace (round(x, 9) as x, round(y, 9) as y, round(d, 9) as d) from pp))"
_DOM = "dom(tier, rk) as (values " + ", ".join(f"('{t}', {i})" for i, t in enumerate(TIERS)) + ")"
LADDER = f"with {_PARTS}, {_TIER}, {_DOM}"


def tier_of(t: Tables):
    """The first rung from the top whose licence is there."""
    c = F.col
    tier = F.when(c("x") < 20000, "uninformative").when((c("p_size") == 50) & (c("lvl") == 2), "mechanistic").when((c("y") > 30) & (c("d") < 0.05), "scaling").when(c("y") > 22, "descriptive").otherwise("signal_only")
    return rounded(parts(t), "x", "y", "d", digits=9).select("part", "protein", tier.alias("tier"), (c("y") < 18).alias("no_conc"), (c("d") > 0.055).alias("no_ph"), (c("p_size") < 10).alias("no_temp"))


def domain(t: Tables):
    return t.spark.createDataFrame([(x, i) for i, x in enumerate(TIERS)], "tier string, rk int")


@query("m01_information_yield", f"{LADDER} select part, tier from tier")
def m01(t: Tables):
    return tier_of(t).select("part", "tier")


@query("m03_firing_rules", f"{LADDER} select part, concat_ws(',', case when no_conc then 'add_concentrations' end, case when no_ph then 'record_ph' end, case when no_temp then 'record_temperature' end, case when tier = 'signal_only' then 'longer_run' end) as rules, coalesce(case when no_conc then 'add_concentrations' end, case when no_ph then 'record_ph' end, case when no_temp then 'record_temperature' end, case when tier = 'signal_only' then 'longer_run' end) as primary_rule from tier")
def m03(t: Tables):
    rules = F.filter(F.array(F.when(F.col("no_conc"), "add_concentrations"), F.when(F.col("no_ph"), "record_ph"), F.when(F.col("no_temp"), "record_temperature"), F.when(F.col("tier") == "signal_only", "longer_run")), lambda x: x.isNotNull())
    return tier_of(t).withColumn("r", rules).select("part", F.array_join("r", ",").alias("rules"), F.get("r", F.lit(0)).alias("primary_rule"))


@query("m04_caveats", f"{LADDER}, c as (select part, unnest([case when no_temp then 0 end, case when no_conc then 2 end, case when no_ph then 1 end, case when no_conc then 3 end]) as impact, unnest(['forced temperature', 'concentration', 'ph', 'concentration']) as text from tier), b as (select part, text, min(impact) as impact from c where impact is not null group by 1, 2), r as (select *, row_number() over (partition by part order by impact, text) as r from b) select part, string_agg(text, '; ' order by impact, text) as caveats from r where r <= 2 or text like 'forced%' group by 1")
def m04(t: Tables):
    item = lambda flag, impact, text: F.when(F.col(flag), F.struct(F.lit(impact).alias("impact"), F.lit(text).alias("text")))
    c = tier_of(t).select("part", F.explode(F.filter(F.array(item("no_temp", 0, "forced temperature"), item("no_conc", 2, "concentration"), item("no_ph", 1, "ph"), item("no_conc", 3, "concentration")), lambda x: x.isNotNull())).alias("c"))
    best = c.groupBy("part", "c.text").agg(F.min("c.impact").alias("impact"))
    kept = F.filter("l", lambda x, i: (i < 2) | x["text"].startswith("forced"))  # forced ones are exempt from the cap
    return best.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("impact", "text"))).alias("l")).select("part", F.array_join(F.transform(kept, lambda x: x["text"]), "; ").alias("caveats"))


@query("m06_missingness", f"{LADDER} select part, (no_conc::integer + no_ph::integer + no_temp::integer) as n_missing, concat_ws(',', case when no_conc then 'conc' end, case when no_ph then 'ph' end, case when no_temp then 'temp' end) as fields from tier")
def m06(t: Tables):
    m = F.map_filter(F.create_map(F.lit("conc"), F.col("no_conc"), F.lit("ph"), F.col("no_ph"), F.lit("temp"), F.col("no_temp")), lambda _, v: v)
    return tier_of(t).select("part", F.size(m).alias("n_missing"), F.array_join(F.map_keys(m), ",").alias("fields"))


@query("m08_dose_summary", f"with {_U}, f as (select protein, assay, regr_r2(theta, lconc) as lin, regr_r2(theta, conc) as pow from u group by 1, 2) select case when lin >= pow then 'scaling' else 'linear' end as winner, count(*) as n from f group by 1")
def m08(t: Tables):
    f = units(t).groupBy("protein", "assay").agg(F.regr_r2("theta", "lconc").alias("lin"), F.regr_r2("theta", "conc").alias("pow"))
    return f.groupBy(F.when(F.col("lin") >= F.col("pow"), "scaling").otherwise("linear").alias("winner")).agg(F.count("*").alias("n"))


@query("m09_stage_census", "select o_orderstatus, o_orderpriority, count(*) as n, round(count(*)::double / (select count(*) from orders), 6) as share from orders group by grouping sets ((o_orderstatus), (o_orderpriority))")
def m09(t: Tables):
    o = t.orders.groupingSets([("o_orderstatus",), ("o_orderpriority",)], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return o.join(F.broadcast(t.orders.agg(F.count("*").alias("m")))).select("o_orderstatus", "o_orderpriority", "n", r6(F.col("n") / F.col("m")).alias("share"))


@query("n01_ladder", f"{LADDER}, c as (select dom.tier, rk, count(part) as n from dom left join tier using (tier) group by 1, 2) select tier, n, sum(n) over (order by rk desc)::bigint as at_least, round(sum(n) over (order by rk desc) / sum(n) over (), 6) as fraction from c")
def n01(t: Tables):
    c = domain(t).join(tier_of(t).groupBy("tier").agg(F.count("*").alias("n")), "tier", "left").fillna(0, ["n"])
    up = F.sum("n").over(Window.orderBy(F.desc("rk")))  # five rows
    return c.select("tier", "n", up.alias("at_least"), r6(up / F.sum("n").over(Window.partitionBy())).alias("fraction"))


@query("n02_protein_ladder", f"{LADDER}, b as (select protein, max(rk) as rk from tier join dom using (tier) group by 1), c as (select dom.tier, dom.rk, count(protein) as n from dom left join b using (rk) group by 1, 2) select tier, n, sum(n) over (order by rk desc)::bigint as at_least from c")
def n02(t: Tables):
    b = tier_of(t).join(F.broadcast(domain(t)), "tier").groupBy("protein").agg(F.max("rk").alias("rk")).groupBy("rk").agg(F.count("*").alias("n"))
    c = domain(t).join(b, "rk", "left").fillna(0, ["n"])
    return c.select("tier", "n", F.sum("n").over(Window.orderBy(F.desc("rk"))).alias("at_least"))


_BINS = "bins as (select part, protein, case when no_conc::integer + no_ph::integer + no_temp::integer >= 2 then 'low' when no_conc::integer + no_ph::integer + no_temp::integer = 1 then 'medium' else 'high' end as completeness, case when count(*) over (partition by protein) >= 12 then 'series' when count(*) over (partition by protein) >= 5 then 'replicates' else 'single' end as richness, tier from tier)"


def bins(t: Tables):
    miss = F.col("no_conc").cast("int") + F.col("no_ph").cast("int") + F.col("no_temp").cast("int")
    n = F.count("*").over(Window.partitionBy("protein"))
    return tier_of(t).select("part", "protein", F.when(miss >= 2, "low").when(miss == 1, "medium").otherwise("high").alias("completeness"), F.when(n >= 12, "series").when(n >= 5, "replicates").otherwise("single").alias("richness"), "tier")


@query("n03_completeness_bin", f"{LADDER}, {_BINS} select completeness, count(*) as n from bins group by 1")
def n03(t: Tables):
    return bins(t).groupBy("completeness").agg(F.count("*").alias("n"))


@query("n04_data_richness", f"{LADDER}, {_BINS} select richness, count(*) as n, count(distinct protein) as n_proteins from bins group by 1")
def n04(t: Tables):
    return bins(t).groupBy("richness").agg(F.count("*").alias("n"), F.countDistinct("protein").alias("n_proteins"))


@query("n05_grid", f"{LADDER}, {_BINS} select c.completeness, r.richness, count(part) as n, case when count(part) = 0 then 'empty' else 'populated' end as status from (values ('low'), ('medium'), ('high')) c(completeness) cross join (values ('series'), ('replicates'), ('single')) r(richness) left join bins b on b.completeness = c.completeness and b.richness = r.richness group by 1, 2")
def n05(t: Tables):
    axes = t.spark.createDataFrame([(c, r) for c in ("low", "medium", "high") for r in ("series", "replicates", "single")], "completeness string, richness string")
    g = axes.join(bins(t).groupBy("completeness", "richness").agg(F.count("*").alias("n")), ["completeness", "richness"], "left").fillna(0, ["n"])
    return g.withColumn("status", F.when(F.col("n") == 0, "empty").otherwise("populated"))


_BLOCK = "select blocker, n, row_number() over (order by n desc, blocker)::integer as rank from (select unnest(['no_conc', 'no_ph', 'no_temp']) as blocker, unnest([count(*) filter (no_conc), count(*) filter (no_ph), count(*) filter (no_temp)]) as n from tier)"


def blockers(t: Tables):
    s = tier_of(t).agg(*[F.count(F.when(F.col(b), 1)).alias(b) for b in ("no_conc", "no_ph", "no_temp")])
    return s.unpivot([], ["no_conc", "no_ph", "no_temp"], "blocker", "n").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "blocker")))  # a row a blocker


@query("n06_blockers", f"{LADDER} {_BLOCK}")
def n06(t: Tables):
    return blockers(t)


@query("n07_boundary_gap", f"{LADDER} select count(*) as n_proteins, count(*) filter (could) as n_could, count(*) filter (has) as n_licensed, count(*) filter (could and not has) as gap from (select protein, bool_or(not no_conc) and count(*) >= 3 as could, bool_or(tier in ('scaling', 'mechanistic')) as has from tier group by 1)")
def n07(t: Tables):
    g = tier_of(t).groupBy("protein").agg((F.bool_or(~F.col("no_conc")) & (F.count("*") >= 3)).alias("could"), F.bool_or(F.col("tier").isin("scaling", "mechanistic")).alias("has"))
    n = lambda c: F.count(F.when(c, 1))
    return g.agg(F.count("*").alias("n_proteins"), n(F.col("could")).alias("n_could"), n(F.col("has")).alias("n_licensed"), n(F.col("could") & ~F.col("has")).alias("gap"))


_ACT = "act(blocker, action, cost, gain) as (values ('no_conc', 'measure_series', 4.0::double, 0.6::double), ('no_ph', 'record_ph', 1.0, 0.2), ('no_temp', 'record_temperature', 1.0, 0.3))"


def actions(t: Tables):
    return t.spark.createDataFrame([("no_conc", "measure_series", 4.0, 0.6), ("no_ph", "record_ph", 1.0, 0.2), ("no_temp", "record_temperature", 1.0, 0.3)], "blocker string, action string, cost double, gain double")


@query("n08_explain_blockers", f"{LADDER}, {_ACT}, b as ({_BLOCK}) select blocker, n, action from b join act using (blocker)")
def n08(t: Tables):
    return blockers(t).join(F.broadcast(actions(t)), "blocker").select("blocker", "n", "action")


@query("n09_reachable_at", f"{LADDER} select protein, count(*) as n from tier join dom using (tier) where rk >= 2 group by 1")
def n09(t: Tables):
    return tier_of(t).join(F.broadcast(domain(t)), "tier").where("rk >= 2").groupBy("protein").agg(F.count("*").alias("n"))


@query("o01_unit_state", f"{LADDER} select protein, bool_or(no_conc) as no_conc, bool_or(no_ph) as no_ph, bool_or(no_temp) as no_temp, count(*) as n from tier group by 1")
def o01(t: Tables):
    return tier_of(t).groupBy("protein").agg(*[F.bool_or(b).alias(b) for b in ("no_conc", "no_ph", "no_temp")], F.count("*").alias("n"))


_REC = f"{LADDER}, {_ACT}, e as (select part, protein, tier, unnest([case when no_conc then 'no_conc' end, case when no_ph then 'no_ph' end, case when no_temp then 'no_temp' end]) as blocker from tier), rec as (select part, protein, action, round(gain / cost * case when tier = 'uninformative' then 0.5 else 1.0 end, 6) as priority, row_number() over (partition by part order by gain / cost * case when tier = 'uninformative' then 0.5 else 1.0 end desc, action)::integer as rank from e join act using (blocker))"


def recommend(t: Tables):
    """Only blockers that are there fire; priority is gain over cost, less where nothing can be learned yet."""
    b = F.filter(F.array(*[F.when(F.col(k), k) for k in ("no_conc", "no_ph", "no_temp")]), lambda x: x.isNotNull())
    e = tier_of(t).select("part", "protein", "tier", F.explode(b).alias("blocker")).join(F.broadcast(actions(t)), "blocker")
    e = e.withColumn("p", F.col("gain") / F.col("cost") * F.when(F.col("tier") == "uninformative", 0.5).otherwise(1.0))
    return e.select("part", "protein", "action", r6("p").alias("priority"), F.row_number().over(Window.partitionBy("part").orderBy(F.desc("p"), "action")).alias("rank"))


@query("o02_recommend", f"{_REC} select * from rec")
def o02(t: Tables):
    return recommend(t)


@query("o03_action_rollup", f"{_REC} select action, count(*) as n_units, count(distinct protein) as n_proteins, count(*) filter (rank = 1) as n_first from rec group by 1")
def o03(t: Tables):
    return recommend(t).groupBy("action").agg(F.count("*").alias("n_units"), F.countDistinct("protein").alias("n_proteins"), F.count(F.when(F.col("rank") == 1, 1)).alias("n_first"))


_PLAN = "pl(ord, fold, stretch, density, intervals, reps) as (values " + ", ".join(f"({i}, {a!r}::double, {b!r}::double, {c}, {d}, {e})" for i, a, b, c, d, e in design.curves_of_designs()) + ")"
_NAMES = "nm(ord, design, cost, opens, gating) as (values " + ", ".join(f"({i}, '{d}', {(1.0 + sum(c[4] for c in cs)) if cs else 0.25!r}::double, {d == design.SERIES}, {d == design.NOTE})" for i, (d, cs) in enumerate(design.DESIGNS)) + ")"
_DET = "0.5 * log2(({u} + a * ({p}11)) * ({u} + b * ({p}22)) - a * b * ({p}12) * ({p}12))"
_OPEN = "0.5 * ln(1 + (f11 + f22) / 2) / ln(2::double)"
_CAND = f"""{FITS}, {_PLAN}, {_NAMES},
un as (select curve_id, p1 as k, p2 as t0, amp, n::integer as n, greatest(sse, 1e-6) / greatest(n - 4, 1) as sigma2, count(*) over (partition by curve_id // 10) >= 3 as has_series, hours from best join grid using (model, candidate) join (select curve_id, max(t) - min(t) as hours from pts group by 1) using (curve_id) where model = 'logistic'),
gx as (select curve_id, ord, k, t0, amp, reps / sigma2 as w, unnest(range(0, (intervals * (n - 1) + 1)::bigint)) * (stretch * pow(fold, -1.0) / density / (n - 1)) as x from un, pl where n >= 2),
gs as (select *, 1 / (1 + exp(greatest(-50, least(50, -k * (x - t0))))) as g from gx),
inf as (select curve_id, ord, sum(w * pow(amp * g * (1 - g) * (x - t0), 2)) as f11, sum(-w * pow(amp * g * (1 - g), 2) * (x - t0) * k) as f12, sum(w * pow(amp * g * (1 - g) * k, 2)) as f22, max(x) as reach from gs group by 1, 2),
cd as (select un.curve_id, nm.*, has_series, hours, greatest(1e-12, k * k) as a, greatest(1e-12, t0 * t0) as b, coalesce(f11, 0) as f11, coalesce(f12, 0) as f12, coalesce(f22, 0) as f22, reach from un cross join nm left join inf on inf.curve_id = un.curve_id and inf.ord = nm.ord where n >= 2),
cand as (select *, case when gating then case when has_series then 2.0 else 0.0 end else {_DET.format(u='1', p='f')} + case when opens then {_OPEN} else 0 end end as bits, case when gating then 0 else 2 + hours * reach end as run_hours, case when not gating then greatest(0, 1 - sqrt((1 / b + f22) / ((1 / a + f11) * (1 / b + f22) - f12 * f12) / a), 1 - sqrt((1 / a + f11) / ((1 / a + f11) * (1 / b + f22) - f12 * f12) / b)) end as se_less from cd)"""


def designs(t: Tables):
    """Every design for each curve by its logistic fit. Ten curves that follow one another are a series; what was done was never noted, and no exponent is known."""
    f = bank.fit(mono(t).select("curve_id", "x", "y"), bank.grid(t.spark).where("model = 'logistic'"))
    f = f.join(F.broadcast(bank.grid(t.spark)), ["model", "candidate"]).join(t.points().groupBy("curve_id").agg((F.max("t") - F.min("t")).alias("hours")), "curve_id")
    sigma2 = F.greatest("sse", F.lit(design.SSE_DIGITS)) / F.greatest(F.col("n") - 4, F.lit(1.0))
    series = F.count("*").over(Window.partitionBy(F.floor(F.col("curve_id") / 10))) >= 3
    u = f.select("curve_id", F.col("p1").alias("k"), F.col("p2").alias("t0"), "amp", F.col("n").cast("int").alias("n"), sigma2.alias("sigma2"), F.lit(None).cast("double").alias("gamma"), series.alias("has_series"), F.lit(False).alias("notes_known"), "hours")
    return design.score(u, ["curve_id"])


@query("o04_score_candidates", f"{_CAND} select curve_id, design, round(bits, 6) as bits, round(se_less, 6) as se_less, design in ('add_single_concentration', 'add_concentration_series') as guessed from cand")
def o04(t: Tables):
    return designs(t).select("curve_id", "design", r6("bits").alias("bits"), r6("se_less").alias("se_less"), "guessed")


@query("o05_cost_runtime", f"{_CAND} select curve_id, design, cost, round(run_hours, 6) as run_hours, round(bits / cost, 6) as priority from cand")
def o05(t: Tables):
    return designs(t).select("curve_id", "design", "cost", r6("run_hours").alias("run_hours"), r6("priority").alias("priority"))


@query("j11_pareto", f"{_CAND}, v as (select curve_id, design, round(bits, 6) as bits, cost, round(run_hours, 6) as hrs from cand) select curve_id, design from v a where not exists (select 1 from v b where a.curve_id = b.curve_id and b.bits >= a.bits and b.cost <= a.cost and b.hrs <= a.hrs and (b.bits > a.bits or b.cost < a.cost or b.hrs < a.hrs))")
def j11(t: Tables):
    return design.pareto(designs(t), ["curve_id"])


def _greedy_sql(steps: int) -> str:
    """CTEs of the greedy rule, three a step: what each adds, who wins, what is known then."""
    out = ["ag0 as (select *, 1 / a as g11, 0::double as g12, 1 / b as g22, has_series as series, null::integer as step, null::double as gain from cand)"]
    for i in range(1, steps + 1):
        more = f"{_DET.format(u='1', p='f').replace('(f', '(g{0} + f')}"
        for x in ("11", "12", "22"):
            more = more.replace("(g{0} + f" + x, f"(g{x} + f{x}")
        out.append(f"am{i} as (select *, case when step is null then case when gating then case when series then 2.0 else 0.0 end else {more} - {_DET.format(u='1', p='g')} + case when opens and not series then {_OPEN} else 0 end end end as adds from ag{i - 1})")
        out.append(f"aw{i} as (select curve_id, ord as wo, f11 as w11, f12 as w12, f22 as w22, opens as wopens from am{i} where step is null qualify row_number() over (partition by curve_id order by round(adds / cost, 9) desc, ord) = 1)")
        out.append(f"ag{i} as (select m.* exclude (g11, g12, g22, series, step, gain, adds), g11 + w11 as g11, g12 + w12 as g12, g22 + w22 as g22, series or wopens as series, case when ord = wo then {i} else step end as step, case when ord = wo then adds else gain end as gain from am{i} m join aw{i} using (curve_id))")
    return ", ".join(out)


@query("o06_greedy_batch", f"{_CAND}, {_greedy_sql(3)} select curve_id, step, design, round(gain, 6) as gain, round(gain / cost, 6) as priority, round(sum(greatest(0, gain)) over w, 6) as total_gain, sum(cost) over w as total_cost from ag3 where step is not null window w as (partition by curve_id order by step)")
def o06(t: Tables):
    """Three steps; what is left is scored again by what is known after each."""
    return rounded(design.greedy(designs(t), ["curve_id"]), "gain", "priority", "total_gain")


@query("o07_rescale", f"with {_U}, w as (select protein, min(conc) as lo, max(conc) as hi, -regr_slope(theta, lconc) / ln(10) as gamma, avg(raw) as t0, avg(conc) as c0 from u group by 1) select protein, round(t0 * pow(60.0 / c0, -gamma), 2) as t_new, 60.0 > hi as extrapolated from w")
def o07(t: Tables):
    w = units(t).groupBy("protein").agg(F.max("conc").alias("hi"), (-F.regr_slope("theta", "lconc") / F.log(F.lit(10.0))).alias("gamma"), F.avg("raw").alias("t0"), F.avg("conc").alias("c0"))
    return w.select("protein", F.round(F.col("t0") * F.pow(60.0 / F.col("c0"), -F.col("gamma")), 2).alias("t_new"), (F.lit(60.0) > F.col("hi")).alias("extrapolated"))


# metadata quality: fields with weights; status by value
_ONT = "ont(field, weight, effort) as (values ('assay', 3.0::double, 1.0::double), ('conc', 2.0, 2.0), ('ph', 1.5, 1.0), ('temp', 1.0, 1.0), ('agitation', 1.0, 3.0))"
_STAT = f"with {_CURVES}, {_ONT}, fs as (select curve_id, protein, unnest(['assay', 'conc', 'ph', 'temp', 'agitation']) as field, unnest(['present', case when conc < 5 then 'inferred' else 'present' end, case when ph = 0 then 'missing' else 'present' end, case when temp < 10 then 'missing' else 'present' end, 'not_captured']) as status from first), comp as (select curve_id, any_value(protein) as protein, sum(weight) filter (status = 'present') / sum(weight) filter (status <> 'not_captured') as completeness, count(*) filter (status = 'inferred')::double / count(*) as inferred, count(*) filter (status in ('missing', 'not_captured'))::double / count(*) as unknown from fs join ont using (field) group by 1)"


def ontology(t: Tables):
    return t.spark.createDataFrame([("assay", 3.0, 1.0), ("conc", 2.0, 2.0), ("ph", 1.5, 1.0), ("temp", 1.0, 1.0), ("agitation", 1.0, 3.0)], "field string, weight double, effort double")


def field_status(t: Tables):
    c = first_conditions(t).select("curve_id", "protein", F.lit("present").alias("assay"), F.when(F.col("conc") < 5, "inferred").otherwise("present").alias("conc"), F.when(F.col("ph") == 0, "missing").otherwise("present").alias("ph"), F.when(F.col("temp") < 10, "missing").otherwise("present").alias("temp"), F.lit("not_captured").alias("agitation"))
    return c.unpivot(["curve_id", "protein"], ["assay", "conc", "ph", "temp", "agitation"], "field", "status")


def completeness(t: Tables):
    s, w = F.col("status"), F.col("weight")
    f = field_status(t).join(F.broadcast(ontology(t)), "field")
    n = lambda c: F.count(F.when(c, 1)) / F.count("*")
    return f.groupBy("curve_id").agg(F.first("protein").alias("protein"), (F.sum(F.when(s == "present", w)) / F.sum(F.when(s != "not_captured", w))).alias("completeness"), n(s == "inferred").alias("inferred"), n(s.isin("missing", "not_captured")).alias("unknown"))


@query("s01_field_status", f"{_STAT} select field, status, count(*) as n from fs group by 1, 2")
def s01(t: Tables):
    return field_status(t).groupBy("field", "status").agg(F.count("*").alias("n"))


@query("s02_completeness", f"{_STAT} select curve_id, round(completeness, 6) as completeness from comp")
def s02(t: Tables):
    return completeness(t).select("curve_id", r6("completeness").alias("completeness"))


@query("s03_uncertainty", f"{_STAT} select curve_id, round(0.4 * (curve_id % 2) + 0.3 * inferred + 0.3 * unknown, 6) as uncertainty from comp")
def s03(t: Tables):
    return completeness(t).select("curve_id", r6(0.4 * (F.col("curve_id") % 2) + 0.3 * F.col("inferred") + 0.3 * F.col("unknown")).alias("uncertainty"))


_PRE = "pre(target, field) as (values ('scaling', 'conc'), ('scaling', 'assay'), ('thermo', 'temp'), ('thermo', 'ph'), ('mechanism', 'agitation'))"


@query("s04_evaluate_targets", f"{_STAT}, {_PRE} select target, curve_id, bool_and(status = 'present') as satisfied, string_agg(field, ',' order by field) filter (status <> 'present') as blockers from pre join fs using (field) group by 1, 2")
def s04(t: Tables):
    pre = t.spark.createDataFrame([("scaling", "conc"), ("scaling", "assay"), ("thermo", "temp"), ("thermo", "ph"), ("mechanism", "agitation")], "target string, field string")
    f = field_status(t).join(F.broadcast(pre), "field")
    lack = F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") != "present", F.col("field")))), ",")
    return f.groupBy("target", "curve_id").agg(F.bool_and(F.col("status") == "present").alias("satisfied"), F.nullif(lack, F.lit("")).alias("blockers"))


_DP = f"{_STAT}, dp as (select curve_id, field, weight, effort, row_number() over (partition by curve_id order by weight desc, field)::integer as rank, row_number() over (partition by curve_id order by weight / effort desc, field)::integer as by_effort from fs join ont using (field) where status in ('missing', 'inferred'))"


def lacking(t: Tables):
    f = field_status(t).where(F.col("status").isin("missing", "inferred")).join(F.broadcast(ontology(t)), "field")
    w = Window.partitionBy("curve_id")
    return f.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("weight"), "field")), "by_effort": F.row_number().over(w.orderBy(F.desc(F.col("weight") / F.col("effort")), "field"))})


@query("s05_delta_power", f"{_DP} select curve_id, field, weight as gain, rank from dp")
def s05(t: Tables):
    return lacking(t).select("curve_id", "field", F.col("weight").alias("gain"), "rank")


@query("s06_recommend_metadata", f"{_DP} select curve_id, field, round(weight / effort, 6) as score from dp where by_effort = 1")
def s06(t: Tables):
    return lacking(t).where("by_effort = 1").select("curve_id", "field", r6(F.col("weight") / F.col("effort")).alias("score"))


_SHARES = [0.1, 0.25, 0.5, 0.75, 0.9]


@query("s07_quality_distribution", f"{_STAT}, v as (select round(completeness, 6) as v from comp), b as (select unnest(range(1, 6)) as bin), r as (select v, row_number() over (order by v) as i, count(*) over () as n from v), p as (select unnest({_SHARES!r}::double[]) as share) select 'bin' as part, bin::double as at, (select count(*) from v where least(5, 1 + floor(v * 5)) = bin)::double as value from b union all select 'percentile', share, (select min(v) from r where i >= ceil(round(share * n, 6))) from p")
def s07(t: Tables):
    """Five bins, empty ones too, and nearest-rank percentiles, both from counts by distinct value: as many as there are sets of fields."""
    c = completeness(t).where("completeness is not null").groupBy(F.round("completeness", 6).alias("v")).agg(F.count("*").alias("c"))
    bins_ = t.spark.range(1, 6).select(F.col("id").cast("double").alias("at"))
    n = c.groupBy(F.least(F.lit(5), 1 + F.floor(F.col("v") * 5)).cast("double").alias("at")).agg(F.sum("c").cast("double").alias("value"))
    b = bins_.join(n, "at", "left").fillna(0.0, ["value"]).select(F.lit("bin").alias("part"), "at", "value")
    r = c.select("v", F.sum("c").over(Window.orderBy("v")).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("n"))
    at = r.select("v", "upto", "n", F.explode(F.array(*map(F.lit, _SHARES))).alias("at"))
    p = at.where(F.col("upto") >= F.ceil(F.round(F.col("at") * F.col("n"), 6))).groupBy("at").agg(F.min("v").alias("value"))
    return b.unionByName(p.select(F.lit("percentile").alias("part"), "at", "value"))


@query("s08_quality_rollup", f"{_DP} select 'protein' as part, protein as name, count(*) as n, round(avg(completeness), 6) as mean, round(min(completeness), 6) as least from comp group by 2 union all select 'action', field, count(*), round(avg(weight / effort), 6), round(min(weight / effort), 6) from dp group by 2")
def s08(t: Tables):
    """By protein, completeness; by field to be recorded, the curves that lack it and the gain for the effort."""
    roll = lambda df, part, name, v: df.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least")).select(F.lit(part).alias("part"), "*")
    a = roll(completeness(t), "protein", "protein", F.col("completeness"))
    return rounded(a.unionByName(roll(lacking(t), "action", "field", F.col("weight") / F.col("effort"))), "mean", "least")
