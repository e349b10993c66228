"""Cross-modal statistics, calibration, conformal prediction, runs test and false-discovery control."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tails
from ..operators import curves, ranks, regimes
from ..operators.graph import cut
from ..sources.tables import Tables, means, placed
from .c_pooling import _U, units
from .registry import PTS, query, r6, rounded

_PARTS = "pp as (select l_partkey as part, p_brand as protein, avg(l_extendedprice) as x, avg(l_quantity) as y, avg(l_discount) as d, p_size % 4 as lvl, p_size from lineitem join part on l_partkey = p_partkey group by 1, 2, p_size)"


def parts(t: Tables, ordered: bool = False):
    """Means of each part's shipments; ordered are those whose ties matter, added in the order of the file."""
    if ordered:
        i = means(placed(t.lineitem).withColumnRenamed("l_partkey", "part"), "part", x="l_extendedprice", y="l_quantity", d="l_discount")
    else:
        i = t.lineitem.groupBy(F.col("l_partkey").alias("part")).agg(F.avg("l_extendedprice").alias("x"), F.avg("l_quantity").alias("y"), F.avg("l_discount").alias("d"))
    return i.join(t.part.select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("protein"), (F.col("p_size") % 4).alias("lvl"), "p_size"), "part")


@query("r01_protein_table", f"with {_PARTS} select protein, count(*) as n_curves, round(median(x), 4) as median_x, round(median(y), 4) as median_y, count(*) filter (lvl = 0) as n_level0, max(lvl) as max_level, arg_min(lvl, (-c, lvl)) as modal_level from (select *, count(*) over (partition by protein, lvl) as c from pp) group by 1")
def r01(t: Tables):
    p = parts(t).withColumn("c", F.count("*").over(Window.partitionBy("protein", "lvl")))
    return p.groupBy("protein").agg(F.count("*").alias("n_curves"), F.round(F.median("x"), 4).alias("median_x"), F.round(F.median("y"), 4).alias("median_y"), F.count(F.when(F.col("lvl") == 0, 1)).alias("n_level0"), F.max("lvl").alias("max_level"), F.min_by("lvl", F.struct(-F.col("c"), F.col("lvl"))).alias("modal_level"))


@query("r02_avg_rank", f"with {_PARTS} select part, protein, rank() over (partition by protein order by p_size) + (count(*) over (partition by protein, p_size) - 1) / 2.0 as rank from pp")
def r02(t: Tables):
    return parts(t).select("part", "protein", ranks.avg_rank("p_size", "protein").alias("rank"))


@query("r03_correlations", f"with {_PARTS}, r as (select *, rank() over (partition by protein order by x) + (count(*) over (partition by protein, x) - 1) / 2.0 as rx, rank() over (partition by protein order by y) + (count(*) over (partition by protein, y) - 1) / 2.0 as ry from pp) select protein, count(*) as n, round(corr(x, y), 6) as pearson, round(corr(rx, ry), 6) as spearman from r group by 1 having count(*) >= 3")
def r03(t: Tables):
    return rounded(ranks.correlations(parts(t), "x", "y", "protein"), "pearson", "spearman")


_B = 199
_PERM = f"reps as (select part, protein, y, draw from pp, range(0, {_B}) r(draw)), pa as (select *, row_number() over (partition by protein order by part) as i from pp), pb as (select protein, draw, y as py, row_number() over (partition by protein, draw order by md5('perm:' || draw || ':' || part), part) as i from reps), drawn as (select protein, draw, corr(x, py) as pr from pa join pb using (protein, i) group by 1, 2), seen as (select protein, corr(x, y) as r from pp group by 1)"


@query("r04_perm_pvalue", f"with {_PARTS}, {_PERM} select protein, round(any_value(r), 6) as r, round((count(*) filter (abs(pr) >= abs(r) - 1e-9) + 1) / (count(*) + 1.0), 6) as p from drawn join seen using (protein) group by 1")
def r04(t: Tables):
    return rounded(ranks.perm_pvalue(parts(t), "part", "x", "y", "protein", _B), "r", "p")


@query("r05_variance_ceiling", f"with {_PARTS}, m as (select *, avg(x) over (partition by protein, lvl) as gm, avg(x) over (partition by protein) as mm from pp) select protein, round(sum(pow(gm - mm, 2)) / sum(pow(x - mm, 2)), 6) as ceiling from m group by 1")
def r05(t: Tables):
    return rounded(ranks.variance_ceiling(parts(t), "x", "lvl", "protein"), "ceiling")


_LOPO = f"with {_PARTS}, o as (select *, count(*) over p - 1.0 as n1, sum(x) over p - x as sx, sum(y) over p - y as sy, sum(x * x) over p - x * x as sxx, sum(x * y) over p - x * y as sxy, avg(y) over p as my from pp window p as (partition by protein)), b as (select *, case when sxx - sx * sx / n1 > 1e-9 then (sxy - sx * sy / n1) / (sxx - sx * sx / n1) else 0 end as slope from o where n1 >= 2), pr as (select *, (sy - slope * sx) / n1 + slope * x as predicted from b)"


@query("r06_lopo_r2", f"{_LOPO} select protein, round(1 - sum(pow(y - predicted, 2)) / sum(pow(y - my, 2)), 5) as r2 from pr group by 1")
def r06(t: Tables):
    return rounded(ranks.lopo_r2(parts(t), "x", "y", "protein"), "r2", digits=5)


@query("r07_lopo_ordinal", f"{_LOPO.replace('sum(y) over p - y', 'sum(lvl) over p - lvl').replace('x * y', 'x * lvl').replace('avg(y)', 'avg(lvl)')}, s as (select *, greatest(0, least(3, round_even(predicted, 0)))::integer as snapped from pr), m as (select protein, max(c) as top, sum(c) as n from (select protein, lvl, count(*) as c from s group by 1, 2) group by 1) select protein, count(*) as n, round(avg((snapped = lvl)::integer), 6) as accuracy, round(any_value(top)::double / any_value(m.n), 6) as baseline, round(avg((abs(snapped - lvl) <= 1)::integer), 6) as within_one from s join m using (protein) group by 1")
def r07(t: Tables):
    p = ranks.lopo(parts(t).withColumn("lv", F.col("lvl").cast("double")), "x", "lv", "protein").withColumn("snapped", F.greatest(F.lit(0), F.least(F.lit(3), F.bround("predicted", 0))).cast("int"))
    top = p.groupBy("protein", "lvl").agg(F.count("*").alias("c")).groupBy("protein").agg((F.max("c") / F.sum("c")).alias("baseline"))
    g = p.groupBy("protein").agg(F.count("*").alias("n"), F.avg((F.col("snapped") == F.col("lvl")).cast("int")).alias("accuracy"), F.avg((F.abs(F.col("snapped") - F.col("lvl")) <= 1).cast("int")).alias("within_one"))
    return rounded(g.join(top, "protein"), "accuracy", "baseline", "within_one")


@query("r08_jonckheere", f"with {_PARTS}, j as (select a.protein, sum(case when a.y < b.y then 1.0 when a.y = b.y then 0.5 else 0 end) as j from pp a join pp b on a.protein = b.protein and a.lvl < b.lvl group by 1), n as (select protein, sum(c) as nn, sum(c * c) as n2, sum(c * c * (2 * c + 3)) as n3 from (select protein, lvl, count(*)::double as c from pp group by 1, 2) group by 1) select protein, j::double as j, round((j - (nn * nn - n2) / 4) / sqrt((nn * nn * (2 * nn + 3) - n3) / 72), 6) as z from j join n using (protein)")
def r08(t: Tables):
    return rounded(ranks.jonckheere(parts(t), "lvl", "y", "protein"), "z")


@query("r10_kruskal_wallis", f"with {_PARTS}, r as (select *, rank() over (partition by protein order by y) + (count(*) over (partition by protein, y) - 1) / 2.0 as ry from pp), g as (select protein, lvl, sum(ry) as s, count(*) as n from r group by 1, 2), h as (select protein, sum(n)::double as n, count(*) as k, sum(s * s / n) as t from g group by 1) select protein, k, round(12 / (n * (n + 1)) * t - 3 * (n + 1), 5) as h, round({tails.chi2_sf_sql('greatest(1e-9, 12 / (n * (n + 1)) * t - 3 * (n + 1))', '(k - 1)')}, 4) as p from h where k > 1")
def r10(t: Tables):
    k = ranks.kruskal_wallis(parts(t), "lvl", "y", "protein").where("k > 1")
    return k.select("protein", "k", F.round("h", 5).alias("h"), F.round(tails.chi2_sf(F.greatest(F.lit(1e-9), F.col("h")), (F.col("k") - 1).cast("double")), 4).alias("p"))


@query("r11_binom_test", f"with {_PARTS}, c as (select protein, count(*)::integer as n, (count(*) filter (lvl <= 1))::integer as k from pp group by 1), e as (select protein, n, k, unnest(range(0, n + 1)) as i from c), q as (select *, lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + n * ln(0.5) as lp, lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) + n * ln(0.5) as lk from e) select protein, any_value(n) as n, any_value(k) as k, round(least(1.0, sum(exp(lp)) filter (lp <= lk + 1e-7)), 7) as p from q group by 1")
def r11(t: Tables):
    c = parts(t).groupBy("protein").agg(F.count("*").cast("int").alias("n"), F.count(F.when(F.col("lvl") <= 1, 1)).cast("int").alias("k"))
    # sums of a few powers of a half end in a 5 at the eighth digit: what noise there is goes first
    return rounded(rounded(ranks.binom_half(c, "protein"), "p", digits=12), "p", digits=7)


@query("r13_regime_trend", f"with {_PARTS} select lvl, count(*) as n, round(median(y), 4) as median_y, count(distinct protein) as n_proteins from pp group by 1")
def r13(t: Tables):
    return parts(t).groupBy("lvl").agg(F.count("*").alias("n"), F.round(F.median("y"), 4).alias("median_y"), F.countDistinct("protein").alias("n_proteins"))


@query("r14_discordance", f"with {_PARTS}, m as (select protein, median(x) as mx, median(y) as my from pp group by 1) select protein, count(*) filter (x > mx and y > my) as both, count(*) filter (x > mx and y <= my) as only_x, count(*) filter (x <= mx and y > my) as only_y, count(*) filter (x <= mx and y <= my) as neither, round((count(*) filter ((x > mx) <> (y > my)))::double / count(*), 6) as rate from pp join m using (protein) group by 1")
def r14(t: Tables):
    p = cut(parts(t), "means")  # a mean made again may differ in its last bit, and a median is one of them
    p = p.join(p.groupBy("protein").agg(F.median("x").alias("mx"), F.median("y").alias("my")), "protein")
    a, b = F.col("x") > F.col("mx"), F.col("y") > F.col("my")
    n = lambda c: F.count(F.when(c, 1))
    return p.groupBy("protein").agg(n(a & b).alias("both"), n(a & ~b).alias("only_x"), n(~a & b).alias("only_y"), n(~a & ~b).alias("neither"), r6(n(a != b) / F.count("*")).alias("rate"))


@query("r16_coverage", "with d as (select distinct p_partkey as k from part), a as (select distinct l_partkey as k, true as a from lineitem where l_quantity > 45), b as (select distinct user_id as k, true as b from events) select count(*) as n, count(*) filter (a) as n_a, count(*) filter (b) as n_b, count(*) filter (a and b) as n_both from d left join a using (k) left join b using (k)")
def r16(t: Tables):
    d = t.part.select(F.col("p_partkey").alias("k")).distinct()
    a = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("k"), F.lit(True).alias("a")).distinct()
    b = t.events.select(F.col("user_id").alias("k"), F.lit(True).alias("b")).distinct()
    j = d.join(a, "k", "left").join(b, "k", "left")
    n = lambda c: F.count(F.when(c, 1))
    return j.agg(F.count("*").alias("n"), n(F.col("a")).alias("n_a"), n(F.col("b")).alias("n_b"), n(F.col("a") & F.col("b")).alias("n_both"))


_UTEST = f"with {_PARTS}, f as (select protein, part, unnest(['d', 'y', 'p_size']) as feature, unnest([d, y, p_size::double]) as v, x from pp), r as (select *, rank() over (partition by protein, feature order by v) + (count(*) over (partition by protein, feature, v) - 1) / 2.0 as rv, rank() over (partition by protein, feature order by x) + (count(*) over (partition by protein, feature, x) - 1) / 2.0 as rx from f), c as (select protein, feature, count(*) as n, corr(rv, rx) as rho from r group by 1, 2)"


def associations(t: Tables):
    f = parts(t, True).withColumn("p_size", F.col("p_size").cast("double")).unpivot(["protein", "part", "x"], ["d", "y", "p_size"], "feature", "v")
    return ranks.correlations(f, "v", "x", "protein", "feature").select("protein", "feature", "n", F.col("spearman").alias("rho"))


_ASSOC = f"{_UTEST}, p as (select *, round(2 * {tails.t_sf_sql('abs(rho * sqrt((n - 2) / greatest(1e-9, 1 - rho * rho)))', '(n - 2)')}, 6) as p from c where n >= 4)"


@query("u06_associations", f"{_ASSOC}, w as (select protein, feature, n, rho, p, least(1.0, min(p * m / upto) over (order by p desc range between unbounded preceding and current row)) as q from (select *, count(*) over () as m, count(*) over (order by p range between unbounded preceding and current row) as upto from p)) select protein, feature, n, round(rho, 6) as rho, p, round(q, 6) as q from w")
def u06(t: Tables):
    a = associations(t).where("n >= 4")
    n = F.col("n").cast("double")
    a = a.withColumn("p", r6(2 * tails.t_sf(F.abs(F.col("rho") * F.sqrt((n - 2) / F.greatest(F.lit(1e-9), 1 - F.col("rho") * F.col("rho")))), n - 2)))
    by = a.groupBy("p").agg(F.count("*").alias("c"))
    total = a.agg(F.count("*").alias("m"))
    by = by.withColumn("upto", F.sum("c").over(Window.orderBy("p"))).join(F.broadcast(total)).withColumn("q", F.least(F.lit(1.0), F.min(F.col("p") * F.col("m") / F.col("upto")).over(Window.orderBy(F.desc("p")))))
    return a.join(by.select("p", "q"), "p").select("protein", "feature", "n", r6("rho").alias("rho"), "p", r6("q").alias("q"))


@query("u07_spearman_ci", f"{_UTEST} select protein, feature, round(tanh(atanh(least(0.999, greatest(-0.999, rho))) - 1.96 / sqrt(n - 3)), 6) as lo, round(tanh(atanh(least(0.999, greatest(-0.999, rho))) + 1.96 / sqrt(n - 3)), 6) as hi from c where n > 3")
def u07(t: Tables):
    z = F.atanh(F.least(F.lit(0.999), F.greatest(F.lit(-0.999), F.col("rho"))))
    half = 1.96 / F.sqrt(F.col("n") - 3)
    return associations(t).where("n > 3").select("protein", "feature", r6(F.tanh(z - half)).alias("lo"), r6(F.tanh(z + half)).alias("hi"))


@query("h06_bh_fdr", f"{_ASSOC}, o as (select *, count(*) over (order by p range between unbounded preceding and current row) as rank, count(*) over () as m from p), l as (select max(p) as lim from o where p <= rank / m::double * 0.05) select protein, feature, p, coalesce(p <= lim, false) as rejected from p, l")
def h06(t: Tables):
    return regimes.bh_fdr(u06(t), "p").select("protein", "feature", "p", "rejected")


@query("h04_runs_test", f"with {PTS}, ch as (select *, (s <> lag(s) over (partition by curve_id order by t))::integer as c from (select curve_id, t, sign(y - m) as s from (select *, avg(y) over (partition by curve_id) as m from (select *, row_number() over (partition by curve_id, t order by seq) as r from pts) where r = 1) where y <> m)), g as (select curve_id, count(*) as n, (count(*) filter (s > 0))::double as n1, (count(*) filter (s < 0))::double as n2, 1 + coalesce(sum(c), 0) as runs from ch group by 1), z as (select *, (runs - (2 * n1 * n2 / (n1 + n2) + 1)) / sqrt(2 * n1 * n2 * (2 * n1 * n2 - n1 - n2) / ((n1 + n2) * (n1 + n2) * (n1 + n2 - 1))) as z from g where n >= 8) select curve_id, n, runs::bigint as runs, round(z, 6) as z, round(1 - {tails.norm_sf_sql('z')}, 6) as p from z")
def h04(t: Tables):
    # a curve's values are added in order of time: whether one equals their mean is told by its last bit
    w = Window.partitionBy("curve_id").orderBy("t")
    p = curves.first_rows(t.points()).withColumn("m", F.sum("y").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.row_number().over(w))
    p = p.withColumn("r", F.col("y") - F.last("m").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rounded(regimes.runs_test(p.select("curve_id", "t", "r")).select("curve_id", "n", "runs", "z", "p"), "z", "p")


_LAB = "lab as (select doc_id, quality = 1 as good, n_chars, source, percent_rank() over (order by n_chars) as score, row_number() over (order by doc_id) as rn from documents join labels using (doc_id))"


def scored(t: Tables):
    """Predictions with truth: rank share of length as the score."""
    d = t.documents.select("doc_id", "n_chars", "source").join(t.labels.select("doc_id", (F.col("quality") == 1).alias("good")), "doc_id")
    by = d.groupBy("n_chars").agg(F.count("*").alias("c"))
    below = F.coalesce(F.sum("c").over(Window.orderBy("n_chars").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by = by.withColumn("below", below).join(F.broadcast(d.agg(F.count("*").alias("m")))).select("n_chars", (F.col("below") / F.greatest(F.col("m") - 1, F.lit(1))).alias("score"))
    return d.join(by, "n_chars")


@query("w01_ece_brier", f"with {_LAB}, b as (select least(floor(score * 10), 9) as bin, count(*) as n, sum(score) as sp, sum(good::integer) as sc, sum(pow(score - good::integer, 2)) as sb from lab group by 1) select sum(n)::bigint as n, round(sum(abs(sp - sc)) / sum(n), 6) as ece, round(sum(sb) / sum(n), 6) as brier from b")
def w01(t: Tables):
    return rounded(ranks.ece_brier(scored(t), "score", "good"), "ece", "brier")


_AUC = "c as (select source, n_chars, sum(good::integer) as p, sum((not good)::integer) as q from lab group by 1, 2), d as (select *, coalesce(sum(q) over (partition by source order by n_chars rows between unbounded preceding and 1 preceding), 0) as below from c), a as (select source, sum(p * (below + 0.5 * q)) as u, sum(p) as np, sum(q) as nq from d group by 1)"


@query("w02_rank_auc", f"with {_LAB}, {_AUC} select source, np::bigint as np, nq::bigint as nq, round(u / (np * nq), 6) as auc from a where np > 0 and nq > 0")
def w02(t: Tables):
    return rounded(ranks.rank_auc(scored(t), "n_chars", "good", "source"), "auc")


@query("w03_youden", f"with {_LAB}, c as (select n_chars, sum(good::integer) as p, sum((not good)::integer) as q from lab group by 1), d as (select (n_chars + lead(n_chars) over (order by n_chars)) / 2.0 as cut, sum(p) over () - sum(p) over (order by n_chars) as tp, sum(q) over () - sum(q) over (order by n_chars) as fp, sum(p) over () as np, sum(q) over () as nq from c), j as (select cut, tp / np::double - fp / nq::double as j from d where cut is not null and np > 0 and nq > 0) select cut::double as cut, round(j, 6) as j from j order by round(j, 9) desc, cut limit 1")
def w03(t: Tables):
    s = scored(t).withColumn("one", F.lit(1))
    return rounded(ranks.youden(s, "n_chars", "good", "one").select(F.col("cut").cast("double").alias("cut"), "j"), "j")


@query("w04_heldout", f"with {_LAB}, s as (select *, row_number() over (partition by good order by ('0x' || substr(md5('split:' || doc_id), 1, 12))::bigint, doc_id) <= floor(count(*) over (partition by good) * 0.5) as train from lab), c as (select n_chars, sum(good::integer) as p, sum((not good)::integer) as q from s where train group by 1), d as (select (n_chars + lead(n_chars) over (order by n_chars)) / 2.0 as cut, sum(p) over () - sum(p) over (order by n_chars) as tp, sum(q) over () - sum(q) over (order by n_chars) as fp, sum(p) over () as np, sum(q) over () as nq from c), j as (select cut from d where cut is not null order by round(tp / np::double - fp / nq::double, 9) desc, cut limit 1) select count(*) as n, round(avg(((n_chars >= cut) = good)::integer), 6) as accuracy from s, j where not train")
def w04(t: Tables):
    s = ranks.split_half(scored(t), "doc_id", "good").withColumn("one", F.lit(1))
    cut = ranks.youden(s.where("train"), "n_chars", "good", "one").select("cut")
    return s.where("not train").join(F.broadcast(cut)).agg(F.count("*").alias("n"), r6(F.avg(((F.col("n_chars") >= F.col("cut")) == F.col("good")).cast("int"))).alias("accuracy"))


_CONF = "cf as (select o_orderpriority as truth, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][1 + least(4, floor(o_totalprice / 60000))::integer] as chosen from orders)"


def chosen(t: Tables):
    names = F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]))
    return t.orders.select(F.col("o_orderpriority").alias("truth"), F.get(names, F.least(F.lit(4), F.floor(F.col("o_totalprice") / 60000)).cast("int")).alias("chosen"))


@query("w05_confusion", f"with {_CONF} select truth, chosen, count(*) as n, round(count(*) / sum(count(*)) over (partition by truth), 6) as share from cf group by 1, 2")
def w05(t: Tables):
    return rounded(ranks.confusion(chosen(t), "truth", "chosen"), "share")


@query("w06_confusable_pairs", f"with {_CONF}, s as (select truth, chosen, count(*) / sum(count(*)) over (partition by truth) as share from cf group by 1, 2) select least(a.truth, a.chosen) as a, greatest(a.truth, a.chosen) as b, round(max(share), 6) as confusion from s a where truth <> chosen group by 1, 2 having max(share) >= 0.2")
def w06(t: Tables):
    c = ranks.confusion(chosen(t), "truth", "chosen").where("truth <> chosen")
    return c.groupBy(F.least("truth", "chosen").alias("a"), F.greatest("truth", "chosen").alias("b")).agg(F.max("share").alias("c")).where("c >= 0.2").select("a", "b", r6("c").alias("confusion"))


@query("w09_recovery", f"with {_U} select protein, count(*) as n, round(avg(theta - 10), 6) as bias, round(sqrt(avg(pow(theta - 10, 2))), 6) as rmse, round(avg((abs(theta - 10) <= 1.96 * sqrt(s2))::integer), 6) as coverage from u group by 1")
def w09(t: Tables):
    e = F.col("theta") - 10
    return units(t).groupBy("protein").agg(F.count("*").alias("n"), r6(F.avg(e)).alias("bias"), r6(F.sqrt(F.avg(e * e))).alias("rmse"), r6(F.avg((F.abs(e) <= 1.96 * F.sqrt("s2")).cast("int"))).alias("coverage"))


@query("w11_flag_rates", f"with {_U} select assay, round((count(*) filter (s2 > 0.01 and mutant))::double / count(*) filter (mutant), 6) as tpr, round((count(*) filter (s2 > 0.01 and not mutant))::double / count(*) filter (not mutant), 6) as fpr from u group by 1 having count(*) filter (mutant) > 0 and count(*) filter (not mutant) > 0")
def w11(t: Tables):
    m, f = F.col("mutant"), F.col("s2") > 0.01
    n = lambda c: F.count(F.when(c, 1))
    g = units(t).groupBy("assay").agg(n(f & m).alias("tp"), n(m).alias("p"), n(f & ~m).alias("fp"), n(~m).alias("q")).where("p > 0 and q > 0")
    return g.select("assay", r6(F.col("tp") / F.col("p")).alias("tpr"), r6(F.col("fp") / F.col("q")).alias("fpr"))


_NC = "nc as (select event_type, event_id, value, avg(value) over (partition by user_id) as hat, abs(value - avg(value) over (partition by user_id)) as score from events)"


def conformity(t: Tables):
    hat = F.avg("value").over(Window.partitionBy("user_id"))
    return t.events.select("event_type", "event_id", "value", hat.alias("hat"), F.round(F.abs(F.col("value") - hat), 9).alias("score"))


_Q = "qs as (select event_type, n, score as q from (select *, row_number() over (partition by event_type order by score) as r, count(*) over (partition by event_type) as n from (select event_type, event_id, value, hat, round(score, 9) as score from nc)) where r = least(n, ceil((n + 1) * 0.9))), whole as (select score as wq from (select *, row_number() over (order by score) as r, count(*) over () as n from (select round(score, 9) as score from nc)) where r = least(n, ceil((n + 1) * 0.9)))"


@query("w12_conformal_q", f"with {_NC}, {_Q} select event_type, n, q from qs")
def w12(t: Tables):
    return ranks.conformal_q(conformity(t), "score", 0.1, "event_type")


@query("w13_nonconformity", f"with {_NC} select event_id, round(score, 9) as score, round(greatest(0.0, value - hat), 9) as one_sided from nc")
def w13(t: Tables):
    return conformity(t).select("event_id", "score", F.round(F.greatest(F.lit(0.0), F.col("value") - F.col("hat")), 9).alias("one_sided"))


@query("w14_mondrian_q", f"with {_NC}, {_Q} select event_type, n, case when n >= 20 then q else wq end as q, n < 20 as marginal from qs, whole")
def w14(t: Tables):
    return ranks.mondrian_q(conformity(t), "score", 0.1, "event_type")


_IV = f"with {_NC}, {_Q}, iv as (select nc.*, case when n >= 20 then q else wq end as qq from nc join qs using (event_type), whole)"


@query("w15_apply_interval", f"{_IV} select event_id, round(hat - qq, 9) as lo, case when event_type = 'purchase' then null else round(hat + qq, 9) end as hi from iv")
def w15(t: Tables):
    c = conformity(t)
    iv = c.join(F.broadcast(ranks.mondrian_q(c, "score", 0.1, "event_type").select("event_type", "q")), "event_type")
    return iv.select("event_id", F.round(F.col("hat") - F.col("q"), 9).alias("lo"), F.when(F.col("event_type") != "purchase", F.round(F.col("hat") + F.col("q"), 9)).alias("hi"))


@query("w17_coverage", f"{_IV} select event_type, count(*) as n, round(avg((round(score, 9) <= qq)::integer), 6) as coverage, round(avg(2 * qq), 6) as width from iv group by rollup (event_type)")
def w17(t: Tables):
    c = conformity(t)
    iv = c.join(F.broadcast(ranks.mondrian_q(c, "score", 0.1, "event_type").select("event_type", "q")), "event_type")
    return iv.rollup("event_type").agg(F.count("*").alias("n"), r6(F.avg((F.col("score") <= F.col("q")).cast("int"))).alias("coverage"), r6(F.avg(2 * F.col("q"))).alias("width"))
