"""Claims from text, residues and neighbours, graphs, snapshots, views of the service."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bank, graph
from ..sources.tables import Tables
from .a_sources import _CURVES, first_conditions
from .b_triage_bank import FITS, fits
from .c_pooling import _U, units
from .registry import COND, RAW, query, r6

# ---- claims -------------------------------------------------------------


_CLAIM = f"with {RAW}, cl as (select seq, curve_id, protein, unnest(['concentration', 'time', 'ph']) as field, unnest([regexp_extract(parameter, '^([0-9.]+) microM', 1)::double, regexp_extract(parameter, 'at ([0-9]+) Hours', 1)::double, regexp_extract(parameter, 'pH ([0-9.]+)', 1)::double]) as value from raw)"


def claims(t: Tables):
    """(seq, curve_id, protein, field, value): numbers with their units out of rendered prose, one pattern a field."""
    p = F.col("parameter")
    got = F.map_from_arrays(F.array(*map(F.lit, ["concentration", "time", "ph"])), F.array(*[F.get(F.regexp_extract_all(p, F.lit(x), F.lit(1)), F.lit(0)).try_cast("double") for x in ("([0-9.]+) microM", "at ([0-9]+) Hours", "pH ([0-9.]+)")]))
    return t.raw().select("seq", "curve_id", "protein", F.explode(got).alias("field", "value"))


@query("t07_claim_id", f"{_CLAIM} select substr(sha256(concat_ws('|', curve_id, seq, field)), 1, 16) as claim_id, count(*) as n from cl group by 1")
def t07(t: Tables):
    return claims(t).groupBy(F.substring(F.sha2(F.concat_ws("|", "curve_id", "seq", "field"), 256), 1, 16).alias("claim_id")).agg(F.count("*").alias("n"))


@query("t08_ledger_append", "select o_orderkey, 'ledger' as origin from orders where o_orderkey % 3 = 0 union all select o_orderkey, 'new' from orders where o_orderkey % 2 = 0 and o_orderkey % 3 <> 0")
def t08(t: Tables):
    """The first record of an id wins; appending again changes nothing."""
    ledger, new = t.orders.where("o_orderkey % 3 = 0").select("o_orderkey"), t.orders.where("o_orderkey % 2 = 0").select("o_orderkey")
    return ledger.withColumn("origin", F.lit("ledger")).unionByName(new.join(ledger, "o_orderkey", "left_anti").withColumn("origin", F.lit("new")))


@query("t09_active_claims", "select o_orderkey from orders a where not exists (select 1 from orders b where b.o_orderkey % 5 = 0 and b.o_orderkey - 1 = a.o_orderkey)")
def t09(t: Tables):
    superseded = t.orders.where("o_orderkey % 5 = 0").select((F.col("o_orderkey") - 1).alias("o_orderkey"))
    return t.orders.select("o_orderkey").join(superseded, "o_orderkey", "left_anti")


# ---- residues and neighbours ------------------------------------------------

# Hydropathy of the residues.
HYDROPATHY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}
_RES = "kd(aa, h) as (values " + ", ".join(f"('{a}', {v}::double)" for a, v in HYDROPATHY.items()) + "), pep as (select item_id, regexp_replace(upper(replace(text, 'ß', '')), '[^ARNDCQEGHILKMFPSTWYV]', '', 'g') as s from benchmark), rs as (select item_id, unnest(range(1, len(s) + 1)) as i, unnest(string_split(s, '')) as aa from pep)"


def residues(t: Tables):
    scale = t.spark.createDataFrame(list(HYDROPATHY.items()), "aa string, h double")
    s = F.regexp_replace(F.upper(F.translate("text", "ß", "")), "[^ARNDCQEGHILKMFPSTWYV]", "")
    r = t.benchmark.select("item_id", F.posexplode(F.filter(F.split(s, ""), lambda x: x != "")).alias("i", "aa"))
    return r.join(F.broadcast(scale), "aa").select("item_id", (F.col("i") + 1).alias("i"), "aa", "h")


@query("u01_peptide_features", f"with {_RES} select item_id, count(*) as n, round(avg(h), 6) as hydropathy, count(*) filter (aa in ('K', 'R')) - count(*) filter (aa in ('D', 'E')) as charge from rs join kd using (aa) group by 1")
def u01(t: Tables):
    n = lambda *a: F.count(F.when(F.col("aa").isin(*a), 1))
    return residues(t).groupBy("item_id").agg(F.count("*").alias("n"), r6(F.avg("h")).alias("hydropathy"), (n("K", "R") - n("D", "E")).alias("charge"))


@query("u02_hydrophobic_patch", f"with {_RES}, w as (select item_id, avg(h) over (partition by item_id order by i rows between current row and 2 following) as a, lead(i, 2) over (partition by item_id order by i) as e from rs join kd using (aa)) select item_id, round(max(a), 6) as patch from w where e is not null group by 1")
def u02(t: Tables):
    w = Window.partitionBy("item_id").orderBy("i")
    r = residues(t).select("item_id", F.avg("h").over(w.rowsBetween(0, 2)).alias("a"), F.lead("i", 2).over(w).alias("e"))
    return r.where("e is not null").groupBy("item_id").agg(r6(F.max("a")).alias("patch"))


@query("u03_apr_features", f"with {_RES} select aa, count(*) as n, count(distinct item_id) as n_items from rs group by 1")
def u03(t: Tables):
    return residues(t).groupBy("aa").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("n_items"))


@query("u04_residue_graph", f"with {_RES}, e as (select item_id, aa as a, lead(aa) over (partition by item_id order by i) as b from rs) select a, b, count(*) as n from e where b is not null group by 1, 2")
def u04(t: Tables):
    e = residues(t).select(F.col("aa").alias("a"), F.lead("aa").over(Window.partitionBy("item_id").orderBy("i")).alias("b"))
    return e.where("b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("u05_structure_sources", "select label, case when vec_id % 2 = 0 then 'measured' else 'predicted' end as source, count(*) as n from embeddings group by 1, 2")
def u05(t: Tables):
    return t.embeddings.groupBy("label", F.when(F.col("vec_id") % 2 == 0, "measured").otherwise("predicted").alias("source")).agg(F.count("*").alias("n"))


def atoms(t: Tables):
    xyz = [F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")]
    return t.embeddings.select(F.col("label").alias("chain"), F.col("vec_id").alias("res"), *xyz)


def contacts(rows, cutoff: float):
    """Pairs nearer than cutoff: rows meet in grid cells, the second side in the 27 cells around its own."""
    cell = [F.floor(F.col(c) / cutoff).alias(f"c{c}") for c in "xyz"]
    a = rows.select("chain", "res", "x", "y", "z", *cell)
    steps = F.array(*map(F.lit, (-1, 0, 1)))
    b = rows.select("chain", F.col("res").alias("res2"), *[F.col(c).alias(f"{c}2") for c in "xyz"], *cell)
    for c in "xyz":
        b = b.withColumn("_s", F.explode(steps)).withColumn(f"c{c}", F.col(f"c{c}") + F.col("_s")).drop("_s")
    d2 = sum(((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in "xyz"), F.lit(0.0))
    return a.join(b, ["chain", "cx", "cy", "cz"]).where((F.col("res2") > F.col("res") + 1) & (d2 < cutoff * cutoff)).select("chain", "res", "res2")


_ATOM = "atm as (select label as chain, vec_id as res, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings), ct as (select a.chain, a.res, b.res as res2 from atm a join atm b on a.chain = b.chain and b.res > a.res + 1 and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 0.0144)"


@query("j09_contact_map", f"with {_ATOM} select chain, count(*) as n_contacts, round(avg(res2 - res), 4) as contact_order from ct group by 1")
def j09(t: Tables):
    return contacts(atoms(t), 0.12).groupBy("chain").agg(F.count("*").alias("n_contacts"), F.round(F.avg(F.col("res2") - F.col("res")), 4).alias("contact_order"))


@query("j10_neighbour_count", f"with {_ATOM} select chain, res, count(*) as n from (select chain, res from ct union all select chain, res2 from ct) group by 1, 2")
def j10(t: Tables):
    c = contacts(atoms(t), 0.12)
    return c.select("chain", "res").unionByName(c.select("chain", F.col("res2").alias("res"))).groupBy("chain", "res").agg(F.count("*").alias("n"))


# ---- joins ------------------------------------------------------------------


@query("j01_assemble", f"with {_CURVES}, f as (select l_partkey as curve_id, avg(l_tax) as tax from lineitem group by 1), e as (select user_id as curve_id, count(*) as n from events group by 1) select curve_id, protein, round(tax, 6) as tax, n from first left join f using (curve_id) left join e using (curve_id)")
def j01(t: Tables):
    f = t.lineitem.groupBy(F.col("l_partkey").alias("curve_id")).agg(F.avg("l_tax").alias("tax"))
    e = t.events.groupBy(F.col("user_id").alias("curve_id")).agg(F.count("*").alias("n"))
    return first_conditions(t).select("curve_id", "protein").join(f, "curve_id", "left").join(e, "curve_id", "left").select("curve_id", "protein", r6("tax").alias("tax"), "n")


@query("j02_join_with_fallback", "with p as (select p_brand, p_type, min(p_partkey) as rec from part where p_size > 25 group by 1, 2), f as (select p_brand, min(p_partkey) as rec from part where p_size > 25 group by 1) select a.p_partkey, coalesce(p.rec, f.rec) as rec, case when p.rec is not null then 'exact' when f.rec is not null then 'fallback' end as how from part a left join p on a.p_brand = p.p_brand and a.p_type is not distinct from p.p_type left join f on a.p_brand = f.p_brand")
def j02(t: Tables):
    r = t.part.where("p_size > 25")
    exact = r.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("e")).withColumnRenamed("p_brand", "b").withColumnRenamed("p_type", "ty")
    first = r.groupBy(F.col("p_brand").alias("b2")).agg(F.min("p_partkey").alias("f"))
    j = t.part.join(exact, (F.col("p_brand") == F.col("b")) & F.col("p_type").eqNullSafe(F.col("ty")), "left").join(first, F.col("p_brand") == F.col("b2"), "left")
    return j.select("p_partkey", F.coalesce("e", "f").alias("rec"), F.when(F.col("e").isNotNull(), "exact").when(F.col("f").isNotNull(), "fallback").alias("how"))


@query("j04_strict_key", "select a.p_partkey, count(*) as n from part a join part b on a.p_brand = b.p_brand and nullif(a.p_size % 7, 0) = nullif(b.p_size % 7, 0) group by 1")
def j04(t: Tables):
    key = F.nullif(F.col("p_size") % 7, F.lit(0))
    a = t.part.select("p_partkey", "p_brand", key.alias("k")).where("k is not null")
    n = a.groupBy("p_brand", "k").agg(F.count("*").alias("n"))
    return a.join(n, ["p_brand", "k"]).select("p_partkey", "n")


@query("j07_member_join", f"with {_CURVES}, s as (select protein, assay, count(*) as n from first group by 1, 2 having count(*) >= 3) select curve_id, protein, assay, n from s join first using (protein, assay)")
def j07(t: Tables):
    c = first_conditions(t).select("curve_id", "protein", "assay")
    return c.withColumn("n", F.count("*").over(Window.partitionBy("protein", "assay"))).where("n >= 3")


@query("j12_membership", "select c_custkey, c_custkey in (select o_custkey from orders where o_totalprice > 200000) as found from customer")
def j12(t: Tables):
    hit = t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("found")).distinct()
    return t.customer.select("c_custkey").join(hit, "c_custkey", "left").fillna(False, ["found"])


# ---- graphs and snapshots ---------------------------------------------------


_EDGES = "ed as (select distinct 'n' || n_nationkey as b, 'r' || n_regionkey as a from nation union select 'c' || c_custkey, 'n' || c_nationkey from customer union select 'o' || o_orderkey, 'c' || o_custkey from orders), nd as (select a as id from ed union select b from ed)"


def hierarchy(t: Tables):
    """Regions, nations, customers and orders as a graph."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = t.nation.select(name("r", "n_regionkey").alias("a"), name("n", "n_nationkey").alias("b"))
    e = e.unionByName(t.customer.select(name("n", "c_nationkey").alias("a"), name("c", "c_custkey").alias("b"))).unionByName(t.orders.select(name("c", "o_custkey").alias("a"), name("o", "o_orderkey").alias("b")))
    return e, e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id"))).distinct()


@query("u08_components", "with recursive n as (select n_nationkey as id, n_regionkey as r from nation), ed as (select a.id as a, b.id as b from n a join n b on a.r = b.r and a.id < b.id), both_ways as (select a, b from ed union select b, a from ed), reach as (select id as a, id as b from n union select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a) select a as id, min(b) as least from reach group by 1")
def u08(t: Tables):
    n = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("r"))
    chain = n.select(F.col("id").alias("b"), F.lag("id").over(Window.partitionBy("r").orderBy("id")).alias("a")).where("a is not null")
    return graph.components(chain, n.select("id"))


@query("x07_topo_levels", f"with recursive {_EDGES}, lv as (select id, 0 as level from nd where id not in (select b from ed) union all select ed.b, level + 1 from lv join ed on ed.a = lv.id) select level, count(*) as n, not exists (select 1 from nd where id not in (select id from lv)) as acyclic from (select id, max(level) as level from lv group by 1) group by 1")
def x07(t: Tables):
    e, n = hierarchy(t)
    rows = graph.topo_levels(e, n).groupBy("level").agg(F.count("*").alias("n"))  # nodes of a cycle, and behind one, have no level
    return rows.withColumn("acyclic", F.count(F.when(F.col("level").isNull(), 1)).over(Window.partitionBy()) == 0)


@query("x05_evidence_graph", f"with {_EDGES} select 'node' as part, left(id, 1) as kind, count(*) as n from nd group by 1, 2 union all select 'edge', left(a, 1) || left(b, 1), count(*) from ed group by 1, 2")
def x05(t: Tables):
    e, n = hierarchy(t)
    nodes = n.groupBy(F.lit("node").alias("part"), F.substring("id", 1, 1).alias("kind")).agg(F.count("*").alias("n"))
    return nodes.unionByName(e.groupBy(F.lit("edge").alias("part"), F.concat(F.substring("a", 1, 1), F.substring("b", 1, 1)).alias("kind")).agg(F.count("*").alias("n")))


@query("x06_projection", f"with {_EDGES} select a as id from ed where left(a, 1) = 'n' union select b from ed where left(a, 1) = 'n'")
def x06(t: Tables):
    e = hierarchy(t)[0].where(F.substring("a", 1, 1) == "n")
    return e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id"))).distinct()


@query("x09_vocabulary", "select o_orderpriority as value, count(*) as n from orders where o_orderpriority not in ('1-URGENT', '2-HIGH', '5-LOW') group by 1")
def x09(t: Tables):
    vocab = t.spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("5-LOW",)], "value string")
    return t.orders.select(F.col("o_orderpriority").alias("value")).join(F.broadcast(vocab), "value", "left_anti").groupBy("value").agg(F.count("*").alias("n"))


@query("x11_stratified_sample", "select o_orderstatus, o_orderkey from (select *, row_number() over (partition by o_orderstatus order by ('0x' || substr(md5('x:' || o_orderkey), 1, 12))::bigint, o_orderkey) as r from orders) where r <= 5")
def x11(t: Tables):
    from ..functions import parse

    w = Window.partitionBy("o_orderstatus").orderBy(parse.seed(F.col("o_orderkey"), "x"), "o_orderkey")
    return t.orders.withColumn("r", F.row_number().over(w)).where("r <= 5").select("o_orderstatus", "o_orderkey")


@query("x13_dangling_refs", "select l_orderkey, l_linenumber from lineitem where l_partkey not in (select p_partkey from part where p_size > 5)")
def x13(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey")).join(t.part.where("p_size > 5").select("p_partkey"), "p_partkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("x01_reality_check", f"with {_U}, g as (select protein, -regr_slope(theta, lconc) as gamma, count(*) as n from u group by 1) select protein, round(gamma, 6) as gamma, case when n < 10 then 'INSUFFICIENT' when gamma between -3 and 0 then 'CONSISTENT' else 'CONTRADICTION' end as verdict from g")
def x01(t: Tables):
    g = units(t).groupBy("protein").agg((-F.regr_slope("theta", "lconc")).alias("gamma"), F.count("*").alias("n"))
    return g.select("protein", r6("gamma").alias("gamma"), F.when(F.col("n") < 10, "INSUFFICIENT").when(F.col("gamma").between(-3, 0), "CONSISTENT").otherwise("CONTRADICTION").alias("verdict"))


# ---- views of the service ---------------------------------------------------


@query("y01_proteins", f"with {COND} select protein, count(distinct curve_id) as n_curves, bool_or(conc > 45) as has_dose from cond group by 1")
def y01(t: Tables):
    return t.conditions().groupBy("protein").agg(F.countDistinct("curve_id").alias("n_curves"), F.bool_or(F.col("conc") > 45).alias("has_dose"))


@query("y02_protein_detail", f"with {COND} select protein, string_agg(distinct assay, ',' order by assay) as assays, min(curve_id) as representative, count(*) as n_rows from cond group by 1")
def y02(t: Tables):
    return t.conditions().groupBy("protein").agg(F.array_join(F.sort_array(F.collect_set("assay")), ",").alias("assays"), F.min("curve_id").alias("representative"), F.count("*").alias("n_rows"))


@query("y05_series_list", f"with {COND} select distinct protein from (select protein from cond where conc > 40 union select p_brand from part where p_size > 45)")
def y05(t: Tables):
    return t.conditions().where("conc > 40").select("protein").union(t.part.where("p_size > 45").select("p_brand")).distinct()


@query("y06_dose_response", f"with {COND} select protein, conc, round(avg(t50), 8) as mean_t50, count(*) as n from cond group by 1, 2")
def y06(t: Tables):
    return t.conditions().groupBy("protein", "conc").agg(F.round(F.avg("t50"), 8).alias("mean_t50"), F.count("*").alias("n"))


@query("y10_health", "select (select count(*) from lineitem) as n_points, (select count(*) from part) as n_curves, (select count(distinct p_brand) from part) as n_proteins, (select count(*) from supplier) as n_studies")
def y10(t: Tables):
    p = t.part.agg(F.count("*").alias("n_curves"), F.countDistinct("p_brand").alias("n_proteins"))
    return t.lineitem.agg(F.count("*").alias("n_points")).join(F.broadcast(p)).join(F.broadcast(t.supplier.agg(F.count("*").alias("n_studies"))))


@query("y11_keyed_records", "select c_custkey as id, case when o_custkey is null then 'not_available' else 'ok' end as status, coalesce(n, 0) as n from customer left join (select o_custkey, count(*) as n from orders group by 1) on c_custkey = o_custkey")
def y11(t: Tables):
    n = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    return t.customer.select(F.col("c_custkey").alias("id")).join(n, "id", "left").select("id", F.when(F.col("n").isNull(), "not_available").otherwise("ok").alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


@query("y12_literature", f"{_CLAIM} select protein, count(*) as n_claims, count(distinct field) as n_fields, count(distinct curve_id) as n_curves from cl group by 1")
def y12(t: Tables):
    return claims(t).groupBy("protein").agg(F.count("*").alias("n_claims"), F.countDistinct("field").alias("n_fields"), F.countDistinct("curve_id").alias("n_curves"))
