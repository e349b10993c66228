"""Scans, assembly and incremental build; parsing and other scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import parse
from ..operators import curves
from ..sources.tables import Tables
from .registry import COND, PART, RAW, query, r6, rounded


@query("a01_split_rows", f"with {RAW} select case left(entry, 1) when 'T' then 'time' when 'O' then 'endpoint' else 'rate' end as row_class, count(*) as n_rows, count(distinct curve_id) as n_curves from raw where left(entry, 1) in ('T', 'O', 'R') group by 1")
def a01(t: Tables):
    one = None
    for name, rows in curves.split_rows(t.raw()).items():
        part = rows.agg(F.count("*").alias("n_rows"), F.countDistinct("curve_id").alias("n_curves")).select(F.lit(name).alias("row_class"), "n_rows", "n_curves")
        one = part if one is None else one.unionByName(part)
    return one.where("n_rows > 0")


@query("a02_assemble_curves", f"with {PART}, k as (select *, row_number() over (partition by curve_id, t order by seq) as r from pts) select curve_id, count(*) as n_raw, count(*) filter (r = 1) as n_points, 0::bigint as n_missing, count(*) filter (r > 1) as n_duplicate, round(arg_min(y, t) filter (r = 1), 6) as y_first, round(sum(y) filter (r = 1), 6) as y_sum from k group by 1")
def a02(t: Tables):
    c = curves.assemble_curves(t.part_points())
    return c.select("curve_id", "n_raw", "n_points", "n_missing", "n_duplicate", r6(F.get("points", F.lit(0))["y"]).alias("y_first"), r6(F.aggregate("points", F.lit(0.0), lambda a, p: a + p["y"])).alias("y_sum"))


def _first_sql(columns: list[str]) -> str:
    """Each curve's first row; shipments may share an order's line number, then the least columns in their order."""
    return f"select curve_id, {', '.join(columns)} from cond qualify row_number() over (partition by curve_id order by seq nulls last, {', '.join(f'{c} nulls first' for c in columns)}) = 1"


@query("a03_first_row_attrs", f"with {COND} select curve_id, assay, conc, round(ph, 6) as ph, protein from ({_first_sql(['assay', 'conc', 'ph', 'protein'])})")
def a03(t: Tables):
    return rounded(curves.first_row_attrs(t.conditions(), ["assay", "conc", "ph", "protein"]), "ph")


@query("a04_endpoints", f"with {RAW} select curve_id, seq, protein, parameter, try_cast(nullif(rate, 'NA') as double) as endpoint from raw where entry like 'O%'")
def a04(t: Tables):
    return curves.split_rows(t.raw())["endpoint"].select("curve_id", "seq", "protein", "parameter", parse.parse_float(F.col("rate")).alias("endpoint"))


@query("a05_rate_conc", f"with {RAW} select protein, seq, regexp_extract(parameter, '^([0-9.]+)', 1)::double as conc_um, try_cast(nullif(rate, 'NA') as double) as rate from raw where entry like 'R%'")
def a05(t: Tables):
    return curves.split_rows(t.raw())["rate"].select("protein", "seq", parse.parse_concentration(F.col("parameter"))["value_uM"].alias("conc_um"), parse.parse_float(F.col("rate")).alias("rate"))


_PEP = "pep as (select p_partkey as pep_id, p_brand as uniprot, case when p_size % 3 = 0 then 'WT' when p_size % 3 = 1 then null else 'A30G' end as mutant, p_retailprice as tango, p_retailprice - 900 as aggrescan, case when p_size > 40 then 10000.0 else p_size::double end as pasta, case when p_size % 2 = 0 then 'amyloid' else 'non' end as waltz from part)"


def peptides(t: Tables):
    s = F.col("p_size")
    return t.part.select(F.col("p_partkey").alias("pep_id"), F.col("p_brand").alias("uniprot"), F.when(s % 3 == 0, "WT").when(s % 3 == 1, None).otherwise("A30G").alias("mutant"), F.col("p_retailprice").alias("tango"), (F.col("p_retailprice") - 900).alias("aggrescan"), F.when(s > 40, 10000.0).otherwise(s.cast("double")).alias("pasta"), F.when(s % 2 == 0, "amyloid").otherwise("non").alias("waltz"))


@query("a06_peptide_rollup", f"with {_PEP} select uniprot, count(*) as n, count(*) filter (mutant is null or mutant = 'WT') as n_wt, max(tango) filter (mutant is null or mutant = 'WT') as max_tango, round(max(aggrescan) filter (mutant is null or mutant = 'WT'), 6) as max_aggrescan, min(pasta) filter ((mutant is null or mutant = 'WT') and pasta < 10000) as min_pasta, count(*) filter ((mutant is null or mutant = 'WT') and waltz = 'amyloid') as n_waltz, round(avg(tango) filter (mutant is null or mutant = 'WT'), 6) as mean_tango, count(*) filter (mutant is null or mutant = 'WT') > 0 as available from pep group by 1")
def a06(t: Tables):
    wt = parse.is_wt(F.col("mutant"))
    when = lambda c: F.when(wt, c)
    return peptides(t).groupBy("uniprot").agg(F.count("*").alias("n"), F.count(when(F.lit(1))).alias("n_wt"), F.max(when(F.col("tango"))).alias("max_tango"), r6(F.max(when(F.col("aggrescan")))).alias("max_aggrescan"), F.min(when(parse.drop_sentinel(F.col("pasta")))).alias("min_pasta"), F.count(F.when(wt & (F.col("waltz") == "amyloid"), 1)).alias("n_waltz"), r6(F.avg(when(F.col("tango")))).alias("mean_tango"), (F.count(when(F.lit(1))) > 0).alias("available"))


@query("a07_apr_list", f"with {_PEP} select uniprot, count(*) as n_aprs, string_agg(pep_id::varchar || ':' || pasta::varchar, ',' order by pep_id) as aprs from pep where pasta < 10000 and waltz = 'amyloid' group by 1")
def a07(t: Tables):
    p = peptides(t).where((F.col("pasta") < 10000) & (F.col("waltz") == "amyloid"))
    lists = p.groupBy("uniprot").agg(F.array_sort(F.collect_list(F.struct("pep_id", "pasta"))).alias("l"))
    return lists.select("uniprot", F.size("l").cast("long").alias("n_aprs"), F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["pep_id"], x["pasta"])), ",").alias("aprs"))


@query("a08_structure_list", "select l as uniprot, count(*) as n_structures, min(v) as first_structure, max(v) as last_structure from (select 'Brand#' || (label + 11)::varchar as l, vec_id as v from embeddings) group by 1")
def a08(t: Tables):
    s = t.embeddings.select(F.concat(F.lit("Brand#"), F.col("label") + 11).alias("uniprot"), "vec_id")
    lists = s.groupBy("uniprot").agg(F.array_sort(F.collect_list("vec_id")).alias("l"))
    return lists.select("uniprot", F.size("l").cast("long").alias("n_structures"), F.get("l", F.lit(0)).alias("first_structure"), F.get("l", F.size("l") - 1).alias("last_structure"))


@query("a09_protein_records", f"with {_PEP}, p as (select uniprot, count(*) as n_peptides from pep where waltz = 'amyloid' group by 1), a as (select uniprot, count(*) as n_aprs from pep where pasta < 5 group by 1), s as (select 'Brand#' || (label + 11)::varchar as uniprot, count(*) as n_structures from embeddings group by 1) select uniprot, coalesce(n_peptides, 0) as n_peptides, coalesce(n_aprs, 0) as n_aprs, coalesce(n_structures, 0) as n_structures from p full join a using (uniprot) full join s using (uniprot)")
def a09(t: Tables):
    p = peptides(t).where("waltz = 'amyloid'").groupBy("uniprot").agg(F.count("*").alias("n_peptides"))
    a = peptides(t).where("pasta < 5").groupBy("uniprot").agg(F.count("*").alias("n_aprs"))
    s = a08(t).select("uniprot", "n_structures")
    return p.join(a, "uniprot", "full_outer").join(s, "uniprot", "full_outer").fillna(0, ["n_peptides", "n_aprs", "n_structures"])


@query("a10_manifest", f"with {PART}, k as (select *, row_number() over (partition by curve_id, t order by seq) as r from pts), c as (select curve_id, count(*) filter (r = 1) as n from k group by 1) select count(*) as n_curves, count(*) filter (n >= 6) as n_fittable, sum(n)::bigint as n_points, min(n) as least_points, max(n) as most_points from c")
def a10(t: Tables):
    c = curves.assemble_curves(t.part_points())
    return c.agg(F.count("*").alias("n_curves"), F.count(F.when(F.col("n_points") >= 6, 1)).alias("n_fittable"), F.sum("n_points").alias("n_points"), F.min("n_points").alias("least_points"), F.max("n_points").alias("most_points"))


@query("a13_resume", "select o_orderkey, o_totalprice from orders where o_orderkey % 2 = 1")
def a13(t: Tables):
    return curves.pending(t.orders.select("o_orderkey", "o_totalprice"), t.orders.where("o_orderkey % 2 = 0"), "o_orderkey")


@query("a14_gapfill", "with c as (select distinct user_id as curve_id from events), m as (select distinct o_orderpriority as model from orders), f as (select distinct c_custkey as curve_id, o_orderpriority as model from customer join orders on c_custkey = o_custkey) select c.curve_id, m.model from c, m where not exists (select 1 from f where f.curve_id = c.curve_id and f.model = m.model)")
def a14(t: Tables):
    fits = t.orders.select(F.col("o_custkey").alias("curve_id"), F.col("o_orderpriority").alias("model"))
    return curves.gapfill(t.events.select(F.col("user_id").alias("curve_id")).distinct(), t.orders.select(F.col("o_orderpriority").alias("model")).distinct(), fits)


@query("a15_shard", "select shard, count(*) as n, min(o_orderkey) as least, max(o_orderkey) as most from (select o_orderkey, (('0x' || substr(md5('shard:' || o_orderkey::varchar), 1, 12))::bigint % 8)::integer as shard from orders) group by 1")
def a15(t: Tables):
    return curves.shard(t.orders, "o_orderkey", 8).groupBy("shard").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("most"))


@query("a16_index_last", "select o_custkey, arg_max(o_orderstatus, o_orderkey) as o_orderstatus, max(o_orderkey) as o_orderkey, count(*) - 1 as n_replaced from orders group by 1")
def a16(t: Tables):
    return curves.index_last(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@query("a17_build_id", "select substr(sha256(string_agg(name || '=' || digest, ';' order by name || '=' || digest)), 1, 12) as build_id from (select o_orderpriority || o_orderstatus as name, (bit_xor(('0x' || substr(md5(o_orderkey::varchar || ':' || o_custkey::varchar), 1, 12))::bigint))::varchar as digest from orders group by 1)")
def a17(t: Tables):
    """Components are the parts of orders; a part's digest sums its rows' digests before the shuffle."""
    own = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))), 1, 12), 16, 10).cast("long")
    parts = t.orders.groupBy(F.concat("o_orderpriority", "o_orderstatus").alias("name")).agg(F.bit_xor(own).cast("string").alias("digest"))
    return curves.build_id(parts)


@query("a18_comparable", "select a.o_custkey, count(*) as n from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderpriority = b.o_orderpriority and a.o_orderkey < b.o_orderkey group by 1")
def a18(t: Tables):
    a = t.orders.select("o_custkey", F.col("o_orderpriority").alias("build_id"), F.col("o_orderkey").alias("a"))
    return a.join(a.withColumnRenamed("a", "b"), ["o_custkey", "build_id"]).where("a < b").groupBy("o_custkey").agg(F.count("*").alias("n"))


_CLEAN = "case when trim({0}) in ('', '-', 'NA', 'N/A', 'None', 'nan') then null else trim({0}) end"


@query("b01_clean", f"with {RAW} select seq, {_CLEAN.format('rate')} as rate from raw")
def b01(t: Tables):
    return t.raw().select("seq", parse.clean(F.col("rate")).alias("rate"))


@query("b02_parse_hours", f"with {RAW}, u as (select seq, replace(parameter, 'Hours', ['Seconds', 'Minutes', 'Hours', 'days'][1 + (seq % 4)::integer]) as p from raw), m as (select seq, regexp_extract(p, 'at ([0-9]+) ', 1)::double as v, lower(left(regexp_extract(p, 'at [0-9]+ ([A-Za-z]+)', 1), 1)) as u from u) select seq, round(v * case u when 's' then 1.0 / 3600 when 'm' then 1.0 / 60 when 'h' then 1.0 else 24.0 end, 6) as hours from m")
def b02(t: Tables):
    unit = F.get(F.array(*map(F.lit, ["Seconds", "Minutes", "Hours", "days"])), (F.col("seq") % 4).cast("int"))
    return t.raw().select("seq", r6(parse.parse_hours(F.replace("parameter", F.lit("Hours"), unit))).alias("hours"))


@query("b03_parse_float", f"with {RAW} select seq, try_cast(regexp_extract(rate, '-?[0-9]+([.][0-9]+)?') as double) as value from raw")
def b03(t: Tables):
    return t.raw().select("seq", parse.parse_float(F.col("rate")).alias("value"))


@query("b04_num", f"with {RAW} select seq, try_cast(replace(nullif(rate, 'NA'), '.', '') || 'e-2' as double) as value from raw")
def b04(t: Tables):
    return t.raw().select("seq", parse.num(F.concat(F.translate(parse.clean(F.col("rate")), ".", ""), F.lit("e-2"))).alias("value"))


@query("b05_parse_concentration", f"with {RAW}, u as (select seq, regexp_extract(parameter, '^[0-9.]+') as v, (seq % 5)::integer as k from raw) select seq, v || [' nM', ' mM', ' microM', ' M', ' uM'][k + 1] as raw, round(v::double * [1e-3, 1e3, 1.0, null, 1.0][k + 1], 6) as value_um, [' nM', ' mM', ' microM', null, ' uM'][k + 1][2:] as unit from u")
def b05(t: Tables):
    unit = F.get(F.array(*map(F.lit, [" nM", " mM", " microM", " M", " uM"])), (F.col("seq") % 5).cast("int"))
    c = parse.parse_concentration(F.concat(F.regexp_extract("parameter", "^[0-9.]+", 0), unit))
    return t.raw().select("seq", c.alias("c")).select("seq", F.col("c.raw").alias("raw"), r6("c.value_uM").alias("value_um"), F.col("c.unit").alias("unit"))


@query("b06_classify_assay", "select p_type, case when p_type ilike '%tht%' then 'ThT' when p_type ilike '%congo%' then 'CongoRed' when p_type ilike '%turbid%' then 'turbidity' when p_type ilike '%fluor%' then 'fluorescence' else p_type end as name, case when p_type ilike '%tht%' or p_type ilike '%congo%' then true when p_type ilike '%turbid%' then false when p_type ilike '%fluor%' then true end as mass, count(*) as n from (select case p_size % 5 when 0 then 'ThT assay' when 1 then 'Congo red ' || p_type when 2 then 'Turbidity (350 nm)' when 3 then 'Fluorescence' else p_type end as p_type from part) group by all")
def b06(t: Tables):
    s, p = F.col("p_size") % 5, F.col("p_type")
    text = F.when(s == 0, "ThT assay").when(s == 1, F.concat(F.lit("Congo red "), p)).when(s == 2, "Turbidity (350 nm)").when(s == 3, "Fluorescence").otherwise(p)
    return t.part.select(text.alias("p_type")).groupBy("p_type").agg(F.count("*").alias("n")).withColumn("a", parse.classify_assay(F.col("p_type"))).select("p_type", "a.name", "a.mass", "n")


@query("b07_condition_vector", f"with {COND} select curve_id, count(*) filter (known = 'known') as n_known, count(*) filter (known = 'unknown') as n_unknown from (select curve_id, unnest([case when protein is null then 'unknown' else 'known' end, case when ph = 0 then 'unknown' else 'known' end, case when temp < 10 then 'unknown' else 'known' end, 'unknown']) as known from cond) group by 1")
def b07(t: Tables):
    c = t.conditions().select("curve_id", F.struct("protein", F.when(F.col("ph") != 0, F.col("ph")).alias("ph"), F.when(F.col("temp") >= 10, F.col("temp")).alias("temp"), F.lit(None).cast("boolean").alias("agitation")).alias("cv"))
    known = F.create_map(*[x for f in ("protein", "ph", "temp", "agitation") for x in (F.lit(f), F.when(F.col(f"cv.{f}").isNull(), "unknown").otherwise("known"))])
    n = lambda v: F.sum(F.size(F.map_filter("provenance", lambda _, x: x == v))).alias(f"n_{v}")
    return c.withColumn("provenance", known).groupBy("curve_id").agg(n("known"), n("unknown"))


@query("b08_is_wt", f"with {_PEP} select pep_id, coalesce(mutant, 'WT') = 'WT' as wt from pep")
def b08(t: Tables):
    return peptides(t).select("pep_id", parse.is_wt(F.col("mutant")).alias("wt"))


@query("b09_drop_sentinel", f"with {_PEP} select pep_id, case when pasta < 10000 then pasta end as pasta from pep")
def b09(t: Tables):
    return peptides(t).select("pep_id", parse.drop_sentinel(F.col("pasta")).alias("pasta"))


@query("b10_axis_values", f"with {COND} select seq, curve_id, round_even(conc / 7, 4) as conc_axis, round_even(ph / 4, 1) as ph_axis, round_even(temp / 2, 0) as temp_axis from cond")
def b10(t: Tables):
    return t.conditions().select("seq", "curve_id", *curves.axis_values(F.col("conc") / 7, F.col("ph") / 4, F.col("temp") / 2))


@query("b11_endpoint_class", f"with {COND} select seq, curve_id, case assay when 'A' then 'amyloid' when 'N' then 'generic' else 'unknown' end as endpoint from cond")
def b11(t: Tables):
    return t.conditions().select("seq", "curve_id", parse.endpoint_class(F.when(F.col("assay") == "A", "ThT").when(F.col("assay") == "N", "turbidity")).alias("endpoint"))


@query("b12_scales", f"with {COND} select seq, curve_id, round(case when t50 - 20 > 0 then log10(t50 - 20) end, 6) as scaled, round(case when t50 - 20 > 0 then pow(10.0, log10(t50 - 20)) end, 6) as back from cond")
def b12(t: Tables):
    s = parse.to_scale(F.col("t50") - 20, "log10")
    return t.conditions().select("seq", "curve_id", r6(s).alias("scaled"), r6(parse.from_scale(s, "log10")).alias("back"))


@query("b13_sd_from_interval", "select curve_id, case when hi > lo then round((hi - lo) / 3.92, 6) end as sd from (select user_id as curve_id, log10(min(value) filter (value > 0)) as lo, log10(max(value) filter (value > 0)) as hi from events group by 1)")
def b13(t: Tables):
    g = t.events.where("value > 0").groupBy(F.col("user_id").alias("curve_id")).agg(F.log10(F.min("value")).alias("lo"), F.log10(F.max("value")).alias("hi"))
    return t.events.select(F.col("user_id").alias("curve_id")).distinct().join(g, "curve_id", "left").select("curve_id", r6(parse.sd_from_interval(F.col("lo"), F.col("hi"))).alias("sd"))


@query("b14_ref_position", f"with {COND}, x as (select seq, curve_id, (log10(t50) - log10(5.0)) / (log10(50.0) - log10(5.0)) as x from cond) select seq, curve_id, round(greatest(0.0, least(1.0, x)), 6) as position, case when x < 0 then 'below' when x > 1 then 'above' else 'in' end as side from x")
def b14(t: Tables):
    return t.conditions().select("seq", "curve_id", parse.ref_position(F.col("t50"), 5.0, 50.0, True).alias("p")).select("seq", "curve_id", r6("p.position").alias("position"), "p.side")


@query("b15_propensity_direction", f"with {COND} select seq, curve_id, round(case when assay in ('A', 'N') then 100 - conc * 2 else conc * 2 end, 6) as propensity from cond")
def b15(t: Tables):
    p = F.col("conc") * 2
    return t.conditions().select("seq", "curve_id", r6(F.when(F.col("assay").isin("A", "N"), 100 - p).otherwise(p)).alias("propensity"))


@query("b16_plausible", f"with {COND}, f as (select curve_id, seq, unnest(['ph', 'temp', 'conc']) as field, unnest([ph, temp, conc]) as v from cond) select field, case when v is null then 'missing' when v < lo then 'below_range' when v > hi then 'above_range' else 'ok' end as verdict, count(*) as n from f join (values ('ph', 1.0, 9.5), ('temp', 4.0, 45.0), ('conc', 2.0, 40.0)) r(field, lo, hi) using (field) group by all")
def b16(t: Tables):
    ranges = t.spark.createDataFrame([("ph", 1.0, 9.5), ("temp", 4.0, 45.0), ("conc", 2.0, 40.0)], "field string, lo double, hi double")
    f = t.conditions().unpivot(["curve_id", "seq"], ["ph", "temp", "conc"], "field", "v").join(F.broadcast(ranges), "field")
    return f.groupBy("field", parse.plausible(F.col("v"), F.col("lo"), F.col("hi")).alias("verdict")).agg(F.count("*").alias("n"))


@query("b17_parse_span", "select p_partkey, p_size as first, case when p_size % 4 > 0 then p_size + 7 end as last from part")
def b17(t: Tables):
    text = F.concat(F.col("p_size").cast("string"), F.lit("-"), F.when(F.col("p_size") % 4 > 0, (F.col("p_size") + 7).cast("string")).otherwise("x"))
    return t.part.select("p_partkey", parse.parse_span(text).alias("s")).select("p_partkey", "s.first", "s.last")


@query("b18_reducing_agent", "select p_partkey, case p_size % 3 when 0 then 'DTT' when 1 then 'tcep' end as agent from part")
def b18(t: Tables):
    s = F.col("p_size") % 3
    text = F.concat(F.lit("10 mM Tris, "), F.when(s == 0, "1 mM DTT").when(s == 1, "2 mM tcep").otherwise("NaCl"))
    return t.part.select("p_partkey", parse.reducing_agent(text).alias("agent"))


@query("b19_seed", "select o_orderkey, ('0x' || substr(md5('b:' || o_orderkey::varchar), 1, 12))::bigint as seed from orders")
def b19(t: Tables):
    return t.orders.select("o_orderkey", parse.seed(F.col("o_orderkey"), "b").alias("seed"))


_FIRST = ["assay", "conc", "ph", "protein", "temp", "construct", "t50"]
_CURVES = f"{COND}, first as ({_first_sql(_FIRST)})"


def first_conditions(t: Tables):
    return curves.first_row_attrs(t.conditions(), _FIRST)


@query("c01_concentration_series", f"with {_CURVES} select md5(concat_ws('|', protein, assay)) as series_id, protein, assay, count(distinct conc::varchar) as n_conc, count(*) as n_members from first group by protein, assay having count(distinct conc::varchar) >= 3")
def c01(t: Tables):
    c = first_conditions(t).withColumn("conc_raw", F.col("conc").cast("string"))
    return curves.concentration_series(c, ["protein", "assay"]).select("series_id", "protein", "assay", "n_conc", "n_members")


@query("c02_series_index", f"with {_CURVES} select curve_id, count(*) over (partition by protein, assay) as series_size, count(*) over (partition by protein, assay, conc) as n_replicates from first")
def c02(t: Tables):
    n = lambda *k: F.count("*").over(Window.partitionBy(*k))
    return first_conditions(t).select("curve_id", n("protein", "assay").alias("series_size"), n("protein", "assay", "conc").alias("n_replicates"))


@query("c03_stratum_key", f"with {_CURVES} select curve_id, concat_ws('|', protein, coalesce(nullif(construct, ''), 'Wild Type'), assay, round_even(ph, 1)::varchar, round_even(temp, 0)::varchar) as stratum from first")
def c03(t: Tables):
    return first_conditions(t).select("curve_id", F.concat_ws("|", "protein", F.coalesce(F.nullif("construct", F.lit("")), F.lit("Wild Type")), "assay", F.bround("ph", 1).cast("string"), F.bround("temp", 0).cast("string")).alias("stratum"))


@query("c04_comparability", f"with {_CURVES}, c as (select protein as cohort, count(distinct construct) as n_construct, count(distinct assay) as n_assay, count(*) filter (temp < 5) as n_missing from first group by 1) select cohort, field, n_levels, case when n_levels > 1 then 'mismatch' when n_missing > 0 then 'degraded' else 'ok' end as verdict from (select cohort, n_missing, unnest(['construct', 'assay']) as field, unnest([n_construct, n_assay]) as n_levels from c)")
def c04(t: Tables):
    c = first_conditions(t).groupBy(F.col("protein").alias("cohort")).agg(F.countDistinct("construct").alias("construct"), F.countDistinct("assay").alias("assay"), F.count(F.when(F.col("temp") < 5, 1)).alias("n_missing"))
    return c.unpivot(["cohort", "n_missing"], ["construct", "assay"], "field", "n_levels").select("cohort", "field", "n_levels", F.when(F.col("n_levels") > 1, "mismatch").when(F.col("n_missing") > 0, "degraded").otherwise("ok").alias("verdict"))


@query("c05_varying_axes", f"with {_CURVES}, f as (select protein as cohort, unnest(['conc', 'ph', 'temp']) as axis, unnest([round_even(conc, 4), round_even(ph, 1), round_even(temp, 0)]) as v from first) select cohort, axis, count(distinct v) as n_levels, min(v) as least, max(v) as most from f group by all having count(distinct v) > 1")
def c05(t: Tables):
    a = first_conditions(t).select(F.col("protein").alias("cohort"), *curves.axis_values(F.col("conc"), F.col("ph"), F.col("temp")))
    f = a.select("cohort", F.col("conc_axis").alias("conc"), F.col("ph_axis").alias("ph"), F.col("temp_axis").alias("temp")).unpivot(["cohort"], ["conc", "ph", "temp"], "axis", "v")
    levels = f.groupBy("cohort", "axis").agg(F.sort_array(F.collect_set("v")).alias("l"))
    return levels.where(F.size("l") > 1).select("cohort", "axis", F.size("l").cast("long").alias("n_levels"), F.get("l", F.lit(0)).alias("least"), F.get("l", F.size("l") - 1).alias("most"))


@query("c06_data_mode", f"with {_CURVES}, c as (select protein || construct as cohort, count(*) as n, count(distinct assay) as n_assay, count(distinct round_even(conc, 4)) as n_conc, count(distinct round_even(ph, 1)) as n_ph, count(distinct round_even(temp, 0)) as n_temp from first group by 1) select cohort, n, case when n = 0 then 'empty' when n = 1 then 'single' when n_assay > 1 then 'confounded' when n_conc = 1 and n_ph = 1 and n_temp = 1 then 'replicates' when n_ph = 1 and n_temp = 1 and n_conc >= 3 then 'concentration_series' when (n_conc > 1)::integer + (n_ph > 1)::integer + (n_temp > 1)::integer = 1 then 'condition_series' else 'confounded' end as mode from c")
def c06(t: Tables):
    c = first_conditions(t).groupBy(F.concat("protein", "construct").alias("cohort")).agg(F.count("*").alias("n"), F.countDistinct("assay").alias("a"), *[F.countDistinct(x).alias(k) for k, x in zip(("c", "p", "t"), curves.axis_values(F.col("conc"), F.col("ph"), F.col("temp")), strict=True)])
    vary = sum(((F.col(k) > 1).cast("int") for k in ("c", "p", "t")), F.lit(0))
    return c.select("cohort", "n", F.when(F.col("n") == 0, "empty").when(F.col("n") == 1, "single").when(F.col("a") > 1, "confounded").when(vary == 0, "replicates").when((F.col("p") == 1) & (F.col("t") == 1) & (F.col("c") >= 3), "concentration_series").when(vary == 1, "condition_series").otherwise("confounded").alias("mode"))


@query("c07_validity_window", f"with {_CURVES} select protein as cohort, round(min(ph), 6) as ph_min, round(max(ph), 6) as ph_max, count(distinct round_even(ph, 1)) as ph_levels, min(temp) as temp_min, max(temp) as temp_max, string_agg(distinct assay, ',' order by assay) as assays from first group by 1")
def c07(t: Tables):
    return first_conditions(t).groupBy(F.col("protein").alias("cohort")).agg(r6(F.min("ph")).alias("ph_min"), r6(F.max("ph")).alias("ph_max"), F.countDistinct(F.bround("ph", 1)).alias("ph_levels"), F.min("temp").alias("temp_min"), F.max("temp").alias("temp_max"), F.array_join(F.sort_array(F.collect_set("assay")), ",").alias("assays"))


@query("c09_feature_surface", f"with {_CURVES} select protein as cohort, curve_id, round(t50, 6) as t50, conc as axis, row_number() over (partition by protein order by conc nulls last, curve_id) as place from first")
def c09(t: Tables):
    return first_conditions(t).select(F.col("protein").alias("cohort"), "curve_id", r6("t50").alias("t50"), F.col("conc").alias("axis"), F.row_number().over(Window.partitionBy("protein").orderBy(F.col("conc").asc_nulls_last(), "curve_id")).alias("place"))
