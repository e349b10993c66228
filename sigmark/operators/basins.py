"""Basins of a fit: where its starts end, which of them agree, and whether the winner has a rival that is as good."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bank import candidates
from .graph import components, cut

# Outcomes this near are one basin; rivals this near in SSE make a knife edge; floors of the two denominators.
DISTANCE, GAP, FLOOR, SST_SHARE = 1e-3, 1e-3, 1e-12, 1e-9


def lattice(model: str) -> list[tuple[int, float, float, list[int]]]:
    """(candidate, p1, p2, neighbours): the model's grid; neighbours are places in this list at most one step away in every parameter, itself included."""
    rows = [r for r in candidates() if r[0] == model]
    steps = [{v: i for i, v in enumerate(sorted({r[k] for r in rows}))} for k in (2, 3, 4)]
    at = [[steps[k][r[k + 2]] for k in range(3)] for r in rows]
    near = [[j for j, b in enumerate(at) if all(abs(x - y) <= 1 for x, y in zip(a, b))] for a in at]
    return [(r[1], r[2], r[3], n) for r, n in zip(rows, near)]


def descend(profiles: DataFrame, model: str, keys: list[str]) -> DataFrame:
    """Outcomes (keys, start, converged, sse, theta, failure, sst) of a descent from every candidate of the grid.

    A start goes to the best of its neighbours until it is the best itself. All
    starts of a fit are one array as long as the grid, and pointers are followed
    by doubling, so a descent needs no exchange beyond the sums of the profile.
    A start that ends without amplitude has found no curve and fails.
    """
    grid = lattice(model)
    rows = profiles.where(F.col("model") == model).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("candidate", "sse", "base", "amp"))).alias("c"), F.max("sst").alias("sst"))
    near, shape = F.lit([n for *_, n in grid]), F.lit([[a, b] for _, a, b, _ in grid])
    step = F.transform(near, lambda js: F.array_min(F.transform(js, lambda j: F.struct(F.col("c")[j]["sse"].alias("sse"), j.alias("j"))))["j"])
    ends = F.aggregate(F.sequence(F.lit(1), F.lit(math.ceil(math.log2(len(grid))))), F.col("step"), lambda p, _: F.transform(p, lambda j: p[j]))
    out = rows.withColumn("step", step).withColumn("ends", ends).select(*keys, "sst", "c", F.posexplode("ends").alias("i", "j"))
    end = F.col("c")[F.col("j")]
    out = out.select(*keys, F.col("c")[F.col("i")]["candidate"].alias("start"), end["sse"].alias("sse"), F.concat(shape[F.col("j")], F.array(end["base"], end["amp"])).alias("theta"), "sst")
    found = F.element_at("theta", -1) > 1e-9
    return out.select(*keys, "start", found.alias("converged"), "sse", "theta", F.when(~found, "no_amplitude").alias("failure"), "sst")


def _floor(i: Column, atol: list[float] | None) -> Column:
    return F.lit(FLOOR) if atol is None else F.coalesce(F.get(F.lit(atol), i), F.lit(FLOOR))


def distance(a: Column, b: Column, atol: list[float] | None = None) -> Column:
    """The largest relative difference of a parameter; null where lengths differ."""
    each = F.transform(a, lambda x, i: F.abs(x - F.get(b, i)) / F.greatest(F.abs(x), F.abs(F.get(b, i)), _floor(i, atol)))
    return F.when(F.size(a) == F.size(b), F.array_max(each))


def _stretched(theta: Column, width: float, atol: list[float] | None) -> Column:
    """Cells of parameters on a scale where relative differences are lengths: linear up to the floor, logarithmic beyond."""

    def cell(x: Column, i: Column) -> Column:
        size = F.abs(x) / _floor(i, atol)
        return F.floor(F.signum(x) * F.when(size > 1, F.ln(size) + 1).otherwise(size) / width)

    return F.transform(theta, cell)


def clusters(outcomes: DataFrame, keys: list[str], tol: float = DISTANCE, atol: list[float] | None = None) -> DataFrame:
    """Converged outcomes with ``basin``, the least start of its single-linkage cluster at relative distance tol.

    Equal outcomes are folded first. Those in one fine cell (as wide as tol in
    every parameter) are surely near and linked to the cell's least start.
    Others are looked for in the neighbouring cells of their first two
    parameters and held against the distance; links become components. An
    outcome with a parameter that is not finite is a basin of its own. Tables of
    outcomes are merged: their files are small by compression only, and Spark
    would take them for small enough to broadcast.
    """
    theta = F.col("theta")
    finite = ~F.exists(theta, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    ok = outcomes.where(F.col("converged") & theta.isNotNull() & ~F.exists(theta, lambda x: x.isNull()) & F.col("sse").isNotNull() & ~F.isnan("sse") & (F.abs("sse") < float("inf")))
    rows = ok.withColumn("_k", F.struct(*keys)).withColumn("_alone", F.when(~finite, F.col("start")))
    nodes = rows.groupBy("_k", "theta", "_alone").agg(F.min("start").alias("start"))
    nodes = cut(nodes.withColumn("id", F.struct("_k", "start")))
    near = nodes.where("_alone is null").withColumns({"fine": _stretched(theta, tol, atol), "wide": _stretched(theta, -math.log1p(-tol), atol)})
    near = near.select("_k", "id", "start", "theta", "fine", F.get("wide", F.lit(0)).alias("u"), F.coalesce(F.get("wide", F.lit(1)), F.lit(0)).alias("v"))
    cells = near.groupBy("_k", "fine").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = near.join(cells.hint("merge"), ["_k", "fine"]).where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b"))
    ask = near.select("_k", F.col("id").alias("a"), F.col("start").alias("s"), F.col("theta").alias("other"), F.col("fine").alias("f"), F.explode(F.array(*[F.struct((F.col("u") + i).alias("u"), (F.col("v") + j).alias("v")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("at"))
    ask = ask.select("_k", "a", "s", "other", "f", "at.u", "at.v")
    pairs = ask.join(near.hint("merge"), ["_k", "u", "v"]).where((F.col("s") < F.col("start")) & (F.col("f") != F.col("fine")) & (distance(F.col("other"), theta, atol) <= tol))
    label = components(cut(stars.unionByName(pairs.select("a", F.col("id").alias("b")))), nodes.select("id"))
    named = nodes.join(label.hint("merge"), "id").select("_k", "theta", "_alone", F.col("least.start").alias("basin"))
    same = [rows[c].eqNullSafe(named[c]) for c in ("_k", "theta", "_alone")]
    return rows.join(named.hint("merge"), same).select(*[rows[c] for c in outcomes.columns], "basin")


def ledger(outcomes: DataFrame, keys: list[str], tol: float = DISTANCE, gap: float = GAP, atol: list[float] | None = None) -> DataFrame:
    """One row a fit: starts, the winner (ties: the earliest start), its basin, the nearest rival in SSE and in parameters, and a state.

    States: no_fit (no start converged), not_evaluable (one did), stable (all
    agree, or every rival is worse by more than gap), knife_edge. The gap is
    relative to the winner's SSE, or to a billionth of sst where that is larger.
    """
    g = F.struct(*keys)
    starts = outcomes.groupBy(g.alias("_k")).agg(F.count("*").alias("n_starts"), F.max("sst").alias("sst"))
    c = clusters(outcomes, keys, tol, atol).withColumn("_k", g)
    first = F.struct("sse", "start", "theta", "basin")
    win = c.groupBy("_k").agg(F.min_by(first, F.struct("sse", "start")).alias("w"), F.count("*").alias("n_converged"), F.countDistinct("basin").alias("n_basins"))
    rival = F.col("basin") != F.col("w.basin")
    r = c.join(win.hint("merge"), "_k").groupBy("_k").agg(*[F.first(x).alias(f"_{x}") for x in ("w", "n_converged", "n_basins")], F.count(F.when(~rival, 1)).alias("n_agree"), F.min(F.when(rival, F.col("sse"))).alias("rival_sse"), F.min(F.when(rival, distance(F.col("theta"), F.col("w.theta"), atol))).alias("param_gap"))
    r = r.withColumnsRenamed({f"_{x}": x for x in ("w", "n_converged", "n_basins")})
    j = starts.join(r.hint("merge"), "_k", "left").fillna(0, ["n_converged", "n_basins", "n_agree"])
    unit = F.greatest(F.abs("w.sse"), F.lit(FLOOR), F.coalesce(F.col("sst") * SST_SHARE, F.lit(0.0)))
    j = j.withColumn("sse_gap", (F.col("rival_sse") - F.col("w.sse")) / unit)
    n, b = F.col("n_converged"), F.col("n_basins")
    reason = F.when(n == 0, "no_start_converged").when((n == 1) & (F.col("n_starts") == 1), "single_start_constructed").when(n == 1, "single_start_converged").when(b == 1, "all_starts_agree").when(F.col("sse_gap") > gap, "rivals_decisively_worse").otherwise("basins_within_sse_tol")
    state = F.when(n == 0, "no_fit").when(n == 1, "not_evaluable").when((b == 1) | (F.col("sse_gap") > gap), "stable").otherwise("knife_edge")
    return j.select("_k.*", "n_starts", "n_converged", F.col("w.start").alias("win"), F.col("w.sse").alias("win_sse"), "n_basins", F.when(n > 0, F.col("n_agree") / n).alias("share"), "rival_sse", "sse_gap", "param_gap", state.alias("state"), reason.alias("reason"))


def stable(rows: DataFrame) -> DataFrame:
    """Fits that may serve as anchors."""
    return rows.where("state = 'stable'")
