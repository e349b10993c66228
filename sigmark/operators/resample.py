"""Scaling exponents and resampling: replicates as rows, sums as aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import parse, tails
from ..functions.digest import Numbers

#: Rows of a group that a task may hold as arrays, so that its draws are made without a row for each; tasks that a group's draws are dealt to.
LARGEST, PARTS = 1 << 22, 4


def by_cell(rows: DataFrame, by: str, columns: list[str], draws: range, of: Callable[[str, dict[str, np.ndarray], range], Iterator[tuple[int, float]]], name: str, shuffled: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(by, draw, name) that of gives for each draw of each group; of groups that are too large for a task, that shuffled gives for their rows.

    A group's rows are sent to PARTS tasks, which share its draws.  The groups are
    counted first.  Of those beyond LARGEST rows there are few, so their keys can be
    broadcast.
    """
    large = rows.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") > LARGEST).select(by)
    some = large.limit(1).count() > 0
    first, last, parts = draws.start, draws.stop, PARTS
    held = (rows.join(F.broadcast(large), by, "left_anti") if some else rows).where(F.col(by).isNotNull())
    held = held.select(by, *columns, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))

    def cell(table: pa.Table) -> pa.Table:
        key = table.column(by)[0]
        own = range(first + table.column("_part")[0].as_py(), last, parts)
        got = list(of(str(key.as_py()), {c: table.column(c).to_numpy() for c in columns}, own))
        values = [pa.array([key.as_py()] * len(got), key.type), pa.array([d for d, _ in got], pa.int32()), pa.array(np.array([v for _, v in got], float), from_pandas=True)]
        return pa.Table.from_arrays(values, names=[by, "draw", name])

    schema = StructType([rows.schema[by]]).add("draw", "integer").add(name, "double")
    # by number, since by size few tasks would be left, and these rows are long in work
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = held.repartition(tasks, by, "_part").groupBy(by, "_part").applyInArrow(cell, schema)
    return out.unionByName(shuffled(rows.join(F.broadcast(large), by, "left_semi"))) if some else out


def correlation(x: np.ndarray, y: np.ndarray) -> float:
    """Of the pairs that are whole; NaN where a side is constant."""
    ok = ~(np.isnan(x) | np.isnan(y))
    if not ok.all():
        x, y = x[ok], y[ok]
    if not len(x) or x.min() == x.max() or y.min() == y.max():
        return np.nan
    a, b = x - x.mean(), y - y.mean()
    return a @ b / np.sqrt((a @ a) * (b @ b))


def gamma_ols(points: DataFrame, by: str) -> DataFrame:
    """gamma = -slope of log10 t50 on log10 concentration, three distinct concentrations or more."""
    g = points.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct("conc").alias("n_conc"), F.regr_slope("lt", "lc").alias("slope"), F.regr_r2("lt", "lc").alias("r2"))
    return g.where("n_conc >= 3").select(by, "n", "n_conc", (-F.col("slope")).alias("gamma"), "r2")


def gamma_censored(points: DataFrame, by: str, passes: int = 3) -> DataFrame:
    """Right-censored regression by so many EM passes: a bound counts as its expected value above the bound under the last fit."""
    rows = points.withColumn("v", F.col("lt"))
    for _ in range(passes):
        f = rows.groupBy(by).agg(F.regr_slope("v", "lc").alias("b"), F.regr_intercept("v", "lc").alias("a"), F.sqrt(F.greatest(F.lit(1e-9), (F.regr_syy("v", "lc") - F.pow(F.regr_sxy("v", "lc"), 2) / F.nullif(F.regr_sxx("v", "lc"), F.lit(0.0))) / F.count("*"))).alias("s"))
        r = rows.join(f, by)
        mu = F.col("a") + F.col("b") * F.col("lc")
        z = (F.col("lt") - mu) / F.col("s")
        tail = F.greatest(tails.norm_sf(z), F.lit(1e-6))
        up = mu + F.col("s") * tails.ROOT * F.exp(-z * z / 2) / tail
        rows = r.withColumn("v", F.when(F.col("censored"), F.greatest("lt", up)).otherwise(F.col("lt"))).select(by, "lc", "lt", "conc", "censored", "v")
    return rows.groupBy(by).agg((-F.regr_slope("v", "lc")).alias("gamma"), F.count(F.when(F.col("censored"), 1)).alias("n_censored"))


def mcrit_profile(points: DataFrame, by: str, steps: int = 12) -> DataFrame:
    """The critical concentration, of a grid below the least one, at which log t50 on log(m - mc) fits best."""
    spark = points.sparkSession
    low = points.groupBy(by).agg(F.min("conc").alias("lo"))
    grid = low.join(F.broadcast(spark.range(steps).select((F.col("id") / steps * 0.95).alias("share")))).select(by, (F.col("share") * F.col("lo")).alias("mc"), "lo")
    r = points.join(grid, by).withColumn("x", F.log10(F.col("conc") - F.col("mc")))
    sse = F.regr_syy("lt", "x") - F.pow(F.regr_sxy("lt", "x"), 2) / F.nullif(F.regr_sxx("lt", "x"), F.lit(0.0))
    s = r.groupBy(by, "mc", "lo").agg(F.round(sse, 9).alias("sse"))
    g = s.groupBy(by).agg(F.min_by(F.struct("mc", "sse", "lo"), F.struct("sse", "mc")).alias("best"), F.max(F.when(F.col("mc") == 0, F.col("sse"))).alias("nominal"))
    return g.select(by, "best.mc", "best.sse", "nominal", ((F.col("best.sse") < 0.9 * F.col("nominal")) & (F.col("best.mc") > 0.05 * F.col("best.lo"))).alias("accepted"))


def case_draws(rows: DataFrame, by: str, key: str, draws: int, base: str) -> DataFrame:
    """Each group drawn anew with replacement, draws times: a row's place in a draw is an md5 uniform of (draw, place)."""
    w = Window.partitionBy(by)
    numbered = rows.withColumn("_i", F.row_number().over(w.orderBy(*key.split(","))) - 1).withColumn("_n", F.count("*").over(w))
    reps = numbered.select(by, "_n", F.col("_i").alias("_slot")).join(F.broadcast(rows.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw"))))
    u = parse.uniform(F.concat_ws(":", F.col("draw").cast("string"), F.col(by).cast("string"), F.col("_slot").cast("string")), base)
    picks = reps.select(by, "draw", F.floor(u * F.col("_n")).cast("int").alias("_i"))
    return picks.join(numbered.drop("_n"), [by, "_i"]).drop("_i")


def gamma_ci(points: DataFrame, by: str, key: str, draws: int, least: int = 20) -> DataFrame:
    """2.5 and 97.5 percentiles of gamma over draws; draws beyond 5 are rejected and counted."""
    order = key.split(",")

    def drawn(group: str, a: dict[str, np.ndarray], own: range) -> Iterator[tuple[int, float]]:
        at = np.lexsort([a[c] for c in reversed(order)])
        x, y = a["lc"][at], a["lt"][at]
        ok = ~(np.isnan(x) | np.isnan(y))
        x, y = (np.where(ok, v - (v[ok].mean() if ok.any() else 0.0), 0.0) for v in (x, y))
        xx, xy, slots = x * x, x * y, Numbers(np.arange(len(x)))
        for draw in own:
            picks = np.floor(slots.uniform(f"gamma:{draw}:{group}:".encode()) * len(x)).astype(np.int64)
            times = np.bincount(picks, minlength=len(x)) * ok
            n, sx, sxx = times.sum(), times @ x, times @ xx
            left = sxx - sx * sx / n if n else 0.0
            # of a draw of one value there is noise left, if anything
            none = left <= 0 or (left < 1e-9 * sxx and np.ptp(x[times > 0]) == 0)
            yield draw, np.nan if none else -(times @ xy - sx * (times @ y) / n) / left

    shuffled = lambda large: case_draws(large, by, key, draws, "gamma").groupBy(by, "draw").agg((-F.regr_slope("lt", "lc")).alias("g"))
    d = by_cell(points, by, list(dict.fromkeys([*order, "lt", "lc"])), range(draws), drawn, "g", shuffled)
    ok = F.col("g").isNotNull() & (F.abs("g") <= 5)
    g = d.groupBy(by).agg(F.count(F.when(ok, 1)).alias("n_draws"), F.count(F.when(~ok, 1)).alias("n_rejected"), F.percentile(F.when(ok, F.col("g")), F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return g.select(by, "n_draws", "n_rejected", F.when(F.col("n_draws") >= least, F.col("q")[0]).alias("lo"), F.when(F.col("n_draws") >= least, F.col("q")[1]).alias("hi"))


def flag_correlations(rows: DataFrame, by: str, key: str, x: str, flag: str, draws: int, base: str = "perm") -> DataFrame:
    """(by, draw, c): correlation of x with the flags of each group dealt anew: to the rows with the least md5 of (draw, group, key)."""

    def drawn(group: str, a: dict[str, np.ndarray], own: range) -> Iterator[tuple[int, float]]:
        at = np.lexsort((a[x], a[key]))
        v, n, keys = a[x][at], int(a[flag].sum()), Numbers(a[key][at])
        for draw in own:
            dealt = np.zeros(len(v))
            dealt[keys.order(f"{base}:{draw}:{group}:".encode())[:n]] = 1.0
            yield draw, correlation(v, dealt)

    def shuffled(large: DataFrame) -> DataFrame:
        reps = large.join(F.broadcast(rows.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw"))))
        reps = reps.withColumn("_n", F.sum(F.col(flag).cast("int")).over(Window.partitionBy(by, "draw")))
        w = Window.partitionBy(by, "draw").orderBy(F.md5(F.concat_ws(":", F.lit(base), F.col("draw").cast("string"), by, F.col(key).cast("string"))), key, x)
        return reps.withColumn("_f", (F.row_number().over(w) <= F.col("_n")).cast("int")).groupBy(by, "draw").agg(F.corr(x, "_f").alias("c"))

    return by_cell(rows, by, [key, x, flag], range(draws), drawn, "c", shuffled)


def block_mammen(key: Column, block: Column, draw: Column) -> Column:
    """Two-point weights, one value a block of residuals: mean 0, variance 1, third moment 1."""
    root = 5**0.5
    u = parse.uniform(F.concat_ws(":", key.cast("string"), block.cast("string"), draw.cast("string")), "mammen")
    return F.when(u < (root + 1) / (2 * root), F.lit(-(root - 1) / 2)).otherwise(F.lit((root + 1) / 2))
