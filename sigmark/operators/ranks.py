"""Rank and permutation statistics, calibration and conformal prediction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse, tails
from ..functions.digest import Numbers
from . import resample
from .selection import kth, running


def avg_rank(value: str, *by: str) -> Column:
    """Rank with ties at their mean."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def correlations(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Pearson and Spearman of each group with three rows or more and no constant side."""
    r = rows.withColumn("_rx", avg_rank(x, *by)).withColumn("_ry", avg_rank(y, *by))
    g = r.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))
    return g.where("n >= 3")


def permuted(rows: DataFrame, key: str, y: str, by: str, draws: int, base: str) -> DataFrame:
    """rows for each draw with y of another row of the group: both sides numbered, one in order of an md5."""
    reps = rows.select(by, key, y).join(F.broadcast(rows.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw"))))
    a = rows.withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy(key)))
    h = F.md5(F.concat_ws(":", F.lit(base), F.col("draw").cast("string"), F.col(key).cast("string")))
    b = reps.withColumn("_i", F.row_number().over(Window.partitionBy(by, "draw").orderBy(h, key))).select(by, "draw", "_i", F.col(y).alias("py"))
    return a.join(b, [by, "_i"]).drop("_i")


def perm_pvalue(rows: DataFrame, key: str, x: str, y: str, by: str, draws: int, base: str = "perm") -> DataFrame:
    """Two-sided p of each group's correlation, with 1 added to both counts."""
    seen = rows.groupBy(by).agg(F.corr(x, y).alias("r"))

    def each(group: str, a: dict[str, np.ndarray], own: range) -> Iterator[tuple[int, float]]:
        at = np.argsort(a[key])
        fixed, moved, keys = a[x][at], a[y][at], Numbers(a[key][at])
        for draw in own:
            yield draw, resample.correlation(fixed, moved[keys.order(f"{base}:{draw}:".encode())])

    shuffled = lambda large: permuted(large, key, y, by, draws, base).groupBy(by, "draw").agg(F.corr(x, "py").alias("pr"))
    drawn = resample.by_cell(rows, by, [key, x, y], range(draws), each, "pr", shuffled)
    hit = F.abs("pr") >= F.abs("r") - 1e-9
    return drawn.join(seen, by).groupBy(by).agg(F.first("r").alias("r"), ((F.count(F.when(hit, 1)) + 1) / (F.count("*") + 1)).alias("p"))


def variance_ceiling(rows: DataFrame, y: str, group: str, *by: str) -> DataFrame:
    """Share of the sum of squares that lies between groups: what a predictor of the group alone can reach."""
    r = rows.withColumn("_gm", F.avg(y).over(Window.partitionBy(*by, group))).withColumn("_m", F.avg(y).over(Window.partitionBy(*by)))
    return r.groupBy(*by).agg((F.sum(F.pow(F.col("_gm") - F.col("_m"), 2)) / F.nullif(F.sum(F.pow(F.col(y) - F.col("_m"), 2)), F.lit(0.0))).alias("ceiling"))


def lopo(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """rows with the prediction of a line fitted to all others of the group, from the group's sums less the row's own."""
    w = Window.partitionBy(*by)
    c = {"n": F.lit(1.0), "x": F.col(x), "y": F.col(y), "xx": F.col(x) * F.col(x), "xy": F.col(x) * F.col(y)}
    r = rows.withColumns({f"_{k}": F.sum(v).over(w) - v for k, v in c.items()}).withColumn("_mean", F.avg(y).over(w))
    sxx = F.col("_xx") - F.col("_x") * F.col("_x") / F.col("_n")
    slope = F.when(sxx > 1e-9, (F.col("_xy") - F.col("_x") * F.col("_y") / F.col("_n")) / sxx).otherwise(0.0)
    r = r.withColumn("_b", slope).withColumn("predicted", (F.col("_y") - F.col("_b") * F.col("_x")) / F.col("_n") + F.col("_b") * F.col(x))
    return r.where("_n >= 2").drop("_n", "_x", "_y", "_xx", "_xy", "_b")


def lopo_r2(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    p = lopo(rows, x, y, *by)
    return p.groupBy(*by).agg((1 - F.sum(F.pow(F.col(y) - F.col("predicted"), 2)) / F.nullif(F.sum(F.pow(F.col(y) - F.col("_mean"), 2)), F.lit(0.0))).alias("r2"))


def jonckheere(rows: DataFrame, level: str, value: str, by: str) -> DataFrame:
    """J and z over ordered levels: pairs are counted by running sums over distinct values, never formed."""
    counts = rows.groupBy(by, level, value).agg(F.count("*").alias("c"))
    levels = rows.groupBy(by, level).agg(F.count("*").alias("n"))
    n = levels.groupBy(by).agg(F.sum("n").alias("nn"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("n") * F.col("n") * (2 * F.col("n") + 3)).alias("n3"))
    other = levels.select(by, F.col(level).alias("_o"))
    high = counts.join(other, by).where(F.col("_o") < F.col(level)).select(by, F.col(level).alias("hi"), F.col("_o").alias("lo"), value, "c", F.lit(0).cast("long").alias("lc"))
    low = counts.join(other, by).where(F.col("_o") > F.col(level)).select(by, F.col("_o").alias("hi"), F.col(level).alias("lo"), value, F.lit(0).cast("long").alias("c"), F.col("c").alias("lc"))
    s = high.unionByName(low).groupBy(by, "hi", "lo", value).agg(F.sum("c").alias("c"), F.sum("lc").alias("lc"))
    before = Window.partitionBy(by, "hi", "lo").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("below", F.coalesce(F.sum("lc").over(before), F.lit(0)))
    j = s.groupBy(by).agg(F.sum(F.col("c") * (F.col("below") + 0.5 * F.col("lc"))).alias("j")).join(n, by)
    nn = F.col("nn").cast("double")
    return j.withColumn("z", (F.col("j") - (nn * nn - F.col("n2")) / 4) / F.sqrt((nn * nn * (2 * nn + 3) - F.col("n3")) / 72)).select(by, "j", "z")


def trend_draws(rows: DataFrame, key: str, level: str, value: str, by: str, draws: int, base: str = "trend", levels: int = 4) -> DataFrame:
    """(by, draw, j): J over levels 0.. with the group's values dealt anew by an md5 of (draw, key), and as they are in draw -1; ties count half."""

    def each(group: str, a: dict[str, np.ndarray], own: range) -> Iterator[tuple[int, float]]:
        at = np.argsort(a[key])
        of, keys = a[level][at], Numbers(a[key][at])
        place = np.unique(a[value][at], return_inverse=True)[1]
        for draw in own:
            dealt = place if draw < 0 else place[keys.order(f"{base}:{draw}:".encode())]
            j = 0.0
            for k in range(levels - 1):
                low = np.bincount(dealt[of == k], minlength=place.max() + 1)
                j += (np.cumsum(low) - 0.5 * low) @ np.bincount(dealt[of > k], minlength=len(low))
            yield draw, j

    def shuffled(large: DataFrame) -> DataFrame:
        lv = large.select(by, level, F.row_number().over(Window.partitionBy(by).orderBy(key)).alias("i"))
        reps = large.select(by, key, value, F.explode(F.sequence(F.lit(-1), F.lit(draws - 1))).alias("draw"))
        h = F.when(F.col("draw") < 0, "").otherwise(F.md5(F.concat_ws(":", F.lit(base), F.col("draw").cast("string"), F.col(key).cast("string"))))
        ys = reps.select(by, value, "draw", F.row_number().over(Window.partitionBy(by, "draw").orderBy(h, key)).alias("i"))
        w = Window.partitionBy(by, "draw").orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
        z = Window.partitionBy(by, "draw", value)
        below = sum((F.when(F.col(level) > k, F.sum((F.col(level) == k).cast("int")).over(w) - 0.5 * F.sum((F.col(level) == k).cast("int")).over(z)).otherwise(0.0) for k in range(levels - 1)), F.lit(0.0))
        return ys.join(lv, [by, "i"]).withColumn("below", below).groupBy(by, "draw").agg(F.sum("below").alias("j"))

    return resample.by_cell(rows, by, [key, level, value], range(-1, draws), each, "j", shuffled)


def kruskal_wallis(rows: DataFrame, level: str, value: str, *by: str) -> DataFrame:
    r = rows.withColumn("_r", avg_rank(value, *by))
    g = r.groupBy(*by, level).agg(F.sum("_r").alias("s"), F.count("*").alias("n"))
    h = g.groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("t"))
    n = F.col("n").cast("double")
    return h.withColumn("h", 12 / (n * (n + 1)) * F.col("t") - 3 * (n + 1)).select(*by, "n", "k", "h")


def binom_half(counts: DataFrame, by: str) -> DataFrame:
    """by, n, k and the two-sided exact p of k of n at even odds: the outcomes that are no likelier, each a row, are summed."""
    ways = lambda i: tails.log_factorial(F.col("n")) - tails.log_factorial(i) - tails.log_factorial(F.col("n") - i)
    e = counts.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n")))).where(ways(F.col("i")) <= ways(F.col("k")) + 1e-7)
    return e.groupBy(by, "n", "k").agg(F.least(F.lit(1.0), F.sum(F.exp(ways(F.col("i")) + F.col("n") * F.log(F.lit(0.5))))).alias("p"))


def ece_brier(rows: DataFrame, p: str, correct: str, *by: str) -> DataFrame:
    """Expected calibration error over ten equal bins, the last one closed, and the Brier score."""
    ok = F.col(correct).cast("double")
    b = rows.groupBy(*by, F.least(F.floor(F.col(p) * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(ok).alias("sc"), F.sum(F.pow(F.col(p) - ok, 2)).alias("sb"))
    return b.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.abs(F.col("sp") - F.col("sc"))) / F.sum("n")).alias("ece"), (F.sum("sb") / F.sum("n")).alias("brier"))


def rank_auc(rows: DataFrame, score: str, positive: str, *by: str) -> DataFrame:
    """Area under the curve with half for ties, from counts by distinct score."""
    pos = F.col(positive).cast("long")
    c = rows.groupBy(*by, score).agg(F.sum(pos).alias("p"), F.sum(1 - pos).alias("q"))
    c = c.withColumn("below", F.coalesce(F.sum("q").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = c.groupBy(*by).agg(F.sum(F.col("p") * (F.col("below") + 0.5 * F.col("q"))).alias("u"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    return g.where("np > 0 and nq > 0").withColumn("auc", F.col("u") / (F.col("np") * F.col("nq"))).drop("u")


def youden(rows: DataFrame, score: str, positive: str, *by: str) -> DataFrame:
    """The midpoint between distinct scores that best parts the classes (at or above is positive); ties: the lowest."""
    pos = F.col(positive).cast("long")
    c = rows.groupBy(*by, score).agg(F.sum(pos).alias("p"), F.sum(1 - pos).alias("q"))
    w, all_ = Window.partitionBy(*by).orderBy(score), Window.partitionBy(*by)
    c = c.withColumns({"cut": (F.col(score) + F.lead(score).over(w)) / 2, "fp": F.sum("q").over(all_) - F.sum("q").over(w), "tp": F.sum("p").over(all_) - F.sum("p").over(w), "np": F.sum("p").over(all_), "nq": F.sum("q").over(all_)})
    c = c.where("cut is not null and np > 0 and nq > 0").withColumn("j", F.col("tp") / F.col("np") - F.col("fp") / F.col("nq"))
    return c.groupBy(*by).agg(F.min_by(F.struct("cut", "j"), F.struct(-F.round("j", 9), F.col("cut"))).alias("b")).select(*by, "b.cut", "b.j")


def split_half(rows: DataFrame, key: str, label: str, share: float = 0.5) -> DataFrame:
    """rows with train: a deterministic share of each label, by an md5 of the key, which tells rows apart."""
    r = running(rows.withColumns({"_seed": parse.seed(F.col(key), "split"), "_one": F.lit(1)}), [label], ["_seed", key], "_one")
    return r.withColumn("train", F.col("below") + 1 <= F.floor(F.col("total") * share)).drop("_seed", "_one", "below", "total")


def confusion(rows: DataFrame, truth: str, chosen: str) -> DataFrame:
    n = rows.groupBy(truth, chosen).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(truth)))


def conformal_q(scores: DataFrame, score: str, alpha: float, *by: str) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest score, the largest where that lies beyond n."""
    return kth(scores, [*by], score, F.least(F.col("total"), F.ceil((F.col("total") + 1) * (1 - alpha))))


def mondrian_q(scores: DataFrame, score: str, alpha: float, stratum: str, least: int = 20) -> DataFrame:
    """Quantiles by stratum; the marginal one where a stratum has fewer than so many scores."""
    own = conformal_q(scores, score, alpha, stratum)
    whole = conformal_q(scores, score, alpha).select(F.col("q").alias("_q"))
    return own.join(F.broadcast(whole)).select(stratum, "n", F.when(F.col("n") >= least, F.col("q")).otherwise(F.col("_q")).alias("q"), (F.col("n") < least).alias("marginal"))
