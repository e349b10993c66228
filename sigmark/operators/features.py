"""Features of fitted curves: dense evaluation, crossings, inflection, lag, width, what censoring lets them mean."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bank, regimes, triage
from .graph import cut

#: Points of the dense grid, how much steeper than its edges an inflection must be, and the least that counts as a rise.
GRID, STEEPER, EPS = 600, 1.15, 1e-9
#: Shares of the rise whose times are told, and curves that are looked at together.
CROSSINGS, SOME = {"t10": 0.1, "t50": 0.5, "t90": 0.9}, 512


def spans(points: DataFrame) -> DataFrame:
    """(curve_id, lo, hi, n_points): the window of each curve in hours."""
    return points.groupBy("curve_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n_points"))


def densify(winners: DataFrame, cands: DataFrame, windows: DataFrame, n: int = GRID) -> DataFrame:
    """(curve_id, i, t, v): the selected model at n even times of the curve's window."""
    rows = bank.predict(winners, cands, windows, times=F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i / (n - 1)))
    return rows.select("curve_id", "i", (F.col("lo") + F.col("x") * (F.col("hi") - F.col("lo"))).alias("t"), "v")


def gradient(dense: DataFrame) -> DataFrame:
    """dense with slope: central differences, one-sided at the ends."""
    w = Window.partitionBy("curve_id").orderBy("i")
    before, after = (lambda c: F.coalesce(F.lag(c).over(w), F.col(c))), (lambda c: F.coalesce(F.lead(c).over(w), F.col(c)))
    step = after("t") - before("t")
    return dense.withColumn("slope", F.when(step > 0, (after("v") - before("v")) / step).otherwise(0.0))


def inflection(dense: DataFrame) -> DataFrame:
    """One row a curve: the first steepest point, and whether it is inside and clearly steeper than both ends."""
    g = gradient(dense)
    first = lambda c: F.min_by(c, "i")
    last = lambda c: F.max_by(c, "i")
    s = g.groupBy("curve_id").agg(
        F.max_by(F.struct("i", "t", "v", "slope"), F.struct(F.round("slope", 9), -F.col("i"))).alias("top"),
        first("slope").alias("s0"), last("slope").alias("s1"), F.max("i").alias("end"), F.min("v").alias("vmin"), F.max("v").alias("vmax"), F.min("t").alias("lo"), F.max("t").alias("hi"),
    )
    edge = F.greatest("s0", "s1", F.lit(EPS))
    inside = (F.col("top.i") > 0) & (F.col("top.i") < F.col("end")) & (F.col("top.slope") > STEEPER * edge)
    return s.select("curve_id", "lo", "hi", "vmin", "vmax", F.col("top.t").alias("steepest_t"), F.col("top.v").alias("steepest_v"), F.col("top.slope").alias("max_rate"), inside.alias("inflection"))


def _marks(t: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    """inflection() and the first crossings of curves, one a row, whose values at times t are v."""
    after, before = (np.concatenate((x[:, 1:], x[:, -1:]), 1) for x in (t, v)), (np.concatenate((x[:, :1], x[:, :-1]), 1) for x in (t, v))
    (nt, nv), (pt, pv) = after, before
    slope = np.divide(nv - pv, nt - pt, out=np.zeros_like(v), where=nt > pt)
    top = np.argmax(np.copysign(np.floor(np.abs(slope) * 1e9 + 0.5), slope), 1)
    own = np.arange(len(v))
    low, high, rate = v.min(1), v.max(1), slope[own, top]
    inside = (top > 0) & (top < v.shape[1] - 1) & (rate > STEEPER * np.maximum(np.maximum(slope[:, 0], slope[:, -1]), EPS))
    out = {"lo": t.min(1), "hi": t.max(1), "vmin": low, "vmax": high, "steepest_t": t[own, top], "steepest_v": v[own, top], "max_rate": rate, "inflection": inside}
    for name, share in CROSSINGS.items():
        goal = low + share * (high - low)
        a, b = v[:, :-1] - goal[:, None], v[:, 1:] - goal[:, None]
        hit = (a == 0) | (a * b < 0)
        i = np.argmax(hit, 1)
        x, y, y2 = t[own, i], v[own, i], v[own, i + 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            at = np.where(a[own, i] == 0, x, x + (goal - y) / (y2 - y) * (t[own, i + 1] - x))
        out[name] = np.ma.masked_array(at, ~hit.any(1))
    return out


def marks(winners: DataFrame, cands: DataFrame, windows: DataFrame, n: int = GRID) -> DataFrame:
    """One row a curve, of the selected model at n even times of its window: what inflection() tells, and t10, t50 and t90.

    A curve's values are one list in its row, so nothing is shuffled or sorted n times.
    """
    c = F.col
    f = winners.join(F.broadcast(cands), ["model", "candidate"]).select("curve_id", "model", "p1", "p2", "p3", "base", "amp", "tilt")
    rows = windows.select("curve_id", "lo", "hi").join(f.hint("merge"), "curve_id")

    def value(i: Column) -> Column:
        x = i / (n - 1)
        g = bank.basis(c("model"), c("p1"), c("p2"), c("p3"), x)
        return c("base") + c("amp") * g + c("tilt") * bank.second(c("model"), g, x)

    rows = rows.select("curve_id", "lo", "hi", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), value).alias("v"))
    share = np.arange(n) / (n - 1)
    kind = {x: "boolean" if x == "inflection" else "double" for x in ("lo", "hi", "vmin", "vmax", "steepest_t", "steepest_v", "max_rate", "inflection", *CROSSINGS)}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, SOME):
                b = whole.slice(k, SOME)
                lo, hi = (np.asarray(b.column(x))[:, None] for x in ("lo", "hi"))
                got = _marks(lo + share * (hi - lo), np.asarray(b.column("v").flatten()).reshape(b.num_rows, n))
                cols = [pa.array(np.ma.getdata(got[x]), mask=np.ma.getmaskarray(got[x])) for x in kind]
                yield pa.RecordBatch.from_arrays([b.column("curve_id"), *cols], names=["curve_id", *kind])

    return rows.mapInArrow(each, f"curve_id {rows.schema['curve_id'].dataType.simpleString()}, " + ", ".join(f"{x} {y}" for x, y in kind.items()))


def vector(marks: DataFrame) -> DataFrame:
    """The feature vector of each curve whose fit rises at all; lag and inflection are null without an inflection inside."""
    c = F.col
    out = marks.where(c("vmax") - c("vmin") >= EPS)
    range_, width = c("vmax") - c("vmin"), c("t90") - c("t10")
    lag = F.when(c("inflection") & (c("max_rate") > EPS), c("steepest_t") - (c("steepest_v") - c("vmin")) / c("max_rate"))
    out = out.withColumns({"dynamic_range": range_, "width": width, "lag": lag, "inflection_t": F.when(c("inflection"), c("steepest_t"))})
    span = F.when(c("hi") > c("lo"), c("hi") - c("lo")).otherwise(1.0)
    return out.withColumns({"lag_ratio": F.when(c("t50") > EPS, c("lag") / c("t50")), "sharpness": F.when(c("width") > EPS, c("t50") / c("width")), "max_rate_normalized": c("max_rate") * span / c("dynamic_range"), "plateau": c("vmax")})


def status(features: DataFrame, verdicts: DataFrame) -> DataFrame:
    """features with what censoring lets them mean; verdicts has censoring and plateau_reached."""
    c = F.col
    rows = features.join(verdicts.select("curve_id", "censoring", "plateau_reached", "handling", "flat"), "curve_id")
    right, left = c("censoring").isin("right", "left_right"), c("censoring").isin("left", "left_right")
    gone = lambda x: F.when(~left, c(x))
    flags = F.filter(F.array(F.when(~c("plateau_reached"), "plateau_not_reached_extrapolated"), F.when(c("lag") < 0, "lag_nonpositive_no_lag_phase"), F.when(~c("inflection"), "non_cooperative_no_interior_inflection")), lambda x: x.isNotNull())
    return rows.withColumns({
        "t50_status": F.when(right, "lower_bound").when(left, "biased_early").when(c("censoring") == "interval", "irregular").otherwise("point"),
        "lag_status": F.when(left, "undefined_left_censored").when(~c("inflection"), "undefined_non_cooperative").otherwise("point"),
        "flags": flags,
    }).withColumns({x: gone(x) for x in ("lag", "lag_ratio", "inflection_t")})


def shaped(winners: DataFrame, features: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row a curve for regimes.classify: status, flat, non_monotonic, inflection, sharpness, lag_ratio."""
    c = F.col
    f = features.select("curve_id", "inflection", "sharpness", "lag_ratio", F.lit(True).alias("_moves"))
    rows = verdicts.select("curve_id", "handling", "flat").join(winners.select("curve_id", F.lit(True).alias("_fit")), "curve_id", "left").join(f, "curve_id", "left")
    return rows.select("curve_id", F.when(c("_fit").isNull(), "no_fit").otherwise("ok").alias("status"), (c("flat") | c("_moves").isNull()).alias("flat"), (c("handling") == "nonmonotonic_fit").alias("non_monotonic"), "inflection", "sharpness", "lag_ratio")


def quantiles(values: Column, low: float = 0.025, high: float = 0.975) -> Column:
    return F.percentile(values, F.array(F.lit(low), F.lit(0.5), F.lit(high)))


def analysis(points: DataFrame) -> DataFrame:
    """What is known of each curve of points (curve_id, t, y): triage, the selected model, half-time and regime.

    Curves that triage rejects, or that no model fits, keep nulls and their regime.
    """
    cands, points = bank.grid(points.sparkSession), bank.scaled(points)
    winners = cut(bank.best_by_aicc(bank.metrics(bank.fit(points.select("curve_id", "x", "y"), cands))), "winners")
    verdicts = cut(triage.triage(triage.features(points.select("curve_id", "t", "y"))), "verdicts")
    found = vector(cut(marks(winners, cands, spans(points)), "marks"))
    regime = regimes.classify(shaped(winners, found, verdicts)).select("curve_id", "regime")
    out = verdicts.select("curve_id", "n_points", "fittability", "censoring", "handling").join(regime, "curve_id")
    return out.join(winners.select("curve_id", "model"), "curve_id", "left").join(found.select("curve_id", "t50"), "curve_id", "left")
