"""The model bank by grid profiling: for each candidate of the shape parameters a curve's best base and amplitude are sums over its points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Models in bank order, and how many parameters each has.
MODELS = {"lnt": 2, "logistic": 4, "gompertz": 4, "exponential": 3, "scaling": 3, "finke_watzky": 4, "richards": 5, "brain_cousens": 5}
DOSE_MODELS = {"dr_lnt": 2, "dr_threshold": 3, "dr_hill": 4, "dr_brain_cousens": 5, "dr_scaling": 3}
CANDIDATES = {"monotonic_fit": ["lnt", "logistic", "gompertz", "richards", "exponential", "scaling", "finke_watzky"], "nonmonotonic_fit": ["lnt", "brain_cousens", "logistic"], "descriptive_only": ["lnt"], "reject": []}


def clipped_exp(x: Column) -> Column:
    return F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), x)))


def basis(model: Column, p1: Column, p2: Column, p3: Column, x: Column) -> Column:
    """The model's shape at relative time x in 0..1, to be scaled by amp and shifted by base."""
    z = clipped_exp(-p1 * (x - p2))
    k = p1 + p2
    e = clipped_exp(k * x)
    return (
        F.when(model == "lnt", x)
        .when(model == "logistic", 1 / (1 + z))
        .when(model == "gompertz", clipped_exp(-z))
        .when(model == "richards", 1 / F.pow(1 + p3 * z, 1 / p3))
        .when(model == "exponential", 1 - clipped_exp(-p1 * x))
        .when(model == "scaling", F.pow(F.greatest(x, F.lit(1e-9)), p1))
        .when(model == "finke_watzky", p1 * (e - 1) / (p1 * e + p2))
        .when(model.isin("brain_cousens", "dr_brain_cousens"), 1 / (1 + clipped_exp(p1 * (F.log(F.greatest(x, F.lit(1e-9))) - F.log(p2)))))
        .when(model == "dr_lnt", x)
        .when(model == "dr_threshold", F.greatest(x - p1, F.lit(0.0)))
        .when(model == "dr_hill", 1 / (1 + F.pow(p1 / F.greatest(x, F.lit(1e-9)), p2)))
        .when(model == "dr_scaling", F.pow(F.greatest(x, F.lit(1e-9)), p1))
    )


def second(model: Column, g: Column, x: Column) -> Column:
    """The shape of the third linear term, which one model has: its rise with x."""
    return F.when(model.isin("brain_cousens", "dr_brain_cousens"), x * g).otherwise(0.0)


#: Models whose amplitude must be in 0..3 times the range of y.
BOUNDED = ["logistic", "gompertz", "richards", "exponential", "finke_watzky"]


def candidates() -> list[tuple[str, int, float, float, float]]:
    """Shape parameters to try, for time scaled to 0..1: some 150 rows, whatever the data."""
    log = lambda lo, hi, n: [round(lo * (hi / lo) ** (i / (n - 1)), 6) for i in range(n)]
    mid = [0.1, 0.25, 0.4, 0.55, 0.7, 0.85, 1.0, 1.25]
    rows = [("lnt", 0.0, 0.0, 1.0)]
    rows += [(m, k, t0, 1.0) for m in ("logistic", "gompertz") for k in log(2, 128, 7) for t0 in mid]
    rows += [("richards", k, t0, nu) for k in log(4, 64, 3) for t0 in (0.25, 0.5, 0.75) for nu in (0.25, 0.5, 2.0, 4.0)]
    rows += [("exponential", k, 0.0, 1.0) for k in log(0.5, 16, 6)]
    rows += [("scaling", n, 0.0, 1.0) for n in (-5.0, -2.0, -1.0, -0.5, 0.25, 0.5, 0.75, 1.5, 2.0, 3.0, 5.0)]
    rows += [("finke_watzky", a, b, 1.0) for a in (0.001, 0.01, 0.1) for b in (4.0, 8.0, 16.0)]
    rows += [("brain_cousens", b, e, 1.0) for b in (2.0, 4.0, 8.0) for e in (0.3, 0.6, 0.9)]
    return [(m, i, float(a), float(b), float(c)) for i, (m, a, b, c) in enumerate(rows)]


def dose_candidates() -> list[tuple[str, int, float, float, float]]:
    """Shape parameters of the dose models, for doses scaled to 0..1 by the largest."""
    share = [0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9]
    rows = [("dr_lnt", 0.0, 0.0)] + [("dr_threshold", a, 0.0) for a in share] + [("dr_hill", a, h) for a in share for h in (0.5, 1.0, 2.0, 4.0, 8.0)]
    rows += [("dr_brain_cousens", b, e) for b in (2.0, 4.0, 8.0) for e in (0.3, 0.6, 0.9)] + [("dr_scaling", n, 0.0) for n in (-1.0, -0.5, 0.25, 0.5, 1.5, 2.0, 3.0)]
    return [(m, i, float(a), float(b), 1.0) for i, (m, a, b) in enumerate(rows)]


def grid(spark: SparkSession, dose: bool = False) -> DataFrame:
    return spark.createDataFrame(dose_candidates() if dose else candidates(), "model string, candidate int, p1 double, p2 double, p3 double")


def profiles(points: DataFrame, cands: DataFrame, keys: list[str]) -> DataFrame:
    """Every candidate's best base, amp and tilt, with its SSE; points has keys, x in 0..1 and y.

    Each point meets the broadcast candidates in one generated loop and is summed
    at once, so what is shuffled are sums, one row a curve and candidate and task.
    y is taken from its curve's mean, so sums don't cancel.
    """
    w = Window.partitionBy(*keys)
    g = basis(F.col("model"), F.col("p1"), F.col("p2"), F.col("p3"), F.col("x"))
    rows = points.select(*keys, "x", (F.col("y") - F.avg("y").over(w)).alias("y"), F.avg("y").over(w).alias("mean"), (F.max("y").over(w) - F.min("y").over(w)).alias("range"))
    rows = rows.join(F.broadcast(cands)).withColumn("g", g)
    rows = rows.withColumn("h", second(F.col("model"), F.col("g"), F.col("x")))
    total = lambda a, b=None: F.sum(F.col(a) * F.col(b) if b else F.col(a)).alias(a + (b or ""))
    s = rows.groupBy(*keys, "model", "candidate").agg(F.count("*").cast("double").alias("n"), F.first("mean").alias("mean"), F.first("range").alias("range"), total("g"), total("h"), total("y"), total("g", "g"), total("g", "h"), total("h", "h"), total("g", "y"), total("h", "y"), total("y", "y"))
    n = F.col("n")
    mid = lambda a, b: (F.col(a + b) - F.col(a) * F.col(b) / n).alias("s" + a + b)
    s = s.select(*keys, "model", "candidate", "n", "mean", "range", (F.col("g") / n).alias("gbar"), (F.col("h") / n).alias("hbar"), (F.col("y") / n).alias("ybar"), mid("g", "g"), mid("g", "h"), mid("h", "h"), mid("g", "y"), mid("h", "y"), mid("y", "y"))
    det = F.col("sgg") * F.col("shh") - F.col("sgh") * F.col("sgh")
    two = F.col("model").isin("brain_cousens", "dr_brain_cousens") & (det > 1e-9)
    one = F.when(F.col("sgg") > 1e-9, F.col("sgy") / F.col("sgg")).otherwise(0.0)
    amp = F.when(two, (F.col("sgy") * F.col("shh") - F.col("shy") * F.col("sgh")) / det).when(F.col("model").isin(BOUNDED), F.greatest(F.lit(0.0), F.least(3 * F.col("range"), one))).otherwise(one)
    s = s.withColumns({"amp": amp, "tilt": F.when(two, (F.col("shy") * F.col("sgg") - F.col("sgy") * F.col("sgh")) / det).otherwise(0.0)})
    a, f = F.col("amp"), F.col("tilt")
    sse = F.col("syy") - 2 * a * F.col("sgy") - 2 * f * F.col("shy") + a * a * F.col("sgg") + 2 * a * f * F.col("sgh") + f * f * F.col("shh")
    return s.select(*keys, "model", "candidate", "n", "amp", "tilt", (F.col("mean") + F.col("ybar") - a * F.col("gbar") - f * F.col("hbar")).alias("base"), F.round(F.greatest(F.lit(0.0), sse), 6).alias("sse"), F.col("syy").alias("sst"), "gbar", "sgg")


def fit_draws(points: DataFrame, cands: DataFrame, near: DataFrame, draws: int) -> DataFrame:
    """fits(curve_id, draw, model, candidate, base, amp, tilt, sse, n, sst): as fit(), of each draw's y, for each curve's models in near.

    points has curve_id, x and ys, one y a draw. Shapes and their sums don't
    depend on y, so a point meets a candidate once and not once a draw, and only
    candidates of models that are asked for. y is taken from its mean in a draw,
    so its sum is 0, and the sum of its squares is the curve's.
    """
    c = F.col
    at = range(draws)
    y = [c("ys")[d] for d in at]
    curve = points.groupBy("curve_id").agg(F.array(*[F.avg(v) for v in y]).alias("mean"), F.array(*[F.max(v) - F.min(v) for v in y]).alias("range"), F.array(*[F.var_pop(v) * F.count("*") for v in y]).alias("syy"))
    asked = near.groupBy("curve_id").agg(F.collect_set("model").alias("models"))
    rows = points.join(curve.hint("merge"), "curve_id").join(asked.hint("merge"), "curve_id")
    rows = rows.select("curve_id", "x", *[(v - c("mean")[d]).alias(f"y{d}") for d, v in zip(at, y)], "mean", "range", F.explode("models").alias("model"))
    rows = rows.join(F.broadcast(cands), "model").withColumn("g", basis(c("model"), c("p1"), c("p2"), c("p3"), c("x")))
    rows = rows.withColumn("h", second(c("model"), c("g"), c("x")))
    own = [F.sum(e).alias(k) for k, e in {"g": c("g"), "h": c("h"), "gg": c("g") * c("g"), "gh": c("g") * c("h"), "hh": c("h") * c("h")}.items()]
    by = [F.sum(c(k) * c(f"y{d}")).alias(f"s{k}y{d}") for k in ("g", "h") for d in at]
    s = rows.groupBy("curve_id", "model", "candidate").agg(F.count("*").cast("double").alias("n"), *own, *by)
    z = F.array(*[F.struct(c(f"sgy{d}").alias("sgy"), c(f"shy{d}").alias("shy")) for d in at])
    n = c("n")
    mid = lambda a, b: c(a + b) - c(a) * c(b) / n
    s = s.select("curve_id", "model", "candidate", "n", (c("g") / n).alias("gbar"), (c("h") / n).alias("hbar"), mid("g", "g").alias("sgg"), mid("g", "h").alias("sgh"), mid("h", "h").alias("shh"), z.alias("z"))
    s = s.join(curve.hint("merge"), "curve_id")
    det = c("sgg") * c("shh") - c("sgh") * c("sgh")
    two = c("model").isin("brain_cousens", "dr_brain_cousens") & (det > 1e-9)

    def terms(v: Column, range_: Column) -> Column:
        one = F.when(c("sgg") > 1e-9, v["sgy"] / c("sgg")).otherwise(0.0)
        amp = F.when(two, (v["sgy"] * c("shh") - v["shy"] * c("sgh")) / det).when(c("model").isin(BOUNDED), F.greatest(F.lit(0.0), F.least(3 * range_, one))).otherwise(one)
        tilt = F.when(two, (v["shy"] * c("sgg") - v["sgy"] * c("sgh")) / det).otherwise(0.0)
        return F.struct(amp.alias("a"), tilt.alias("f"), v["sgy"].alias("sgy"), v["shy"].alias("shy"))

    def solved(v: Column, y: Column) -> Column:
        a, f = v["a"], v["f"]
        sse = y["syy"] - 2 * a * v["sgy"] - 2 * f * v["shy"] + a * a * c("sgg") + 2 * a * f * c("sgh") + f * f * c("shh")
        return F.struct(F.round(F.greatest(F.lit(0.0), sse), 6).alias("sse"), c("candidate"), (y["mean"] - a * c("gbar") - f * c("hbar")).alias("base"), a.alias("amp"), f.alias("tilt"), n.alias("n"), y["syy"].alias("sst"))

    s = s.withColumn("z", F.zip_with("z", "range", terms)).withColumn("z", F.zip_with("z", F.arrays_zip("mean", "syy"), solved))
    best = s.groupBy("curve_id", "model").agg(F.array(*[F.min(c("z")[d]) for d in at]).alias("z"))
    return best.select("curve_id", "model", F.posexplode("z").alias("draw", "b")).select("curve_id", "draw", "model", "b.*")


FIELDS = ["candidate", "base", "amp", "tilt", "sse", "n", "sst", "gbar", "sgg"]


def fit(points: DataFrame, cands: DataFrame, keys: list[str] = ["curve_id"]) -> DataFrame:  # noqa: B006
    """fits(curve_id, model, candidate, base, amp, tilt, sse, n, sst, ...): the best candidate of each model."""
    best = profiles(points, cands, keys).groupBy(*keys, "model").agg(F.min_by(F.struct(*FIELDS), F.struct("sse", "candidate")).alias("b"))
    return best.select(*keys, "model", "b.*")


def linear_errors(fits: DataFrame) -> DataFrame:
    """Standard errors of base and amp of two-term models, from the same sums; null without degrees of freedom."""
    s2 = F.when(F.col("n") > F.col("p"), F.col("sse") / (F.col("n") - F.col("p")))
    ok = (F.col("model") != "brain_cousens") & (F.col("sgg") > 1e-9)
    return fits.withColumns({"se_amp": F.when(ok, F.sqrt(s2 / F.col("sgg"))), "se_base": F.when(ok, F.sqrt(s2 * (1 / F.col("n") + F.col("gbar") * F.col("gbar") / F.col("sgg"))))})


def predict(fits: DataFrame, cands: DataFrame, at: DataFrame, x: str = "x", times: Column | None = None) -> DataFrame:
    """at (curve_id, x, ...) with the fitted value of its curve's fit as ``v``.

    times gives each row of at more rows, one for each of its values of x. They
    are made behind the join, as Spark takes a table for as large as it was before
    an explode, and would broadcast it. Fits are as many as curves and are merged.
    """
    f = fits.join(F.broadcast(cands), ["model", "candidate"])
    rows = at.join(f.select("curve_id", "model", "p1", "p2", "p3", "base", "amp", "tilt").hint("merge"), "curve_id")
    if times is not None:
        rows = rows.select("*", F.posexplode(times).alias("i", x))
    g = basis(F.col("model"), F.col("p1"), F.col("p2"), F.col("p3"), F.col(x))
    rows = rows.withColumn("_g", g)
    return rows.withColumn("v", F.col("base") + F.col("amp") * F.col("_g") + F.col("tilt") * second(F.col("model"), F.col("_g"), F.col(x))).drop("_g", "p1", "p2", "p3", "base", "amp", "tilt")


def metrics(fits: DataFrame) -> DataFrame:
    """R2, log-likelihood, AIC, AICc (null when n <= p + 1) and BIC."""
    p = F.lit(None).cast("double")
    for m, k in {**MODELS, **DOSE_MODELS}.items():
        p = F.when(F.col("model") == m, float(k)).otherwise(p)
    n = F.col("n")
    ll = -0.5 * n * (math.log(2 * math.pi) + F.log(F.greatest(F.col("sse") / n, F.lit(1e-12))) + 1)
    out = fits.withColumn("p", p).withColumn("loglik", ll).withColumn("r2", 1 - F.col("sse") / F.greatest(F.col("sst"), F.lit(1e-12)))
    out = out.withColumn("aic", 2 * F.col("p") - 2 * F.col("loglik"))
    return out.withColumns({"aicc": F.when(n - F.col("p") - 1 > 0, F.col("aic") + 2 * F.col("p") * (F.col("p") + 1) / (n - F.col("p") - 1)), "bic": F.col("p") * F.log(n) - 2 * F.col("loglik")})


def licensed(verdicts: DataFrame) -> DataFrame:
    """(curve_id, model, too_few_points): the models that a curve's handling allows."""
    spark = verdicts.sparkSession
    rows = spark.createDataFrame([(h, m, MODELS[m]) for h, ms in CANDIDATES.items() for m in ms], "handling string, model string, n_params int")
    return verdicts.join(F.broadcast(rows), "handling").select("curve_id", "model", (F.col("n_points") <= F.col("n_params")).alias("too_few_points"))


def bank_order(model: Column) -> Column:
    out = F.lit(99)
    for i, m in enumerate(MODELS):
        out = F.when(model == m, i).otherwise(out)
    return out


def best_by_aicc(fits: DataFrame) -> DataFrame:
    rows = fits.where("aicc is not null")
    return rows.groupBy("curve_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "curve_id"]), F.struct(F.round("aicc", 6), bank_order(F.col("model")))).alias("b")).select("curve_id", "b.*")


def akaike_weights(fits: DataFrame) -> DataFrame:
    w = Window.partitionBy("curve_id")
    rel = fits.where("aicc is not null").withColumn("delta", F.col("aicc") - F.min("aicc").over(w)).withColumn("rel", F.exp(-0.5 * F.col("delta")))
    return rel.withColumn("weight", F.col("rel") / F.sum("rel").over(w)).drop("rel")


def compare_models(fits: DataFrame) -> DataFrame:
    """All models of a curve ranked by AICc, with the distance to the best and the family."""
    w = Window.partitionBy("curve_id").orderBy(F.round("aicc", 6), bank_order(F.col("model")))
    return akaike_weights(fits).withColumns({"rank": F.row_number().over(w), "family": F.when(F.col("model") == "finke_watzky", "mechanistic").otherwise("descriptive")})


def scaled(points: DataFrame) -> DataFrame:
    """(curve_id, x, y, t): time as a share of the curve's window."""
    w = Window.partitionBy("curve_id")
    lo, hi = F.min("t").over(w), F.max("t").over(w)
    return points.select("curve_id", "t", "y", F.when(hi > lo, (F.col("t") - lo) / (hi - lo)).otherwise(0.0).alias("x"))


def first_crossing(points: DataFrame, share: float, x: str = "x", y: str = "y") -> DataFrame:
    """(curve_id, at): where y first crosses min + share * (max - min), between points by a straight line."""
    w, whole = Window.partitionBy("curve_id").orderBy(x), Window.partitionBy("curve_id")
    p = points.select("curve_id", x, y, F.lead(x).over(w).alias("nx"), F.lead(y).over(w).alias("ny"), (F.min(y).over(whole) + share * (F.max(y).over(whole) - F.min(y).over(whole))).alias("goal"))
    a, b = F.col(y) - F.col("goal"), F.col("ny") - F.col("goal")
    at = F.when(a == 0, F.col(x)).when(a * b < 0, F.col(x) + (F.col("goal") - F.col(y)) / (F.col("ny") - F.col(y)) * (F.col("nx") - F.col(x)))
    return p.where("nx is not null").select("curve_id", F.col(x).alias("_x"), at.alias("at")).where("at is not null").groupBy("curve_id").agg(F.min_by("at", "_x").alias("at"))
