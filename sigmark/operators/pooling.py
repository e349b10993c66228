"""Partial pooling and cross-study meta-analysis: weighted sums by group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from .graph import cut, small
from .selection import quantile

LEAST = 3
#: Newton steps; ratio of neighbouring places that sums over the others are expanded about, and terms: 0.118^17 is left out, below a double's precision.
STEPS, RATIO, TERMS = 10, 1.25, 17
#: Nothing reads it any more; callers may still set it.
BLOCK = 1024


def told(groups: DataFrame, name: str) -> DataFrame:
    """What is known of groups, as a table to join their members with: of few groups, members are neither shuffled nor sorted by them."""
    return small(cut(groups, name))


def moments(units: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: k, and sums of w, w theta, w theta^2, w^2 with w = 1 / s2; one pass, combined before the shuffle."""
    w = 1 / F.greatest(F.col("s2"), F.lit(1e-12))
    return units.groupBy(*keys).agg(F.count("*").alias("k"), F.sum(w).alias("sw"), F.sum(w * F.col("theta")).alias("swt"), F.sum(w * F.col("theta") * F.col("theta")).alias("swtt"), F.sum(w * w).alias("sww"))


def dersimonian_laird(units: DataFrame, keys: list[str]) -> DataFrame:
    """mu, tau2, q, se of each group of (theta, s2): moment estimate, then one pass with tau2 in the weights."""
    m = moments(units, keys)
    c = F.col("sw") - F.col("sww") / F.col("sw")
    q = F.greatest(F.lit(0.0), F.col("swtt") - F.col("swt") * F.col("swt") / F.col("sw"))
    m = m.withColumn("q", F.when(F.col("k") > 1, q).otherwise(0.0)).withColumn("tau2", F.when((F.col("k") > 1) & (c > 1e-9), F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / c)).otherwise(0.0))
    again = units.join(m.select(*keys, "tau2", "q", "k"), keys)
    w = 1 / (F.greatest(F.col("s2"), F.lit(1e-12)) + F.col("tau2"))
    return again.groupBy(*keys).agg(F.first("k").alias("k"), F.first("q").alias("q"), F.first("tau2").alias("tau2"), (F.sum(w * F.col("theta")) / F.sum(w)).alias("mu"), F.sqrt(1 / F.sum(w)).alias("se"))


def i_squared(q: Column, k: Column) -> Column:
    return F.when((k > 1) & (q > 0), F.greatest(F.lit(0.0), (q - (k - 1)) / q)).otherwise(0.0)


def shrink(units: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Each unit moved to its group's mean by weight tau2 / (tau2 + s2); groups of fewer than three are left alone."""
    u = units.join(groups.select(*keys, "k", "mu", "tau2"), keys)
    s2 = F.greatest(F.col("s2"), F.lit(1e-12))
    w = F.when(F.col("k") < LEAST, 1.0).otherwise(F.col("tau2") / (F.col("tau2") + s2))
    return u.withColumn("weight", w).withColumns({"pooled": F.col("weight") * F.col("theta") + (1 - F.col("weight")) * F.col("mu"), "posterior_sd": F.sqrt(F.col("weight") * s2), "pooled_here": F.col("k") >= LEAST})


def heterogeneity(groups: DataFrame) -> DataFrame:
    df = (F.col("k") - 1).cast("double")
    return groups.where("k > 1").withColumns({"p": F.when(F.col("q") > 0, tails.chi2_sf(F.col("q"), df)).otherwise(1.0), "i2": i_squared(F.col("q"), F.col("k")), "h2": F.col("q") / df})


def study_effects(units: DataFrame, keys: list[str], **more: Column) -> DataFrame:
    """One effect a study: the inverse-variance mean of its units, with s2 = 1 / sum of weights, and more aggregates of its units."""
    w = 1 / F.col("s2")
    return units.groupBy(*keys, "study").agg((F.sum(w * F.col("theta")) / F.sum(w)).alias("theta"), (1 / F.sum(w)).alias("s2"), F.count("*").alias("n_units"), *[c.alias(k) for k, c in more.items()])


def paule_mandel(studies: DataFrame, keys: list[str], steps: int = STEPS) -> DataFrame:
    """k and tau2 by so many Newton steps on sum of w (theta - mu)^2 = k - 1 from the moment estimate, each a pass of grouped sums over the studies, after which its results are a table."""
    s2, th = F.greatest(F.col("s2"), F.lit(1e-12)), F.col("theta")
    at = dersimonian_laird(studies, keys).select(*keys, "k", "tau2", F.col("mu").alias("about"))
    for _ in range(steps):
        w, d = 1 / (s2 + F.col("tau2")), th - F.col("about")
        g = studies.join(told(at, "step"), keys).groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("k", "tau2", "about")], F.sum(w).alias("w"), F.sum(w * d).alias("wd"), F.sum(w * d * d).alias("wdd"), F.sum(w * w).alias("ww"), F.sum(w * w * d).alias("wwd"), F.sum(w * w * d * d).alias("wwdd"))
        m = F.col("wd") / F.col("w")
        q, slope = F.col("wdd") - m * F.col("wd"), F.col("wwdd") - 2 * m * F.col("wwd") + m * m * F.col("ww")
        step = F.when((F.col("k") > 1) & (slope > 1e-30), F.greatest(F.lit(0.0), F.col("tau2") + (q - (F.col("k") - 1)) / slope)).otherwise(F.lit(0.0))
        at = g.select(*keys, "k", step.alias("tau2"), "about")
    return at.select(*keys, "k", "tau2")


def random_effects(studies: DataFrame, keys: list[str]) -> DataFrame:
    """k, q, tau2 (Paule-Mandel), mu and se of each group of studies."""
    q = dersimonian_laird(studies, keys).select(*keys, "q")
    j = studies.join(told(paule_mandel(studies, keys), "between"), keys)
    w = 1 / (F.greatest(F.col("s2"), F.lit(1e-12)) + F.col("tau2"))
    g = j.groupBy(*keys).agg(F.first("k").alias("k"), F.first("tau2").alias("tau2"), (F.sum(w * F.col("theta")) / F.sum(w)).alias("mu"), F.sqrt(1 / F.sum(w)).alias("se"))
    return g.join(q, keys)


def others_mean(own: DataFrame, studies: DataFrame, keys: list[str]) -> DataFrame:
    """own (a row a study, with tau2_without) and mu_without: the mean of the group's other studies by weights 1 / (s2 + tau2_without).

    As a function of tau2 the group's sums are power series about the nearest of a
    geometric row of places, so they come from a few sums of powers for each place
    that is used.  The most precise study is kept out of them and added by itself:
    any other has at most half of the weight, and can be taken off again.
    """
    s2, th = F.greatest(F.col("s2"), F.lit(1e-12)), F.col("theta")
    lead = studies.groupBy(*keys).agg(F.min(s2).alias("_least"), F.min_by(F.struct("study", s2.alias("s2"), "theta"), F.struct(s2, "study")).alias("_lead"))
    lead = told(lead, "lead")
    place = F.round(F.log((F.col("tau2_without") + F.col("_least")) / F.col("_least")) / math.log(RATIO)).cast("int")
    own = own.join(lead, keys).withColumn("_place", place)
    used = own.groupBy(*keys).agg(F.collect_set("_place").alias("_places"))
    about = F.col("_least") * F.pow(F.lit(RATIO), F.col("_place"))
    rest = studies.join(lead, keys).where(F.col("study") != F.col("_lead.study")).join(told(used, "places"), keys).withColumn("_place", F.explode("_places"))
    rest = rest.withColumn("_u", about / (s2 - F.col("_least") + about))
    u = F.col("_u")
    power = lambda p: u if p == 0 else F.pow(u, F.lit(p + 1.0))
    g = rest.groupBy(*keys, "_place").agg(*[F.sum(power(p)).alias(f"_w{p}") for p in range(TERMS)], *[F.sum(th * power(p)).alias(f"_t{p}") for p in range(TERMS)])
    own = own.join(told(g, "powers"), [*keys, "_place"], "left")
    x = -(F.col("tau2_without") + F.col("_least") - about) / about

    def series(name: str) -> Column:
        out = F.lit(0.0)
        for p in reversed(range(TERMS)):
            out = out * x + F.coalesce(F.col(f"_{name}{p}"), F.lit(0.0))
        return out / about

    first = F.col("study") == F.col("_lead.study")
    a, b = 1 / (F.col("_lead.s2") + F.col("tau2_without")), 1 / (s2 + F.col("tau2_without"))
    weight = series("w") + F.when(first, 0.0).otherwise(a - b)
    value = series("t") + F.when(first, 0.0).otherwise(a * F.col("_lead.theta") - b * th)
    return own.withColumn("mu_without", value / weight).drop("_least", "_lead", "_place", *[f"_{n}{p}" for n in "wt" for p in range(TERMS)])


def leave_one_out(studies: DataFrame, keys: list[str], whole: DataFrame) -> DataFrame:
    """Each study with what its group gives without it: tau2 and I2 from the group's sums less its own terms, the random-effects mean with that tau2, its distance from the group's (whole), and whether it stands out.

    The mean needs a sum over the others for each study, since tau2 differs: see others_mean.
    """
    s2 = F.greatest(F.col("s2"), F.lit(1e-12))
    sums = moments(studies, keys).withColumnRenamed("k", "n_studies")
    w, th = 1 / s2, F.col("theta")
    own = studies.join(told(sums, "sums"), keys).where("n_studies > 1").join(told(whole.select(*keys, "mu", "tau2"), "whole"), keys)
    left = {"k": F.col("n_studies") - 1, "rw": F.col("sw") - w, "rwt": F.col("swt") - w * th, "rwtt": F.col("swtt") - w * th * th, "rww": F.col("sww") - w * w}
    own = own.withColumns(left).withColumn("q_without", F.when(F.col("k") > 1, F.greatest(F.lit(0.0), F.col("rwtt") - F.col("rwt") * F.col("rwt") / F.col("rw"))).otherwise(0.0))
    c = F.col("rw") - F.col("rww") / F.col("rw")
    own = own.withColumn("tau2_without", F.when((F.col("k") > 1) & (c > 1e-9), F.greatest(F.lit(0.0), (F.col("q_without") - (F.col("k") - 1)) / c)).otherwise(0.0))
    own = others_mean(own, studies, keys)
    own = own.withColumns({"delta": F.abs(F.col("mu_without") - F.col("mu")), "i2_without": i_squared(F.col("q_without"), F.col("k")), "residual": (th - F.col("mu")) / F.sqrt(s2 + F.col("tau2"))})
    own = cut(own.withColumn("_far", F.abs("residual")), "without")
    most = own.groupBy(*keys).agg(F.min_by("study", F.struct(-F.round("delta", 9), "study")).alias("top"))
    usual = quantile(own, keys, "_far", 0.5).select(*keys, F.col("q").alias("usual"))
    own = own.join(told(most, "most"), keys).join(told(usual, "usual"), keys, "left")
    far = F.col("_far")
    return own.select(*keys, "study", "mu_without", "tau2_without", "i2_without", "q_without", "delta", "residual", ((far > 1.96) & (far > 2 * (F.col("usual") + 1e-9))).alias("outlier"), (F.col("study") == F.col("top")).alias("most_influential"))


def egger(studies: DataFrame, keys: list[str]) -> DataFrame:
    """Small-study test: regression of theta / se on 1 / se, t-test of the intercept, three studies or more."""
    se = F.sqrt("s2")
    r = studies.select(*keys, (F.col("theta") / se).alias("y"), (1 / se).alias("x"))
    g = r.groupBy(*keys).agg(F.count("*").alias("k"), F.regr_intercept("y", "x").alias("intercept"), F.regr_syy("y", "x").alias("syy"), F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"), F.avg("x").alias("mx"))
    g = g.where((F.col("k") >= 3) & (F.col("sxx") > 0))
    s2 = F.greatest(F.lit(0.0), F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("k") - 2)
    g = g.withColumn("se", F.sqrt(s2 * (1 / F.col("k") + F.col("mx") * F.col("mx") / F.col("sxx"))))
    g = g.withColumn("t", F.when(F.col("se") > 0, F.col("intercept") / F.col("se")))
    return g.withColumn("p", 2 * tails.t_sf(F.abs("t"), (F.col("k") - 2).cast("double"))).select(*keys, "k", "intercept", "se", "t", "p")


def replicate_meta(units: DataFrame, keys: list[str]) -> DataFrame:
    """Two or more runs under equal conditions: their pool, and the coefficient of variation (population SD) of the raw values."""
    raw = units.groupBy(*keys).agg(F.count("*").alias("n"), (F.stddev_pop("raw") / F.avg("raw")).alias("cv")).where("n >= 2")
    return dersimonian_laird(units, keys).join(raw, keys).withColumn("stochastic", F.col("cv") > 0.5)
