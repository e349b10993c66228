"""Sweep regression, iterated variances and leave-one-out against numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmark.operators import pooling, regression

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    out = []
    for g, n in (("many", 60), ("just", 5), ("few", 3), ("one", 1)):
        for _ in range(n):
            x = rng.normal(size=4)
            out.append((g, *map(float, x), float(2 + x @ [1, -2, 3, 0.5] + rng.normal()), float(rng.uniform(0.5, 2))))
    for _ in range(20):  # c is a sum of others
        a, b = rng.normal(size=2)
        out.append(("collinear", float(a), float(b), float(a + 2 * b), float(rng.normal()), float(a), 1.0))
    for _ in range(20):  # d never varies, and isn't used
        out.append(("flat", *map(float, rng.normal(size=3)), 0.0, float(rng.normal()), 1.0))
    return spark.createDataFrame(out, "g string, a double, b double, c double, d double, y double, w double").repartition(3)


def test_sweep(rows):
    used = {c: (F.col("g") != "flat") if c == "d" else F.lit(True) for c in COLUMNS}
    d = rows.withColumns({f"use_{c}": v for c, v in used.items()})
    got = {r.g: r for r in regression.wls(d, ["g"], {c: F.col(c) for c in COLUMNS}, F.col("y"), F.col("w"), {c: F.col(f"use_{c}") for c in COLUMNS}).collect()}
    for g, r in got.items():
        own = [x for x in rows.collect() if x.g == g]
        cols = [c for c in COLUMNS if not (g == "flat" and c == "d")]
        x, y, w = np.array([[1, *[z[c] for c in cols]] for z in own]), np.array([z.y for z in own]), np.array([z.w for z in own])
        singular = g in ("few", "one", "collinear")
        assert (r.singular, r.n) == (singular, len(own))
        if singular:
            x, cols = x[:, :1], []
        cov = np.linalg.inv(x.T @ (w[:, None] * x))
        beta = cov @ x.T @ (w * y)
        assert np.allclose([r.b_intercept, *[r[f"b_{c}"] for c in cols]], beta, rtol=1e-8)
        assert np.allclose([r.se_intercept, *[r[f"se_{c}"] for c in cols]], np.sqrt(np.diag(cov)), rtol=1e-8)
        assert math.isclose(r.sse, float(w @ (y - x @ beta) ** 2), rel_tol=1e-7, abs_tol=1e-9)
        assert all(r[f"b_{c}"] is None for c in COLUMNS if c not in cols)


def test_centred(spark):
    rows = spark.createDataFrame([("x", 1.0, True), ("x", None, False), ("x", 3.0, True), ("y", 2.0, True), ("y", 2.0, True)], "g string, a double, f boolean")
    got = [(r.g, r.x_a, r.x_f, r.use_a, r.use_f) for r in regression.centred(rows, ["g"], {"a": 4}, ["f"], {"a": 2, "f": 2}).orderBy("g", "x_a", "x_f").collect()]
    assert got == [("x", -1.0, 1.0, True, True), ("x", 0.0, 0.0, True, True), ("x", 1.0, 1.0, True, True), ("y", 0.0, 0.0, False, False), ("y", 0.0, 0.0, False, False)]


def newton(theta, s2):
    w = 1 / s2
    q, c = float((w * (theta - np.average(theta, weights=w)) ** 2).sum()), w.sum() - (w * w).sum() / w.sum()
    tau = max(0.0, (q - (len(theta) - 1)) / c) if len(theta) > 1 and c > 1e-9 else 0.0
    dl = tau
    for _ in range(100 if len(theta) > 1 else 0):
        w = 1 / (s2 + tau)
        d = (theta - np.average(theta, weights=w)) ** 2
        tau = max(0.0, tau + ((w * d).sum() - (len(theta) - 1)) / (w * w * d).sum())
    return dl, tau


@pytest.fixture(scope="module")
def studies(spark):
    rng = np.random.default_rng(8)
    out = {}
    for g, k, spread in (("wide", 40, 1.0), ("even", 25, 0.0), ("two", 2, 3.0), ("lone", 1, 1.0)):
        s2 = rng.uniform(0.01, 0.5, k)
        out[g] = (rng.normal(5, spread, k) + rng.normal(0, 1, k) * np.sqrt(s2), s2)
    out["wide"][0][3] += 40
    rows = [(g, i, float(t), float(v)) for g, (th, s2) in out.items() for i, (t, v) in enumerate(zip(th, s2, strict=True))]
    return out, spark.createDataFrame(rows, "g string, study int, theta double, s2 double").repartition(3)


def test_paule_mandel_converges(studies):
    truth, rows = studies
    got = {r.g: r for r in pooling.random_effects(rows, ["g"]).collect()}
    for g, (theta, s2) in truth.items():
        tau = newton(theta, s2)[1]
        assert math.isclose(got[g].tau2, tau, rel_tol=1e-6, abs_tol=1e-9) and got[g].k == len(theta)
        assert math.isclose(got[g].mu, np.average(theta, weights=1 / (s2 + tau)), rel_tol=1e-7)


@pytest.mark.parametrize("block", [1024, 7])
def test_leave_one_out(studies, monkeypatch, block):
    truth, rows = studies
    monkeypatch.setattr(pooling, "BLOCK", block)
    got = {(r.g, r.study): r for r in pooling.leave_one_out(rows, ["g"], pooling.random_effects(rows, ["g"])).collect()}
    assert len(got) == 40 + 25 + 2
    for g in ("wide", "even", "two"):
        theta, s2 = truth[g]
        tau = newton(theta, s2)[1]
        mu = np.average(theta, weights=1 / (s2 + tau))
        moved = []
        for i in range(len(theta)):
            th, v = np.delete(theta, i), np.delete(s2, i)
            t2 = newton(th, v)[0]
            r = got[g, i]
            assert math.isclose(r.tau2_without, t2, rel_tol=1e-6, abs_tol=1e-8)
            assert math.isclose(r.mu_without, np.average(th, weights=1 / (v + t2)), rel_tol=1e-8)
            moved.append(abs(r.mu_without - mu))
        assert [i for i in range(len(theta)) if got[g, i].most_influential] == [int(np.argmax(np.round(moved, 9)))]
    assert got["wide", 3].outlier and got["wide", 3].most_influential


def test_leave_one_out_meets_no_pairs(spark, monkeypatch):
    """Rows of every step: a study meets the places of its group's series, not the other studies."""
    rng = np.random.default_rng(8)
    k = 3000
    s2 = np.concatenate([[1e-9], rng.uniform(0.01, 0.5, k - 1)])
    th = rng.normal(5, 0.7, k)
    rows = spark.createDataFrame([("g", i, float(a), float(b)) for i, (a, b) in enumerate(zip(th, s2, strict=True))], "g string, study int, theta double, s2 double")
    done = pooling.leave_one_out(rows, ["g"], pooling.random_effects(rows, ["g"]))
    got = {r.study: r for r in done.collect()}
    for i in (0, 1, 1500, k - 1):
        a, b = np.delete(th, i), np.delete(s2, i)
        assert math.isclose(got[i].mu_without, np.average(a, weights=1 / (b + got[i].tau2_without)), rel_tol=1e-11)
    assert "others" not in done._jdf.queryExecution().optimizedPlan().toString()


def test_binomial_of_large_counts(spark):
    """Each outcome costs the same, whatever the count; so many would take days where it costs its own number."""
    from sigmark.operators import ranks

    counts = spark.createDataFrame([("a", 10, 2), ("b", 400000, 199000), ("c", 5, 5), ("d", 0, 0)], "g string, n int, k int")
    got = {r.g: r.p for r in ranks.binom_half(counts, "g").collect()}
    assert math.isclose(got["a"], 2 * (1 + 10 + 45) / 1024, rel_tol=1e-12) and got["c"] == 2 / 32 and got["d"] == 1.0
    tail = sum(math.exp(math.lgamma(400001) - math.lgamma(i + 1) - math.lgamma(400001 - i) - 400000 * math.log(2)) for i in range(195000, 199001))
    assert math.isclose(got["b"], 2 * tail, rel_tol=1e-6)
