"""Designs against matrices: information, gains, the greedy rule and the frontier."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from sigmark.operators import design

SCHEMA = "u string, k double, t0 double, amp double, n int, sigma2 double, gamma double, has_series boolean, notes_known boolean, hours double"
COST = {d: 1.0 + sum(c[4] for c in cs) if cs else 0.25 for d, cs in design.DESIGNS}


def rows():
    rng = random.Random(3)
    return [(f"u{i}", rng.uniform(2, 40), rng.uniform(0.1, 1.2), rng.uniform(0.0, 2.0) if i else 0.0, rng.choice([1, 2, 3, 8, 30]), 10 ** rng.uniform(-5, 0), rng.choice([None, 0.3, 1.4]), rng.random() < 0.5, rng.random() < 0.3, rng.uniform(1, 50)) for i in range(30)]


def matrices(u):
    _, k, t0, amp, n, s2, gamma, *_ = u
    out = {}
    for name, cs in design.DESIGNS:
        f, reach = np.zeros((2, 2)), 0.0
        for fold, stretch, density, intervals, reps in cs:
            scale = stretch * fold ** -(1.0 if gamma is None else gamma)
            x = np.linspace(0, scale * intervals / density, intervals * (n - 1) + 1)
            g = 1 / (1 + np.exp(-np.clip(k * (x - t0), -50, 50)))
            s = np.stack([amp * g * (1 - g) * (x - t0), -amp * g * (1 - g) * k])
            f += s @ s.T * reps / s2
            reach = max(reach, x[-1])
        out[name] = f, reach
    return out


def bits(prior, f):
    return 0.5 * np.linalg.slogdet(np.eye(2) + prior @ f)[1] / math.log(2)


def gamma_bits(f):
    return 0.5 * math.log2(1 + np.trace(f) / 2)


@pytest.fixture(scope="module")
def scored(spark):
    return design.score(spark.createDataFrame(rows(), SCHEMA).repartition(3), ["u"]).cache()


def test_scores(scored):
    got = {(r.u, r.design): r for r in scored.collect()}
    seen = 0
    for u in rows():
        if u[4] < 2:
            assert not any(k[0] == u[0] for k in got)
            continue
        prior = np.diag([max(1e-12, u[1] ** 2), max(1e-12, u[2] ** 2)])
        for name, (f, reach) in matrices(u).items():
            if name == design.NOTE:
                assert ((u[0], name) in got) != u[8]
                if not u[8]:
                    assert got[u[0], name].bits == (2.0 if u[7] else 0.0) and got[u[0], name].run_hours == 0
                continue
            r = got[u[0], name]
            want = bits(prior, f) + (gamma_bits(f) if name == design.SERIES else 0)
            assert r.bits == pytest.approx(want, abs=1e-6) and r.cost == COST[name] and r.priority == pytest.approx(r.bits / r.cost)
            assert r.run_hours == pytest.approx(2 + u[9] * reach)
            after = np.sqrt(np.diag(np.linalg.inv(np.linalg.inv(prior) + f)) / np.diag(prior))
            assert r.se_less == pytest.approx(max(0, *(1 - after)), abs=1e-6)
            seen += 1
    assert seen > 100


def test_greedy(scored):
    got = {}
    for r in design.greedy(scored, ["u"]).orderBy("u", "step").collect():
        got.setdefault(r.u, []).append(r)
    for u in rows():
        if u[4] < 2:
            continue
        m, prior, series = matrices(u), np.diag([u[1] ** 2, u[2] ** 2]), u[7]
        acc, left, spent = np.linalg.inv(prior), [d for d, _ in design.DESIGNS if not (d == design.NOTE and u[8])], 0.0
        before = math.inf
        for r in got[u[0]]:
            def gain(d):
                if d == design.NOTE:
                    return 2.0 if series else 0.0
                return bits(prior, acc + m[d][0]) - bits(prior, acc) + (gamma_bits(m[d][0]) if d == design.SERIES and not series else 0)

            best = max(left, key=lambda d: round(gain(d) / COST[d], 7))
            assert gain(r.design) / COST[r.design] == pytest.approx(gain(best) / COST[best], abs=1e-6)
            assert r.gain == pytest.approx(gain(r.design), abs=1e-6)
            spent += COST[r.design]
            assert r.total_cost == spent
            if r.design == "add_replicates":  # information adds less to more
                assert r.gain <= before
            acc, series = acc + m[r.design][0], series or r.design == design.SERIES
            left.remove(r.design)
        assert len(got[u[0]]) == 3


def test_more_steps_than_designs(scored):
    n = {r.u: r["count"] for r in design.greedy(scored, ["u"], steps=10).groupBy("u").count().collect()}
    assert set(n.values()) == {7, 8}


def test_pareto(scored):
    rows_ = [(r.u, r.design, round(r.bits, 6), r.cost, round(r.run_hours, 6)) for r in scored.collect()]
    beats = lambda q, p: q[0] == p[0] and q[2] >= p[2] and q[3] <= p[3] and q[4] <= p[4] and q[2:] != p[2:]
    want = {p[:2] for p in rows_ if not any(beats(q, p) for q in rows_)}
    assert {tuple(r) for r in design.pareto(scored, ["u"]).select("u", "design").collect()} == want


def test_empty(spark):
    e = design.score(spark.createDataFrame([], SCHEMA), ["u"])
    assert e.collect() == [] and design.greedy(e, ["u"]).collect() == [] and design.pareto(e, ["u"]).collect() == []
