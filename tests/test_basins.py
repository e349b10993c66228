"""Basins against union-find over all pairs."""

from __future__ import annotations

import math
import random

import pytest

from sigmark.operators import basins

SCHEMA = "curve string, model string, start int, converged boolean, sse double, theta array<double>, failure string, sst double"


def far(a, b):
    if not all(map(math.isfinite, a + b)):
        return math.inf
    return max(abs(x - y) / max(abs(x), abs(y), basins.FLOOR) for x, y in zip(a, b))


def brute(rows):
    good = [r for r in rows if r[3] and r[4] is not None and r[5] is not None and math.isfinite(r[4])]
    label = {r[2]: r[2] for r in good}
    for _ in good:
        for a in good:
            for b in good:
                if a is b or far(a[5], b[5]) <= basins.DISTANCE:
                    label[a[2]] = min(label[a[2]], label[b[2]])
    if not good:
        return len(rows), 0, None, 0, None, "no_fit", {}
    win = min(good, key=lambda r: (r[4], r[2]))
    if len(good) < 2:
        return len(rows), 1, win[2], 1, None, "not_evaluable", label
    rivals = [r for r in good if label[r[2]] != label[win[2]]]
    unit = max(abs(win[4]), basins.FLOOR, (rows[0][7] or 0) * 1e-9)
    gap = min((r[4] - win[4]) / unit for r in rivals) if rivals else None
    return len(rows), len(good), win[2], len(set(label.values())), gap, "stable" if gap is None or gap > basins.GAP else "knife_edge", label


@pytest.fixture(scope="module")
def table():
    rng, rows = random.Random(4), []
    for c in range(40):
        centres = [[rng.choice([-1, 1]) * 10 ** rng.uniform(-14, 3) for _ in range(3)] for _ in range(rng.choice([1, 2, 3]))]
        curve, model = (None if c == 7 else f"c{c}"), rng.choice(["a", "b"])
        for s in range(rng.choice([1, 2, 5, 14])):
            t = list(rng.choice(centres))
            kind = rng.random()
            if kind < 0.6:  # chains of steps near the tolerance
                t = [x * (1 + rng.choice([0, 0.0009, 0.0018, 0.0027, 0.00102, -0.0009])) for x in t]
            elif kind < 0.7:
                t[0] = 0.0
            elif kind < 0.75:
                t[1] = math.inf
            bad = rng.random()
            sse = None if bad < 0.05 else math.nan if bad < 0.1 else round(rng.choice([1.0, 1.0005, 1.2, 0.0]), 6)
            rows.append((curve, model, s, bad > 0.2, sse, None if 0.1 < bad < 0.13 else t, None, rng.choice([5.0, 5.0])))
    return rows


def test_ledger(spark, table):
    df = spark.createDataFrame(table, SCHEMA).repartition(3)
    groups = {}
    for r in table:
        groups.setdefault(r[:2], []).append(r)
    got = {(r.curve, r.model): r for r in basins.ledger(df, ["curve", "model"]).collect()}
    label = {(r.curve, r.model, r.start): r.basin for r in basins.clusters(df, ["curve", "model"]).collect()}
    assert set(got) == set(groups)
    states = set()
    for k, rows in groups.items():
        n, m, win, b, gap, state, want = brute(rows)
        r = got[k]
        assert (r.n_starts, r.n_converged, r.win, r.n_basins, r.state) == (n, m, win, b, state), k
        assert (r.sse_gap is None) == (gap is None) and (gap is None or r.sse_gap == pytest.approx(gap))
        assert {s: label[(*k, s)] for s in want} == want
        states.add(state)
    assert states == {"stable", "knife_edge", "no_fit", "not_evaluable"}


def test_chain_is_one_basin(spark):
    """Single linkage: ends of a chain are far apart, and still one basin."""
    rows = [("x", "a", i, True, 1.0, [1.0009**i, 2.0], None, None) for i in range(200)]
    r = basins.ledger(spark.createDataFrame(rows, SCHEMA), ["curve", "model"]).collect()
    assert [(x.n_basins, x.state, x.share) for x in r] == [(1, "stable", 1.0)]


def test_empty(spark):
    assert basins.ledger(spark.createDataFrame([], SCHEMA), ["curve", "model"]).collect() == []


def test_descent_ends_at_minima(spark):
    grid = basins.lattice("logistic")
    rng, rows = random.Random(9), []
    for c in range(5):
        rows += [(c, "logistic", g[0], rng.choice([0.5, 1.0, 2.0, 3.0]), 0.0, 1.0, 9.0) for g in grid]
    df = spark.createDataFrame(rows, "curve_id int, model string, candidate int, sse double, base double, amp double, sst double")
    sse = {(r[0], r[2]): r[3] for r in rows}
    got = {(r.curve_id, r.start): r for r in basins.descend(df, "logistic", ["curve_id"]).collect()}
    assert len(got) == len(rows)
    for (c, start), r in got.items():
        i = next(i for i, g in enumerate(grid) if g[0] == start)
        while True:
            j = min(grid[i][3], key=lambda j: (sse[c, grid[j][0]], j))
            if j == i:
                break
            i = j
        assert r.theta[:2] == [grid[i][1], grid[i][2]] and r.sse == sse[c, grid[i][0]]
