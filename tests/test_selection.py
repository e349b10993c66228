"""Exact ranks and quantiles against sorted lists: ties, nulls, groups of very unlike sizes, and no task that holds a whole group."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmark.operators import ranks, selection


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    out = [("big", k, rng.choice([rng.random(), float(rng.randrange(50)), -1e300 * rng.random()])) for k in range(4000)]
    out += [("ties", 4000 + k, float(k % 3)) for k in range(301)] + [("one", 5000, 2.0), ("none", 5001, None), (None, 5002, 1.0)] + [("big", 6000 + k, None) for k in range(9)]
    return out, spark.createDataFrame(out, "g string, id int, v double").repartition(5)


def by_group(rows):
    out = {}
    for g, _, v in rows:
        if g is not None and v is not None:
            out.setdefault(g, []).append(v)
    return {g: sorted(v) for g, v in out.items()}


@pytest.mark.parametrize("alpha", [0.1, 0.5, 0.0001, 0.999])
def test_conformal_quantile(rows, alpha):
    got = {r.g: (r.q, r.n) for r in ranks.conformal_q(rows[1], "v", alpha, "g").collect()}
    assert got == {g: (v[min(len(v), max(1, math.ceil((len(v) + 1) * (1 - alpha)))) - 1], len(v)) for g, v in by_group(rows[0]).items()}


def test_quantile_of_all(rows):
    every = sorted(v for _, _, v in rows[0] if v is not None)
    got = selection.quantile(rows[1], [], "v", 0.37).collect()
    assert len(got) == 1 and math.isclose(got[0].q, float(np.quantile(every, 0.37)), rel_tol=1e-12)


def test_hazen(rows):
    values = by_group(rows[0])
    for r in selection.hazen(rows[1], ["g"], "v").collect():
        v = values[r.g]
        assert math.isclose(r.percentile, 100 * (sum(x < r.v for x in v) + 0.5 * v.count(r.v)) / len(v))


def test_ranges_share_a_large_group(rows):
    ranged = selection.running(rows[1].where("g = 'big' and v is not null").withColumn("n", F.lit(1)), ["g"], ["v", "id"])
    got = [r.below for r in ranged.orderBy("v", "id").collect()]
    assert got == list(range(len(got)))
    plan = ranged._jdf.queryExecution().optimizedPlan().toString()
    assert all("_range" in x for x in plan.split("\n") if "Window [" in x and "_own" in x)


def test_split_is_exact_in_each_label(rows):
    got = ranks.split_half(rows[1].where("g is not null"), "id", "g", 0.3).groupBy("g").agg(F.count("*").alias("n"), F.sum(F.col("train").cast("int")).alias("k")).collect()
    assert {r.g: (r.n, r.k) for r in got} == {g: (n, math.floor(0.3 * n)) for g, n in (("big", 4009), ("ties", 301), ("one", 1), ("none", 1))}
