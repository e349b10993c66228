"""Replicates of a fit, all draws of a point at once."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from sigmark.operators import bank

DRAWS = 3


def test_draws_equal_fits_of_their_own(spark):
    cands = bank.grid(spark)
    ys = lambda c, x: [1 / (1 + math.exp(-8 * (x - 0.4))) + 0.05 * math.sin(7 * x + c), 0.3 + 0.5 * x, 2.0 - x * x]
    points = spark.createDataFrame([(c, i / 11, ys(c, i / 11)) for c in (1, 2) for i in range(12)], "curve_id int, x double, ys array<double>")
    near = spark.createDataFrame([(1, "lnt"), (1, "logistic"), (1, "brain_cousens"), (2, "exponential"), (2, "scaling")], "curve_id int, model string")
    got = bank.fit_draws(points, cands, near, DRAWS)
    single = points.select("curve_id", "x", F.posexplode("ys").alias("draw", "y"))
    want = bank.fit(single, cands, ["curve_id", "draw"]).join(near, ["curve_id", "model"], "left_semi")
    cols = ["curve_id", "draw", "model", "candidate", "sse", "n", "base", "amp", "tilt", "sst"]
    a, b = ({tuple(r[:3]): r[3:] for r in d.select(*cols).collect()} for d in (got, want))
    assert len(a) == 5 * DRAWS and a.keys() == b.keys()
    for k, r in a.items():
        assert r == pytest.approx(b[k], rel=1e-6, abs=1e-9), k


def test_a_point_meets_a_candidate_once(spark):
    """Rows behind the meeting of points and candidates: points times candidates asked for, whatever the draws."""
    cands = bank.grid(spark)
    points = spark.range(12).select(F.lit(1).alias("curve_id"), (F.col("id") / 11).alias("x"), F.array(*[F.col("id") * (1.0 + d) for d in range(DRAWS)]).alias("ys"))
    near = spark.createDataFrame([(1, "exponential")], "curve_id int, model string")
    done = bank.fit_draws(points, cands, near, DRAWS)
    done.collect()
    asked, todo, most = cands.where("model = 'exponential'").count(), [done._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if name == "BroadcastHashJoinExec":
            most = max(most, node.metrics().apply("numOutputRows").value())
        kids = node.children()
        todo.extend(kids.apply(i) for i in range(kids.size()))
    assert most == 12 * asked
