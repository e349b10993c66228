"""What a join sends to the driver must not be a table that grows by an explode, or whose file is small by compression."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigmark.operators import bank, basins, features
from sigmark.operators.graph import cut


def broadcasts(df):
    """Rows of each broadcast of a query that has run."""
    df.collect()
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if name == "BroadcastExchangeExec":
            found.append(node.metrics().apply("numOutputRows").value())
        kids = node.children()
        todo.extend(kids.apply(i) for i in range(kids.size()))
    return found


def test_dense_points_are_not_broadcast(spark):
    cands = bank.grid(spark)
    one = spark.range(40).select(F.col("id").alias("curve_id"))
    winners = one.select("curve_id", F.lit("lnt").alias("model"), F.lit(0).alias("candidate"), F.lit(1.0).alias("base"), F.lit(2.0).alias("amp"), F.lit(0.0).alias("tilt"))
    windows = features.spans(one.select("curve_id", F.explode(F.array(F.lit(5.0), F.lit(9.0))).alias("t")))
    dense = features.densify(winners, cands, windows)
    assert max(broadcasts(dense), default=0) <= cands.count()
    rows = {(r.curve_id, r.i): (r.t, r.v) for r in dense.collect()}
    assert len(rows) == 40 * features.GRID and rows[3, 0] == (5.0, 1.0) and rows[3, 599] == (9.0, 3.0)


def test_outcomes_of_fits_are_not_broadcast(spark):
    """Many equal outcomes make a small file; none of them passes the driver."""
    one = spark.range(300).select(F.col("id").alias("curve"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("start"))
    rows = one.select("curve", "start", F.lit(True).alias("converged"), F.when(F.col("start") < 4, 1.0).otherwise(2.0).alias("sse"), F.array(F.when(F.col("start") < 4, 1.0).otherwise(3.0), F.lit(5.0)).alias("theta"), F.lit(9.0).alias("sst"))
    got = basins.ledger(cut(rows), ["curve"])
    assert max(broadcasts(got), default=0) == 0
    assert {(r.n_starts, r.win, r.n_basins, r.share, r.state) for r in got.collect()} == {(8, 0, 2, 0.5, "stable")}
