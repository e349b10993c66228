"""What a task reads or holds must not grow with a group: no rows for each distinct count, no merge or window by a few large groups."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sigmark.operators import bank, features, regression
from sigmark.plans import load

from .conftest import DATA


def text(df, which="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


@pytest.mark.parametrize("name", ["c08_cohorts", "y09_cohort_request"])
def test_cohorts_make_no_row_for_each_distinct_count(spark, name):
    assert "Expand" not in text(load()[0][name](spark, DATA))


def test_forest_has_no_window_and_no_merge_by_protein(spark):
    plan = text(load()[0]["k14_forest"](spark, DATA))
    assert "Window" not in plan and "strategy=broadcast" in plan


def test_units_meet_their_groups_by_broadcast(spark):
    """A few groups of any size: rows are neither shuffled nor sorted by them."""
    rows = spark.range(400).select((F.col("id") % 2).alias("g"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3 == 0).alias("f"))
    got = regression.centred(rows, ["g"], {"x": 1}, ["f"], {"x": 2, "f": 2})
    plan = text(got, "sparkPlan")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "strategy=broadcast" in text(got)
    assert got.groupBy("g").agg(F.round(F.sum("x_x"), 9).alias("s")).where("s <> 0").count() == 0


def test_shares_of_variance_read_lines_three_times(spark):
    """Levels, coefficients and studies: each is a table before the next reads the lines."""
    plan = text(load()[0]["k10_variance_decomposition"](spark, DATA))
    assert "l_extendedprice" not in plan


def test_marks_are_what_dense_points_tell(spark):
    """Every shape of the bank, also falling, flat and of no length in time: one row a curve tells what its 600 points do, without an exchange of them."""
    cands = bank.grid(spark)
    fits = cands.select((F.col("candidate") * 3).alias("curve_id"), "model", "candidate", F.lit(1.0).alias("base"), (F.col("candidate") % 4 - 1).cast("double").alias("amp"), F.when(F.col("model") == "brain_cousens", -0.7).otherwise(0.0).alias("tilt"))
    windows = fits.select("curve_id", F.lit(2.5).alias("lo"), F.when(F.col("curve_id") % 7 == 0, 2.5).otherwise(50.0).alias("hi"), F.lit(9).alias("n_points"))
    got = features.marks(fits, cands, windows)
    assert text(got, "executedPlan").count("Exchange") <= 3 and "Window" not in text(got)
    dense = features.densify(fits, cands, windows).cache()
    want = {r.curve_id: r.asDict() for r in features.inflection(dense).collect()}
    for name, share in features.CROSSINGS.items():
        at = {r.curve_id: r["at"] for r in bank.first_crossing(dense, share, "t", "v").collect()}
        for k in want:
            want[k][name] = at.get(k)
    assert len(want) == cands.count()
    for r in got.collect():
        a, b = r.asDict(), want[r.curve_id]
        assert {k: v if v is None else pytest.approx(v, rel=1e-12) for k, v in b.items()} == a, (a, b)
