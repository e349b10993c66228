"""Results that ties, or the order in which sums are made, must not touch."""

from __future__ import annotations

import math
import tempfile
from fractions import Fraction
from types import SimpleNamespace

from pyspark.sql import functions as F

from sigmark.operators import curves, regression, triage
from sigmark.plans import e_ladders


def test_first_rows_with_one_seq(spark):
    rows = [(1, 12, "N", 3.0), (1, 12, "A", 9.0), (1, 12, "A", 5.0), (1, 40, "A", 1.0), (2, None, "A", 1.0), (2, 7, "R", 2.0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "curve_id int, seq int, assay string, conc double").coalesce(1)
        got = curves.first_row_attrs(df, ["assay", "conc"])
        assert got.columns == ["curve_id", "assay", "conc"]
        assert sorted(map(tuple, got.collect())) == [(1, "A", 5.0), (2, "R", 2.0)]


def test_means_at_a_limit(spark):
    """Discounts whose mean is 0.055 are not above it, in whatever order they are added."""
    one, two = [0.09, 0.09, 0.02, 0.08, 0.02, 0.02, 0.09, 0.03], [0.08, 0.03, 0.08, 0.08, 0.1, 0.03, 0.02, 0.06, 0.03, 0.05, 0.07, 0.03]
    orders = dict(enumerate([one, one[::-1], sorted(one), two, two[::-1], sorted(two), [0.09, 0.02] * 3]))
    items = [(p, 30000.0, 20.0, d) for p, o in orders.items() for d in o]
    t = SimpleNamespace(
        lineitem=spark.createDataFrame(items, "l_partkey int, l_extendedprice double, l_quantity double, l_discount double").coalesce(1),
        part=spark.createDataFrame([(p, "b", 20) for p in orders], "p_partkey int, p_brand string, p_size int"),
    )
    assert [r.no_ph for r in e_ladders.tier_of(t).collect()] == [False] * len(orders)


def test_slopes_of_points_a_moment_apart(spark):
    """Ends of a curve with points some milliseconds apart, thousands of hours from the start of time."""
    ts = [*[2000.0 + 1e-6 * i for i in (0, 1, 3)], *[2100.0 + 7 * i for i in range(9)], *[2600.0 + 1e-6 * i for i in (0, 3, 4)]]
    ys = [3.0, 7.0, 19.0, *[20.0 + i for i in range(9)], 31.0, 46.0, 48.5]

    def slope(k):
        t, y = [Fraction(ts[i]) for i in k], [Fraction(ys[i]) for i in k]
        mt, my = sum(t) / len(t), sum(y) / len(y)
        return float(sum((a - mt) * (b - my) for a, b in zip(t, y)) / sum((a - mt) ** 2 for a in t))

    r = triage.features(spark.createDataFrame(list(zip([1] * 15, ts, ys)), "curve_id int, t double, y double")).first()
    for got, want in ((r.start_slope, slope([0, 1, 2])), (r.end_slope, slope([12, 13, 14]))):
        assert abs(got / want - 1) < 1e-12


def test_slopes_of_one_point(spark):
    """A curve of one point, which the small tables have none of, has the slopes that the SQL gives it; two equal points are flat."""
    import duckdb

    from sigmark.plans import load

    rows = [(0, "2024-01-03 00:00:00", 7, "view", 3.5), *[(1 + i, f"2024-01-0{1 + i} 00:00:00", 8, "view", 2.0) for i in range(2)], *[(3 + i, f"2024-01-0{1 + i} 00:00:00", 9, "view", i * i * 1.0) for i in range(5)]]
    events = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    path = tempfile.mkdtemp(prefix="one-")
    events.coalesce(1).write.parquet(f"{path}/events.parquet")
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    con.execute(f"create view events as select * from '{path}/events.parquet/*.parquet'")
    queries, sql = load()
    want = sorted(con.execute(sql["d04_edge_slopes"]).fetchall())
    got = sorted(map(tuple, queries["d04_edge_slopes"](spark, path).select("curve_id", "n_points", "start_slope", "end_slope").collect()))
    assert repr(got) == repr(want) and math.isnan(got[0][2])


def test_fewer_rows_than_columns_are_singular(spark):
    """Nearly equal columns leave noise for the last pivot, far above what tells a pivot from none."""
    rows = [("g", 1.31, 1.31003, 0.6547, 1.0), ("g", 5.67, 5.6701, 2.8352, 2.0), ("g", 1.9, 1.89981, 0.9509, 2.5), ("g", 4.11, 4.11032, 2.0549, 4.0)]
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, y double").withColumn("d", F.col("a") * F.col("c") / 7)
    df = df.withColumns({f"use_{c}": F.lit(True) for c in names})
    r = regression.wls(df, ["g"], {c: F.col(c) for c in names}, F.col("y"), F.lit(3.0), {c: F.col(f"use_{c}") for c in names}).first()
    assert r.singular and r.b_a is None and abs(r.b_intercept - 2.375) < 1e-12
