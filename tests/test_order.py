"""Sums of doubles are made in one order, and once, where what is equal depends on their last bits."""

from __future__ import annotations

import random
import tempfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sigmark.operators import pooling, terms
from sigmark.plans import load
from sigmark.plans.d_ranks import h04
from sigmark.sources.tables import Tables, means, placed

from .conftest import DATA


def test_means_are_added_in_the_order_of_the_files(spark):
    """Groups over many files and tasks; the values' sums depend on their order."""
    draw = random.Random(5)
    rows = [(draw.randrange(7), draw.choice([0.01, 0.03, 0.07, 0.1, 1e9 / 3]), None if draw.random() < 0.1 else draw.random()) for _ in range(3000)]
    path = tempfile.mkdtemp(prefix="order-")
    for i in range(0, 3000, 500):
        spark.createDataFrame(rows[i : i + 500], "g int, a double, b double").coalesce(1).write.parquet(f"{path}/part-{i:04d}.parquet")
    got = {r.g: (r.a, r.b) for r in means(placed(spark.read.parquet(f"{path}/*.parquet")), "g", a="a", b="b").collect()}
    for g in range(7):
        for k, v in enumerate(got[g]):
            kept, total = [r[1 + k] for r in rows if r[0] == g and r[1 + k] is not None], 0.0
            for x in kept:
                total += x
            assert v == total / len(kept)


def test_associations_do_not_depend_on_how_lines_are_dealt(spark):
    """Lines in five files, each a task: ties of means are those of their sums in the order of the files, as the SQL adds them on one thread."""
    import duckdb

    path, t = tempfile.mkdtemp(prefix="dealt-"), Tables(spark, DATA)
    lines = t.lineitem.withColumn("_row", F.monotonically_increasing_id()).collect()
    for i in range(5):
        own = spark.createDataFrame(lines[i * len(lines) // 5 : (i + 1) * len(lines) // 5], t.lineitem.schema.add("_row", "long"))
        own.coalesce(1).sortWithinPartitions("_row").drop("_row").write.parquet(f"{path}/lineitem.parquet/at={i}")
    t.part.write.parquet(f"{path}/part.parquet")
    con = duckdb.connect()
    con.execute("set threads=1")
    con.execute(f"create view lineitem as select * from '{DATA}/lineitem.parquet'")
    con.execute(f"create view part as select * from '{DATA}/part.parquet'")
    queries, sql = load()
    for name in ("u06_associations", "h06_bh_fdr"):
        df = queries[name](spark, path)
        res = con.execute(sql[name])
        cols = [d[0] for d in res.description]
        assert sorted(map(tuple, df.select(*cols).collect())) == sorted(res.fetchall()), name


def test_a_median_is_one_of_the_means_it_is_compared_with(spark):
    """The means are a table before the median of them is taken, so none is made twice."""
    plan = load()[0]["r14_discordance"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_extendedprice" not in plan


def test_values_equal_to_the_mean(spark):
    """Whatever the tasks that rows come from, a value is compared with the sum in order of time over the count."""
    draw, rows = random.Random(11), []
    for curve in range(400):
        ys = [round(draw.expovariate(1 / 50), 2) for _ in range(11)]
        rows += [(curve, i, float(i), y) for i, y in enumerate([*ys, round(sum(ys) / 11, 2)])]
    t = SimpleNamespace(points=lambda: spark.createDataFrame(draw.sample(rows, len(rows)), "curve_id long, seq long, t double, y double").repartition(7))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.curve_id: r.n for r in h04(t).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for curve in range(400):
        ys, total = [y for c, _, _, y in rows if c == curve], 0.0
        for y in ys:
            total += y
        assert got[curve] == sum(y != total / 12 for y in ys)
    assert set(got.values()) == {11, 12}


def test_leave_one_out_sorts_no_studies_by_their_group(spark):
    """What is known of a few groups is sent to the studies, whatever their number; merged, all of a group's studies would be sorted in one task, join after join."""
    rows = spark.range(600).select((F.col("id") % 2).alias("g"), F.col("id").alias("study"), (F.col("id") % 7).cast("double").alias("theta"), (0.1 + F.col("id") % 5).alias("s2"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = pooling.leave_one_out(rows, ["g"], pooling.random_effects(rows, ["g"]))
        plan = done._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
        assert done.count() == 600 and done.where("most_influential").count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_names_are_told_by_their_beginnings(spark, monkeypatch):
    """Names beyond one automaton make no more of them: one that begins another, that differs by case, that stands in a word, and that overlaps."""
    monkeypatch.setattr(terms, "MOST", 2000)
    names = [f"large ring {i}" for i in range(300)] + ["Large Ring 7", "ring 2", "299 e", "tau", "tau tau", "İx ring 30"]
    texts = ["a LARGE ring 299 end, large ring 3001 and ring 25", "xlarge ring 7", "tau tau tau taux", None, "", "İX ring 30 large ring 1large ring 2", "none"]
    table = spark.createDataFrame([(n,) for n in names], "term string")
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    made = terms._built(names)
    want = sorted((k, *h) for k, x in enumerate(texts) if x for h in terms.longest(terms.occurrences(made, x), len(x)))
    monkeypatch.setattr(terms, "_automata", lambda t: pytest.fail("automata of all names"))
    got = sorted(map(tuple, terms.find_longest(rows, table).select("k", "start", "end", "term").collect()))
    assert got == want and len(got) > 8
