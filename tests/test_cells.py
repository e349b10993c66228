"""Draws and permutations: md5 of many numbers, groups held as arrays, and the shuffled way of groups that are too large."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmark.functions.digest import Numbers
from sigmark.operators import ranks, resample


def test_digests():
    v = np.array([0, 9, 10, 99, 100, 123456789012345678, -4, 10**18, 7], np.int64)
    for prefix in (b"", b"trend:3:Brand#11/A:", b"y" * 47, b"z" * 70):
        for half in (0, 1):
            want = [int.from_bytes(hashlib.md5(prefix + str(x).encode()).digest()[8 * half : 8 * half + 8], "big") for x in v]
            assert Numbers(v).md5(prefix, half).tolist() == want
    texts = [hashlib.md5(f"a:{x}".encode()).hexdigest() for x in range(30000)]
    assert Numbers(np.arange(30000)).order(b"a:").tolist() == sorted(range(30000), key=texts.__getitem__)


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    r = spark.range(600).select(F.when(i % 3 == 0, "a").when(i < 590, "b").otherwise("c").alias("grp"), (i * 7 % 601).alias("k"), ((i * 31 % 97) / 40.0).alias("lc"), ((i * 17 % 89) / 30.0).alias("lt"), (i % 4).cast("int").alias("lvl"), (i % 5 == 0).alias("censored"))
    return r.unionByName(r.where("k < 3 and grp = 'a'")).unionByName(spark.createDataFrame([("one", 1, 2.0, 1.0, 1, True)], r.schema))


JOBS = {
    "gamma": lambda r: resample.gamma_ci(r, "grp", "k,lt,lc", 40),
    "flags": lambda r: resample.flag_correlations(r, "grp", "k", "lc", "censored", 9),
    "perm": lambda r: ranks.perm_pvalue(r.dropDuplicates(["grp", "k"]), "k", "lc", "lt", "grp", 19),
    "trend": lambda r: ranks.trend_draws(r.dropDuplicates(["grp", "k"]), "k", "lvl", "lt", "grp", 9),
}


@pytest.mark.parametrize("job", JOBS)
def test_cells_equal_shuffled_draws(rows, monkeypatch, job):
    """The same from arrays, from shuffles, and from both, each for some of the groups."""
    told = []
    for most in (10**6, 50, 0):
        monkeypatch.setattr(resample, "LARGEST", most)
        told.append({tuple(x if not isinstance(x, float) else round(x, 9) for x in r) for r in JOBS[job](rows).collect()})
    assert told[0] == told[1] == told[2] and len(told[0]) >= 3


@pytest.mark.parametrize("job", JOBS)
def test_no_row_for_each_draw(rows, job):
    """Rows that are shuffled: a group's rows for each part, not for each draw."""
    done = JOBS[job](rows)
    done.collect()
    todo, most = [done._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if name == "ShuffleExchangeExec":
            most = max(most, node.metrics().apply("shuffleRecordsWritten").value())
        kids = node.children()
        todo.extend(kids.apply(i) for i in range(kids.size()))
    assert 0 < most <= rows.count() * resample.PARTS
