"""Exact ranks, k-th values and quantiles, whatever a group's size: counts by value, dealt out by ranges, with sums of what lies in the ranges before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def running(rows: DataFrame, by: list[str], order: list[str], n: str = "n") -> DataFrame:
    """rows with below (the sum of n over the group's rows that come earlier in order) and total (its sum over the group).

    Order must tell a group's rows apart.  Rows are dealt to tasks by ranges of
    (by, order), so one large group is many tasks; of each range and group a sum is
    carried over.  The ranges are a table, since they come from a sample.  Groups of
    a null key are left out.
    """
    there = rows.where(F.lit(True) if not by else ~F.greatest(*[F.col(c).isNull() for c in by], F.lit(False)))
    dealt = cut(there.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_range", *by).agg(F.sum(n).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = sums.select("_range", *by, before.alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias("total"))
    own = F.coalesce(F.sum(n).over(Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_own", own).join(carried, ["_range", *by]).withColumn("below", F.col("_before") + F.col("_own")).drop("_range", "_before", "_own")


def counted(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Each group's values (nulls left out) with n, below and total."""
    return running(rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")), by, [value])


def kth(rows: DataFrame, by: list[str], value: str, goal: Column) -> DataFrame:
    """by, q and n: the group's value of rank goal, from 1; goal is an expression of total."""
    c = counted(rows, by, value).withColumn("_k", goal)
    return c.where((F.col("below") < F.col("_k")) & (F.col("_k") <= F.col("below") + F.col("n"))).select(*by, F.col(value).alias("q"), F.col("total").alias("n"))


def quantile(rows: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """by and q: the quantile between the two values next to it, by a straight line."""
    c = counted(rows, by, value).withColumn("_at", share * (F.col("total") - 1))
    holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
    low, high = F.floor("_at"), F.ceil("_at")
    g = c.where(holds(low) | holds(high)).groupBy(*by).agg(F.max(F.when(holds(low), F.col(value))).alias("a"), F.max(F.when(holds(high), F.col(value))).alias("b"), F.first("_at").alias("_at"))
    return g.select(*by, (F.col("a") + (F.col("b") - F.col("a")) * (F.col("_at") - F.floor("_at"))).alias("q"))


def hazen(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """rows with their mid-rank percentile in the group."""
    c = counted(rows, by, value).select(*by, value, (100 * (F.col("below") + 0.5 * F.col("n")) / F.col("total")).alias("percentile"))
    return rows.join(c, [*by, value])
