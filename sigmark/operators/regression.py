"""Weighted least squares of a few columns by group: a matrix of sums a group, and a sweep over it.

The sums are combined before the shuffle, whatever a group's size; the sweep is
one array expression, so groups stay in generated code and none is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut, small

#: A pivot below this part of its own sum of squares, or below this much, is none.
RELATIVE, LEAST = 1e-10, 1e-14


def products(rows: DataFrame, keys: list[str], columns: list[Column], y: Column, w: Column) -> DataFrame:
    """keys, n and a: the weighted sums of products of 1, columns and y, row by row of the matrix."""
    one = [F.lit(1.0), *columns, y]
    m = len(one)
    own = rows.select(*keys, w.alias("_w"), *[c.cast("double").alias(f"_{i}") for i, c in enumerate(one)])
    sums = {(i, j): F.sum(F.col("_w") * F.col(f"_{i}") * F.col(f"_{j}")).alias(f"s{i}_{j}") for i in range(m) for j in range(i, m)}
    g = own.groupBy(*keys).agg(F.count("*").alias("n"), *sums.values())
    return g.select(*keys, "n", F.array(*[F.col(f"s{min(i, j)}_{max(i, j)}") for i in range(m) for j in range(m)]).alias("a"))


def swept(a: Column, columns: int, used: Column) -> Column:
    """The matrix a of products() with its pivots of 1 and of the used columns swept out, and after it 1 if a used pivot was none, else 0, and the first diagonal.

    Rows 0..columns then hold the inverse, the last column the coefficients, and
    the last corner the sum of squares that is left.
    """
    m = columns + 2
    start = F.concat(a, F.array(F.lit(0.0)), F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.get(a, i * (m + 1))))

    def sweep(acc: Column, k: Column) -> Column:
        at = lambda i, j: F.get(acc, i * m + j)
        pivot, first = at(k, k), F.get(acc, F.lit(m * m + 1) + k)
        asked = (k == 0) | F.get(used, k - 1)
        good = (F.abs(pivot) >= LEAST) & (F.abs(pivot) >= RELATIVE * F.abs(first))

        def entry(v: Column, at_: Column) -> Column:
            i, j = (at_ / m).cast("int"), at_ % m
            inner = v - at(i, k) * at(k, j) / pivot
            new = F.when((i == k) & (j == k), 1 / pivot).when(i == k, v / pivot).when(j == k, -v / pivot).otherwise(inner)
            return F.when(at_ < m * m, F.when(asked & good, new).otherwise(v)).when((at_ == m * m) & asked & ~good, 1.0).otherwise(v)

        return F.transform(acc, entry)

    return F.aggregate(F.sequence(F.lit(0), F.lit(columns)), start, sweep)


def wls(rows: DataFrame, keys: list[str], columns: dict[str, Column], y: Column, w: Column, used: dict[str, Column]) -> DataFrame:
    """keys, n, singular, sse, and of each column and intercept the coefficient b_<name> and its standard error se_<name>.

    used (of columns of keys' own table, see usable): columns that are not used have
    no coefficient.  If a used column tells nothing that the others don't, the
    design is singular, and the intercept alone is fitted.  With fewer rows than
    columns it is so by their number: the pivot that should be 0 there is noise.  Weights are inverse
    variances, so the inverse is the coefficients' covariance.
    """
    names = ["intercept", *columns]
    m = len(names) + 1
    flags = F.array(*used.values())
    g = products(rows, [*keys, *[f"use_{c}" for c in columns]], list(columns.values()), y, w)
    g = g.withColumn("b", swept(F.col("a"), len(columns), flags)).withColumn("singular", (F.get("b", F.lit(m * m)) > 0) | (F.col("n") < 1 + sum((u.cast("int") for u in used.values()), F.lit(0))))
    alone = F.get("a", F.lit(m - 1)) / F.get("a", F.lit(0))
    out = {"b_intercept": F.when(F.col("singular"), alone).otherwise(F.get("b", F.lit(m - 1))), "se_intercept": F.sqrt(F.when(F.col("singular"), 1 / F.get("a", F.lit(0))).otherwise(F.get("b", F.lit(0))))}
    for k, c in enumerate(columns, 1):
        there = ~F.col("singular") & F.get(flags, F.lit(k - 1))
        out[f"b_{c}"] = F.when(there, F.get("b", F.lit(k * m + m - 1)))
        out[f"se_{c}"] = F.when(there, F.sqrt(F.get("b", F.lit(k * m + k))))
    out["sse"] = F.when(F.col("singular"), F.get("a", F.lit(m * m - 1)) - alone * F.get("a", F.lit(m - 1))).otherwise(F.get("b", F.lit(m * m - 1)))
    return g.select(*keys, "n", "singular", *[v.alias(k) for k, v in out.items()])


def centred(rows: DataFrame, keys: list[str], numbers: dict[str, int], flags: list[str], least: dict[str, int]) -> DataFrame:
    """rows with x_<name> and use_<name> of each moderator: numbers less the group's mean, nulls at the mean; flags as 0 or 1.

    A moderator is used where its group has least levels of it, numbers rounded to
    so many digits, half to even; else it is 0 throughout.
    """
    levels = [F.countDistinct(F.bround(c, d)).alias(f"_l_{c}") for c, d in numbers.items()] + [F.countDistinct(c).alias(f"_l_{c}") for c in flags]
    g = rows.groupBy(*keys).agg(*levels, *[F.avg(c).alias(f"_m_{c}") for c in numbers])
    g = g.select(*keys, *[f"_m_{c}" for c in numbers], *[(F.col(f"_l_{c}") >= n).alias(f"use_{c}") for c, n in least.items()])
    # counted before they are sent: merged by few large groups, rows would be sorted group by group
    j = rows.join(small(cut(g, "centres")), keys)
    x = {f"x_{c}": F.when(F.col(f"use_{c}"), F.coalesce(F.col(c) - F.col(f"_m_{c}"), F.lit(0.0))).otherwise(0.0) for c in numbers}
    x |= {f"x_{c}": F.when(F.col(f"use_{c}") & F.col(c), 1.0).otherwise(0.0) for c in flags}
    return j.withColumns(x).drop(*[f"_m_{c}" for c in numbers])
