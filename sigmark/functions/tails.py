"""Tail probabilities as column expressions; Spark has no erf, so rational approximations are shared with the SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rational approximation of the normal integral with five terms, good to 7.5e-8.
A = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
B, ROOT = 0.2316419, 0.3989422804014327


def norm_sf(z: Column) -> Column:
    """P(Z > z)."""
    a = F.abs(z)
    k = 1 / (1 + B * a)
    poly = F.lit(0.0)
    for c in reversed(A):
        poly = (poly + c) * k
    upper = ROOT * F.exp(-a * a / 2) * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def norm_cdf(z: Column) -> Column:
    return 1 - norm_sf(z)


def norm_sf_sql(z: str) -> str:
    k = f"(1 / (1 + {B} * abs({z})))"
    poly = "0.0"
    for c in reversed(A):
        poly = f"(({poly} + {c}) * {k})"
    upper = f"({ROOT} * exp(-abs({z}) * abs({z}) / 2) * {poly})"
    return f"(case when {z} >= 0 then {upper} else 1 - {upper} end)"


def chi2_sf(x: Column, df: Column) -> Column:
    """P(chi2 > x), by the cube-root normal approximation."""
    v = 2 / (9 * df)
    return norm_sf((F.pow(x / df, 1 / 3) - (1 - v)) / F.sqrt(v))


def chi2_sf_sql(x: str, df: str) -> str:
    return norm_sf_sql(f"((pow({x} / {df}, 1 / 3.0) - (1 - 2 / (9.0 * {df}))) / sqrt(2 / (9.0 * {df})))")


def t_sf(t: Column, df: Column) -> Column:
    """P(T > t), by a normal approximation of the t distribution."""
    return norm_sf(t * (1 - 1 / (4 * df)) / F.sqrt(1 + t * t / (2 * df)))


def t_sf_sql(t: str, df: str) -> str:
    return norm_sf_sql(f"({t} * (1 - 1 / (4.0 * {df})) / sqrt(1 + {t} * {t} / (2.0 * {df})))")


def log_factorial(n: Column) -> Column:
    """ln n! of whole numbers: of small ones as they are, else by Stirling's series, whose next term is below 1e-12."""
    x = n.cast("double") + 1
    far = (x - 0.5) * F.log(x) - x + math.log(2 * math.pi) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n < 32, F.get(F.array(*[F.lit(math.lgamma(i + 1.0)) for i in range(32)]), n.cast("int"))).otherwise(far)
