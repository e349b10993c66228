"""Values from text, case by case."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sigmark.functions import parse

AMOUNTS = [
    ("20 uM", 20.0, "uM"), ("20uM", 20.0, "uM"), ("1.5 mM", 1500.0, "mM"), ("3 nM", 0.003, "nM"), ("7 pM", 7e-6, "pM"), ("5 µM", 5.0, "µM"),
    ("10 u M", 10.0, "u M"), ("10 micro M", 10.0, "micro M"), ("10 microM at 37", 10.0, "microM"), ("10 micromolar", 10.0, "micromolar"),
    ("20 M", None, None), ("20 M or 4 mM", 4000.0, "mM"), ("2 mg/ml", None, "mg"), ("pH 7.4, 12 uM", 12.0, "uM"),
    ("1.2.3 uM", None, "uM"), ("uM", None, None), ("about", None, None), ("", None, None), (" NA ", None, None), (None, None, None),
    ("20 uL", None, "u"), ("8 min", None, "min"), ("4\tmM", 4000.0, "mM"),
]


def test_concentration(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(AMOUNTS)], "i int, t string").select("i", parse.parse_concentration(F.col("t")).alias("c")).orderBy("i").collect()
    for r, (text, value, unit) in zip(rows, AMOUNTS):
        assert r.c.unit == unit, text
        assert r.c.value_uM == (None if value is None else pytest.approx(value)), text


def test_hours(spark):
    cases = [("30 min", 0.5), ("2 h", None), ("2 hours", 2.0), ("90 seconds", 0.025), ("1.5 days", 36.0), ("pH 7, 3 hr", 3.0), (None, None), ("-", None)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", parse.parse_hours(F.col("t")).alias("h")).orderBy("i").collect()
    for r, (text, want) in zip(rows, cases):
        assert r.h == (None if want is None else pytest.approx(want)), text
