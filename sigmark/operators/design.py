"""What a further experiment would tell: 2 x 2 information on the two shape parameters of a logistic fit, over the grid of times that a design would measure."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Prior spread relative to a parameter, exponent where none is known, classes told apart with one concentration and with a series, costs, hours of preparation.
PRIOR_CV, FALLBACK_GAMMA, NOMINAL_GAMMA = 1.0, 1.0, 1.0
CLASSES_SINGLE, CLASSES_SERIES = 1, 4
SETUP_COST, RUN_COST, NOTE_COST, PREP_HOURS = 1.0, 1.0, 0.25, 2.0
#: What SSE is known to: fits round it to six digits.
SSE_DIGITS = 1e-6

# Designs in order. A curve is (change of concentration, stretch of time, points per interval, intervals as a multiple of now's, replicates).
DESIGNS = [
    ("add_single_concentration", [(2.0, 1.0, 1, 1, 1)]),
    ("add_concentration_series", [(0.5, 1.0, 1, 1, 1), (1.0, 1.0, 1, 1, 1), (2.0, 1.0, 1, 1, 1)]),
    ("add_replicates", [(1.0, 1.0, 1, 1, 4)]),
    ("increase_measurement_frequency", [(1.0, 1.0, 2, 2, 1)]),
    ("extend_sampling_duration", [(1.0, 1.0, 1, 2, 1)]),
    ("vary_temperature", [(1.0, 0.9, 1, 1, 1)]),
    ("vary_pH", [(1.0, 0.9, 1, 1, 1)]),
    ("record_agitation_and_seeding", []),
]
SERIES, NOTE = "add_concentration_series", "record_agitation_and_seeding"


def curves_of_designs() -> list[tuple[int, float, float, int, int, int]]:
    """(place of the design, fold, stretch, density, intervals, replicates), a row a curve to be measured."""
    return [(i, *c) for i, (_, cs) in enumerate(DESIGNS) for c in cs]


def information(units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ord, f11, f12, f22, reach): information of every design that measures, and how far it goes in time now's curve as 1.

    units: keys, k, t0, amp (of base + amp / (1 + exp(-k (x - t0))), x in 0..1),
    n points, sigma2, gamma (may be null). A unit meets some ten curves, and each
    of their points is summed at once, so one row a unit and design is shuffled.
    """
    plan = units.sparkSession.createDataFrame(curves_of_designs(), "ord int, fold double, stretch double, density int, intervals int, reps int")
    n = F.col("n")
    rows = units.where("n >= 2").join(F.broadcast(plan)).withColumn("step", F.col("stretch") * F.pow("fold", -F.coalesce("gamma", F.lit(FALLBACK_GAMMA))) / F.col("density") / (n - 1))
    last = (F.col("intervals") * (n - 1)).cast("int")
    x = rows.withColumn("last", last).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumn("x", F.col("i") * F.col("step"))
    g = 1 / (1 + F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), -F.col("k") * (F.col("x") - F.col("t0"))))))
    x = x.withColumn("g", g).withColumn("s", F.col("amp") * F.col("g") * (1 - F.col("g")))
    x = x.withColumns({"a": F.col("s") * (F.col("x") - F.col("t0")), "b": -F.col("s") * F.col("k"), "w": F.col("reps") / F.col("sigma2")})
    total = lambda p, q: F.sum(F.col("w") * F.col(p) * F.col(q))
    return x.groupBy(*keys, "ord").agg(total("a", "a").alias("f11"), total("a", "b").alias("f12"), total("b", "b").alias("f22"), F.max(F.col("last") * F.col("step")).alias("reach"))


def _names(spark: SparkSession) -> DataFrame:
    runs = lambda cs: float(sum(c[4] for c in cs))
    rows = [(i, d, SETUP_COST + RUN_COST * runs(cs) if cs else NOTE_COST, d == SERIES, d == NOTE) for i, (d, cs) in enumerate(DESIGNS)]
    return spark.createDataFrame(rows, "ord int, design string, cost double, opens_gamma boolean, gating boolean")


def _bits(f11: Column, f12: Column, f22: Column, a: Column, b: Column, unit: float = 1.0) -> Column:
    """Half the binary logarithm of det(unit I + S F), where S is the diagonal prior (a, b)."""
    return 0.5 * F.log2((unit + a * f11) * (unit + b * f22) - a * b * f12 * f12)


def _gamma_bits(f11: Column, f22: Column) -> Column:
    return 0.5 * F.log1p(NOMINAL_GAMMA**2 * (f11 + f22) / 2) / math.log(2)


def score(units: DataFrame, keys: list[str], cv: float = PRIOR_CV) -> DataFrame:
    """Every design of every unit: information, cost, hours, priority, and the largest share of a standard error that it takes away.

    units as for information(), with has_series, notes_known (booleans), hours
    (length of the curve). A note of what was done gives no information on
    parameters; it opens a licence, worth the classes it tells apart once a
    series is there, and isn't offered where the notes are known. A unit of
    fewer than two points has no design.
    """
    f = information(units, keys)
    prior = lambda p: F.greatest(F.lit(1e-12), F.pow(cv * F.col(p), 2))
    facts = units.where("n >= 2").select(*keys, "has_series", "notes_known", "hours", F.col("gamma").isNull().alias("no_gamma"), prior("k").alias("a"), prior("t0").alias("b"))
    d = facts.join(F.broadcast(_names(units.sparkSession))).where(~(F.col("gating") & F.col("notes_known")))
    d = d.join(f, [*keys, "ord"], "left").fillna(0.0, ["f11", "f12", "f22"])
    f11, f12, f22, a, b = (F.col(c) for c in ("f11", "f12", "f22", "a", "b"))
    bits = _bits(f11, f12, f22, a, b) + F.when(F.col("opens_gamma"), _gamma_bits(f11, f22)).otherwise(0.0)
    opened = F.when(F.col("has_series"), math.log2(CLASSES_SERIES / CLASSES_SINGLE)).otherwise(0.0)
    det = (1 / a + f11) * (1 / b + f22) - f12 * f12
    less = F.greatest(F.lit(0.0), 1 - F.sqrt((1 / b + f22) / det / a), 1 - F.sqrt((1 / a + f11) / det / b))
    d = d.withColumns({"bits": F.when(F.col("gating"), opened).otherwise(bits), "se_less": F.when(~F.col("gating"), less), "run_hours": F.when(F.col("gating"), 0.0).otherwise(PREP_HOURS + F.col("hours") * F.col("reach")), "guessed": F.col("no_gamma") & F.col("design").isin("add_single_concentration", SERIES)})
    return d.withColumn("priority", F.col("bits") / F.col("cost"))


def greedy(scored: DataFrame, keys: list[str], steps: int = 3) -> DataFrame:
    """(keys, step, design, gain, priority, total_gain, total_cost): in each step what adds most for its cost to what is taken already.

    What is known starts at the prior's precision; each taken design adds its
    information, and all others are scored again. Every pass is a window over a
    unit's designs, so one exchange serves all. Ties go to the design that comes
    first.
    """
    unit = Window.partitionBy(*keys)
    a, b = F.col("a"), F.col("b")
    s = scored.select(*keys, "ord", "design", "f11", "f12", "f22", "opens_gamma", "gating", "cost", "a", "b", F.col("has_series").alias("series"), (1 / a).alias("g11"), F.lit(0.0).alias("g12"), (1 / b).alias("g22"), F.lit(None).cast("int").alias("step"), F.lit(None).cast("double").alias("gain"))
    for step in range(1, steps + 1):
        more = _bits(F.col("g11") + F.col("f11"), F.col("g12") + F.col("f12"), F.col("g22") + F.col("f22"), a, b) - _bits(F.col("g11"), F.col("g12"), F.col("g22"), a, b)
        more = more + F.when(F.col("opens_gamma") & ~F.col("series"), _gamma_bits(F.col("f11"), F.col("f22"))).otherwise(0.0)
        licence = F.when(F.col("series"), math.log2(CLASSES_SERIES / CLASSES_SINGLE)).otherwise(0.0)
        s = s.withColumn("adds", F.when(F.col("step").isNull(), F.when(F.col("gating"), licence).otherwise(more)))
        bid = F.when(F.col("step").isNull(), F.struct(F.round(F.col("adds") / F.col("cost"), 9).alias("p"), (-F.col("ord")).alias("o"), "f11", "f12", "f22", "opens_gamma"))
        s = s.withColumn("best", F.max(bid).over(unit))
        won = F.col("best.o") == -F.col("ord")
        s = s.withColumns({"step": F.when(won, step).otherwise(F.col("step")), "gain": F.when(won, F.col("adds")).otherwise(F.col("gain")), "series": F.col("series") | F.coalesce("best.opens_gamma", F.lit(False)), **{g: F.col(g) + F.coalesce(f"best.{f}", F.lit(0.0)) for g, f in (("g11", "f11"), ("g12", "f12"), ("g22", "f22"))}})
    so_far = unit.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    taken = s.where("step is not null").withColumns({"total_gain": F.sum(F.greatest(F.lit(0.0), "gain")).over(so_far), "total_cost": F.sum("cost").over(so_far), "priority": F.col("gain") / F.col("cost")})
    return taken.select(*keys, "step", "design", "gain", "priority", "total_gain", "total_cost")


def pareto(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Designs that no other of the same unit beats: none tells at least as much for at most the cost and the hours, and is better in one."""
    o = F.struct(F.round("bits", 6).alias("bits"), "cost", F.round("run_hours", 6).alias("run_hours"))
    all_ = F.collect_list("o")
    u = scored.withColumn("o", o).groupBy(*keys).agg(F.collect_list(F.struct("design", "o")).alias("d"), all_.alias("rest"))
    beats = lambda q, p: (q["bits"] >= p["bits"]) & (q["cost"] <= p["cost"]) & (q["run_hours"] <= p["run_hours"]) & ((q["bits"] > p["bits"]) | (q["cost"] < p["cost"]) | (q["run_hours"] < p["run_hours"]))
    kept = F.filter("d", lambda p: ~F.exists("rest", lambda q: beats(q, p["o"])))
    return u.select(*keys, F.explode(kept).alias("k")).select(*keys, F.col("k.design").alias("design"))
