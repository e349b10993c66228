"""Regimes, gates, runs test, false-discovery control and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from .graph import cut

# The regimes, and the thresholds in force.
REGIMES = ["anomalous_unclassified", "cooperative_sigmoidal", "gradual_non_cooperative", "no_detectable_aggregation", "non_monotonic_settling", "threshold_driven"]
SHARPNESS, LAG_RATIO, ALPHA, RUNS_LEAST, MISFIT_R2 = 5.7, 0.97, 0.05, 8, 0.90


def regime_of_model(best: DataFrame) -> DataFrame:
    """The shape that the selected model stands for."""
    m = F.col("model")
    return best.withColumn("regime", F.when(m.isin("logistic", "gompertz", "richards", "finke_watzky"), "cooperative_sigmoidal").when(m == "brain_cousens", "non_monotonic_settling").otherwise("gradual_non_cooperative"))


def classify(rows: DataFrame) -> DataFrame:
    """rows has status, flat, non_monotonic, inflection, sharpness and lag_ratio."""
    c = F.col
    return rows.withColumn("regime", F.when(c("status") == "no_fit", "anomalous_unclassified").when(c("flat"), "no_detectable_aggregation").when(c("non_monotonic"), "non_monotonic_settling").when(~F.coalesce(c("inflection"), F.lit(False)), "gradual_non_cooperative").when((c("sharpness") > SHARPNESS) & (c("lag_ratio") > LAG_RATIO), "threshold_driven").otherwise("cooperative_sigmoidal"))


def rollup(regimes: DataFrame) -> DataFrame:
    """Curves of each regime, regimes without any included."""
    domain = regimes.sparkSession.createDataFrame([(r,) for r in REGIMES], "regime string")
    return F.broadcast(domain).join(regimes.groupBy("regime").agg(F.count("*").alias("n")), "regime", "left").select("regime", F.coalesce("n", F.lit(0)).cast("long").alias("n_curves"))


def mechanism_gates(rows: DataFrame) -> DataFrame:
    """rows has regime, mass, agitation and seeded; a mechanism is licensed when no gate fails."""
    c = F.col
    gates = F.filter(F.array(
        F.when(c("mass").isNull(), "assay_mass_unknown").when(~c("mass"), "assay_not_mass_proportional"),
        F.when(~c("regime").isin("cooperative_sigmoidal", "threshold_driven"), "no_nucleated_transition"),
        F.when(c("agitation").isNull() | c("seeded").isNull(), "agitation_or_seeding_unknown"),
    ), lambda x: x.isNotNull())
    return rows.withColumn("gates_failed", gates).withColumn("licensed", F.size("gates_failed") == 0)


def runs_test(residuals: DataFrame) -> DataFrame:
    """Wald-Wolfowitz test for too few runs of signs in each curve's residuals (curve_id, t, r)."""
    w = Window.partitionBy("curve_id").orderBy("t")
    s = residuals.where("r <> 0").select("curve_id", "t", F.signum("r").alias("s"))
    s = s.withColumn("change", (F.col("s") != F.lag("s").over(w)).cast("int"))
    g = s.groupBy("curve_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("s") > 0, 1)).alias("n1"), F.count(F.when(F.col("s") < 0, 1)).alias("n2"), (1 + F.coalesce(F.sum("change"), F.lit(0))).alias("runs"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    var = 2 * n1 * n2 * (2 * n1 * n2 - n1 - n2) / (n * n * (n - 1))
    z = F.when(var > 0, (F.col("runs") - (2 * n1 * n2 / n + 1)) / F.sqrt(var))
    return g.where(F.col("n") >= RUNS_LEAST).withColumn("z", z).withColumn("p", F.when((F.col("n1") == 0) | (F.col("n2") == 0), 0.0).otherwise(tails.norm_cdf(F.col("z"))))


def bh_fdr(rows: DataFrame, p: str, alpha: float = ALPHA) -> DataFrame:
    """rows with rejected: Benjamini-Hochberg over all rows with a p-value.

    Ranks come from counts by distinct p-value, so the global order runs over
    distinct values (bounded by the rounding of p), not over rows.
    """
    rows = cut(rows, "p-values")  # read four times
    known = rows.where(F.col(p).isNotNull())
    by = known.groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    ranked = by.withColumn("_rank", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)))
    total = known.agg(F.count("*").alias("_m"))
    limit = ranked.join(F.broadcast(total)).where(F.col("_p") <= F.col("_rank") / F.col("_m") * alpha).agg(F.max("_p").alias("_limit"))
    return rows.join(F.broadcast(limit)).withColumn("rejected", F.coalesce(F.col(p) <= F.col("_limit"), F.lit(False))).drop("_limit")


def confidence(rows: DataFrame) -> DataFrame:
    c = F.col
    low = c("r2").isNull() | c("anomalous") | (c("r2") < 0.80)
    return rows.withColumn("confidence", F.when(low, "low").when((c("r2") >= 0.95) & (c("stability").isNull() | (c("stability") >= 0.6)), "high").otherwise("medium"))


def series_regime(members: DataFrame) -> DataFrame:
    """The most frequent regime of each series (ties: the first in name order), its share, and the distribution."""
    n = members.groupBy("series_id", "regime").agg(F.count("*").alias("n"))
    g = n.groupBy("series_id").agg(F.min_by("regime", F.struct(-F.col("n"), F.col("regime"))).alias("modal"), F.sum("n").alias("n_members"), F.max("n").alias("_top"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("regime", "n")))).alias("distribution"))
    return g.withColumn("agreement", F.col("_top") / F.col("n_members")).drop("_top")
