"""Curves out of raw rows: classes, assembly, first-row conditions, keys, resume and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse


def split_rows(raw: DataFrame) -> dict[str, DataFrame]:
    """Time points, endpoints and rate rows by the prefix of entry; other rows are dropped."""
    return {name: raw.where(F.col("entry").startswith(p)) for name, p in (("time", "T"), ("endpoint", "O"), ("rate", "R"))}


def first_rows(points: DataFrame) -> DataFrame:
    """Points with t and y, the first in file order of each (curve, t)."""
    w = Window.partitionBy("curve_id", "t").orderBy("seq")
    return points.where("t is not null and y is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def assemble_curves(points: DataFrame) -> DataFrame:
    """One row a curve: its points in order of time, and how many rows went."""
    marked = points.withColumn("_ok", F.col("t").isNotNull() & F.col("y").isNotNull())
    w = Window.partitionBy("curve_id", "t").orderBy(F.col("_ok").desc(), "seq")
    one = marked.withColumn("_keep", F.col("_ok") & (F.row_number().over(w) == 1))
    return one.groupBy("curve_id").agg(
        F.count("*").alias("n_raw"), F.count(F.when(F.col("_keep"), 1)).alias("n_points"), F.count(F.when(~F.col("_ok"), 1)).alias("n_missing"),
        F.array_sort(F.collect_list(F.when(F.col("_keep"), F.struct("t", "y")))).alias("points"),
    ).withColumn("n_duplicate", F.col("n_raw") - F.col("n_points") - F.col("n_missing"))


def first_row_attrs(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A curve's conditions are those of its first row; of rows with the same seq, the one whose columns, in their order, are least."""
    return rows.groupBy("curve_id").agg(F.min(F.struct(F.isnull("seq").alias("_late"), "seq", *columns)).alias("c")).select("curve_id", *[f"c.{c}" for c in columns])


def pending(incoming: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return incoming.join(done.select(key), key, "left_anti")


def gapfill(curves: DataFrame, models: DataFrame, fits: DataFrame) -> DataFrame:
    """(curve, model) pairs that are asked for and have no fit; models is a registry of a dozen rows."""
    return curves.select("curve_id").join(F.broadcast(models.select("model"))).join(fits.select("curve_id", "model"), ["curve_id", "model"], "left_anti")


def shard(df: DataFrame, key: str, shards: int) -> DataFrame:
    """The shard of each row, from a hash of its key: the same on every run, without a global order."""
    return df.withColumn("shard", F.pmod(parse.seed(F.col(key), "shard"), F.lit(shards)).cast("int"))


def index_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key, with the number of records that it replaces."""
    last = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("r"), (F.count("*") - 1).alias("n_replaced"))
    return last.select(key, "r.*", "n_replaced")


def build_id(components: DataFrame) -> DataFrame:
    """sha256 over the sorted name=digest pairs, first 12 hex digits."""
    pairs = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "name", "digest"))), ";")
    return components.agg(F.substring(F.sha2(pairs, 256), 1, 12).alias("build_id"))


def concentration_series(curves: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Groups of curves alike but for concentration, with so many distinct raw concentrations or more; null keys group together."""
    groups = curves.groupBy(*keys).agg(F.countDistinct("conc_raw").alias("n_conc"), F.count("*").alias("n_members"), F.array_sort(F.collect_list("curve_id")).alias("members"))
    return groups.where(F.col("n_conc") >= least).withColumn("series_id", F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("?")) for k in keys])))


def axis_values(conc: Column, ph: Column, temp: Column) -> list[Column]:
    """Half-even rounding, so that noise is not variation."""
    return [F.bround(conc, 4).alias("conc_axis"), F.bround(ph, 1).alias("ph_axis"), F.bround(temp, 0).alias("temp_axis")]
