"""The driver's tables, and the engine's logical tables made of them by Spark."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: 2024-01-01 UTC in microseconds: hour 0 of all curves.
EPOCH = 1_704_067_200_000_000


def hours(ts: str | Column) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (F.unix_micros(ts.cast("timestamp")) - F.lit(EPOCH)) / F.lit(3.6e9)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df by the given columns in as many tasks as a shuffle has: adaptive execution counts bytes, and leaves rows of few bytes and much work to few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def placed(df: DataFrame) -> DataFrame:
    """A table just read, with _place: a row's place in the table's files, which tells their order."""
    row = F.col("_metadata.row_index").alias("row")
    return df.withColumn("_place", F.struct(F.col("_metadata.file_path").alias("file"), row) if len(df.inputFiles()) > 1 else F.struct(row))


def means(rows: DataFrame, by: str, **values: str) -> DataFrame:
    """by, and under each name the mean of a column, whose values are added in the order of _place.

    In another order a sum's last bits differ, and with them which means are equal:
    ranks and medians would be those of one way of dealing the rows.  The sums are
    running ones, so a large group is read in order and not held.
    """
    w = Window.partitionBy(by).orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.select(by, "_place", *[F.struct(F.sum(c).over(w).alias("s"), F.count(c).over(w).alias("n")).alias(k) for k, c in values.items()])
    last = own.groupBy(by).agg(F.max_by(F.struct(*values), "_place").alias("l"))
    return last.select(by, *[(F.col(f"l.{k}.s") / F.nullif(F.col(f"l.{k}.n"), F.lit(0))).alias(k) for k in values])


class Tables:
    """tables.name reads a parquet table; methods give logical tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def points(self) -> DataFrame:
        """(curve_id, seq, t, y): a curve is a user's events."""
        return self.events.select(F.col("user_id").alias("curve_id"), F.col("event_id").alias("seq"), hours("ts").alias("t"), F.col("value").alias("y"))

    def short_points(self) -> DataFrame:
        """Many short curves: a user's events of one type."""
        return self.events.select(F.concat_ws("/", "user_id", "event_type").alias("curve_id"), F.col("event_id").alias("seq"), hours("ts").alias("t"), F.col("value").alias("y"))

    def part_points(self) -> DataFrame:
        """Points with ties in time: a part's shipments; seq follows the order's lines."""
        return self.lineitem.select(F.col("l_partkey").alias("curve_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), hours("l_shipdate").alias("t"), F.col("l_quantity").alias("y"))

    def conditions(self) -> DataFrame:
        """One row a shipment with its part's conditions: protein, construct, assay, concentration, pH, temperature."""
        item = self.lineitem.select(F.col("l_partkey").alias("curve_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_returnflag").alias("assay"), F.col("l_quantity").alias("conc"), (F.col("l_discount") * 100).alias("ph"), (F.col("l_extendedprice") / 1000).alias("t50"), F.col("l_suppkey").alias("study"), F.col("l_linestatus").alias("line"), F.col("l_tax").alias("tax"))
        part = self.part.select(F.col("p_partkey").alias("curve_id"), F.col("p_brand").alias("protein"), F.col("p_type").alias("construct"), F.col("p_size").cast("double").alias("temp"))
        return item.join(part, "curve_id")

    def raw(self) -> DataFrame:
        """Raw text rows: entry with a class prefix, a rendered parameter, and a text value."""
        c = self.conditions()
        entry = F.concat(F.when(F.col("assay") == "A", "T").when(F.col("assay") == "N", "O").otherwise(F.when(F.col("line") == "F", "R").otherwise("X")), F.col("seq").cast("string"))
        return c.select("curve_id", "seq", entry.alias("entry"), F.concat(F.col("conc").cast("string"), F.lit(" microM at "), (F.col("seq") % 10).cast("string"), F.lit(" Hours pH "), (F.col("temp") / 10).cast("string")).alias("parameter"), F.when(F.col("conc") < 3, "NA").otherwise(F.col("t50").cast("string")).alias("rate"), "protein")


def read_artifact(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON-lines artifact: broken lines are dropped, a missing one is an empty table."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def write_artifact(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """The whole table anew, one record a key."""
    out = df.write.mode("overwrite")
    (out.partitionBy(*by) if by else out).parquet(path)


#: Folder of a published artifact's manifests, one a version.
MANIFESTS = "_manifests"


def _store(spark: SparkSession, path: str):
    """The file system of path, and a maker of its paths."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = _store(spark, path)
    where = at(f"{path}/{MANIFESTS}")
    names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(x) for x in names if x.isdigit())


def publish(df: DataFrame, path: str, build: str) -> int:
    """Publish df, each row stamped with its build, as the next version of an artifact.

    The rows go to a folder of their own, and then one rename brings in the manifest
    that names it: readers have the old version whole until then, and a write that
    fails leaves no trace that they could see.  Of two writers that race for a number
    one takes the next.
    """
    spark = df.sparkSession
    fs, at = _store(spark, path)
    data = f"{path}/data-{uuid.uuid4().hex}"
    df.withColumn("build_id", F.lit(build)).write.parquet(data)
    draft = at(f"{path}/draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({"data": data, "build_id": build}).encode()))
    out.close()
    fs.mkdirs(at(f"{path}/{MANIFESTS}"))
    number = max(versions(spark, path), default=0) + 1
    while fs.exists(at(f"{path}/{MANIFESTS}/{number}")) or not fs.rename(draft, at(f"{path}/{MANIFESTS}/{number}")):
        number += 1
    return number


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """What a version, else the newest, consists of; nothing if none is published."""
    known = versions(spark, path)
    if not known:
        return None
    text = spark.read.text(f"{path}/{MANIFESTS}/{version or known[-1]}", wholetext=True).first()
    return json.loads(text.value)


def read_published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version's rows; they stay as they are, whatever is published meanwhile."""
    return spark.read.parquet(manifest(spark, path, version)["data"])
