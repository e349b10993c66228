"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Row bound of a relation that may be broadcast: eight-byte keys, so about 16 MB.
BROADCAST_ROWS = 1_000_000


#: Settings while a table is written: shuffle files go when it is done, and Arrow batches stay small however long the texts are.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "4096"}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one, in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


@contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Unlike an RDD checkpoint it computes df once, and unlike a local
    checkpoint it survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sigmark-{name}-{uuid.uuid4().hex}"
    with settings(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.sigmark_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables that cut() made and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "sigmark_path", None):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows stay within bound; else df, for a shuffled join."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df
