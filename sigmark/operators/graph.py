"""Components and levels."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder that all executors share; in local mode a temporary folder where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/sigmark-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Lineage cut by a table in the shared checkpoint folder, so that a lost executor loses nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Row bound of a table that may be broadcast.
SMALL = 1_000_000


def small(table: DataFrame, bound: int = SMALL) -> DataFrame:
    """A table with a broadcast hint if its counted rows stay within bound; else for a shuffled join."""
    return F.broadcast(table) if table.limit(bound + 1).count() <= bound else table


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, least): the least id that each node reaches over edges (a, b), in rounds that halve the paths; as large as nodes and edges are, they are merged."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    label = nodes.select("id", F.col("id").alias("least"))
    while True:
        pull = both.join(label.select(F.col("id").alias("b"), "least").hint("merge"), "b").groupBy("a").agg(F.min("least").alias("p")).withColumnRenamed("a", "id")
        step = label.join(pull.hint("merge"), "id", "left").select("id", F.col("least").alias("old"), F.least("least", F.coalesce("p", "least")).alias("least"))
        jump = step.join(step.select(F.col("id").alias("least"), F.col("least").alias("f")).hint("merge"), "least", "left").select("id", "old", F.least("least", F.coalesce("f", "least")).alias("least"))
        label = cut(jump)
        if not label.where("old <> least").limit(1).count():
            return label.select("id", "least")
        label = label.select("id", "least")


def topo_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, level): the longest way from a root, by taking away all nodes without a parent, round by round; level is null for nodes on or behind a cycle."""
    left, arcs, out, level = nodes.select("id"), edges.select("a", "b").distinct(), None, 0
    while True:
        free = cut(left.join(arcs.select(F.col("b").alias("id")), "id", "left_anti"))
        if not free.limit(1).count():
            rest = left.select("id", F.lit(None).cast("int").alias("level"))
            return rest if out is None else out.unionByName(rest)
        done = free.select("id", F.lit(level).alias("level"))
        out = done if out is None else out.unionByName(done)
        left = cut(left.join(free, "id", "left_anti"))
        arcs = cut(arcs.join(free.withColumnRenamed("id", "a"), "a", "left_anti").select("a", "b"))
        level += 1
