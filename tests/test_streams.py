"""Streams end where the batch operators end, whatever arrives twice or late, and read only what arrives."""

from __future__ import annotations

import tempfile
import time

import pytest
from pyspark.sql import functions as F

from sigmark.operators import curves, features
from sigmark.sources.tables import Tables, manifest, publish, read_artifact, read_published, write_artifact
from sigmark.streaming import live

from .conftest import DATA


def folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def near(r):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in r)


def verdicts(df) -> dict:
    return {r.curve_id: near(tuple(r)[1:]) for r in df.collect()}


def rows_read(query) -> list[int]:
    return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]


def test_live_verdicts_equal_batch_after_a_restart_and_late_rows(spark):
    points = Tables(spark, DATA).points().where("curve_id < 4")
    src, out, ck = folder(), folder(), folder()
    # the later file has the earlier points, and some rows again
    late = points.where("t < 50").unionByName(points.where("t >= 50").limit(20))
    parts = [points.where("t >= 50"), late]
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(f"{src}/s")
        query = live.analyze_stream(live.point_stream(spark, f"{src}/s", points.schema), f"{out}/v", ck)
        query.awaitTermination()
        assert rows_read(query) == [p.count()]
    want = features.analysis(curves.first_rows(points).select("curve_id", "t", "y")).select("curve_id", *live.FIELDS)
    got = verdicts(live.latest(spark.read.parquet(f"{out}/v")))
    assert got == verdicts(want) and all(v[4] for v in got.values())


def test_idle_curves_are_forgotten(spark):
    kind, src = "curve_id long, seq long, t double, y double", folder()
    spark.createDataFrame([], kind).write.mode("append").parquet(f"{src}/s")
    every = live.with_history(live.point_stream(spark, f"{src}/s", spark.createDataFrame([], kind).schema), idle=1)
    query = every.writeStream.format("memory").queryName("idle").outputMode("update").option("checkpointLocation", folder()).trigger(processingTime="1 second").start()
    try:
        for k in range(2):
            spark.createDataFrame([(1, k, 0.0, 0.0)], kind).coalesce(1).write.mode("append").parquet(f"{src}/s")
            until = time.time() + 30
            while time.time() < until and not (query.lastProgress and query.lastProgress["batchId"] >= 3 * (k + 1)):
                time.sleep(0.5)
    finally:
        query.stop()
    assert sorted(r.seq for r in spark.table("idle").collect()) == [0, 1]


def test_ledger_takes_each_claim_once(spark):
    src, ledger, ck = folder(), folder(), folder()
    claims = spark.range(50).select(F.concat(F.lit("c"), F.col("id") % 20).alias("claim_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("seen_at"))
    for k in range(3):
        claims.where(F.col("id") >= (30 if k else 0)).repartition(2).write.mode("append").parquet(f"{src}/s")
        query = live.ledger_stream(live.point_stream(spark, f"{src}/s", claims.schema, 10), f"{ledger}/l", ck)
        query.awaitTermination()
        assert rows_read(query) == [20 if k else 50]
    got = [(r.claim_id, (r.seen_at.timestamp() - 1_700_000_000) % 20) for r in spark.read.parquet(f"{ledger}/l").collect()]
    assert sorted(got) == sorted((f"c{i}", i) for i in range(20))
    # another checkpoint, which is told what the ledger has
    spark.sql("select * from values ('c3', timestamp '2024-01-01'), ('new', timestamp '2024-01-02'), ('new', timestamp '2024-01-01') v(claim_id, seen_at)").write.mode("append").parquet(f"{src}/s")
    live.ledger_stream(live.point_stream(spark, f"{src}/s", claims.schema, 10), f"{ledger}/m", folder(), known=spark.read.parquet(f"{ledger}/l")).awaitTermination()
    assert [r.claim_id for r in spark.read.parquet(f"{ledger}/m").collect()] == ["new"]


def test_artifacts(spark):
    where = folder()
    with open(f"{where}/a.jsonl", "w") as f:
        f.write('{"k": 1, "v": "x"}\nnot json\n{"k": 2, "v": null}\n')
    rows = read_artifact(spark, f"{where}/a.jsonl", "k long, v string")
    assert sorted(r.k for r in rows.collect()) == [1, 2]
    assert read_artifact(spark, f"{where}/none.jsonl", "k long").count() == 0
    write_artifact(rows, f"{where}/out", ["k"])
    assert spark.read.parquet(f"{where}/out").count() == 2


def test_publication_is_atomic(spark):
    where = folder() + "/artifact"
    assert manifest(spark, where) is None
    assert publish(spark.range(5), where, "one") == 1
    reader = read_published(spark, where)
    assert publish(spark.range(3), where, "two") == 2
    assert sorted(r.id for r in reader.collect()) == [0, 1, 2, 3, 4]
    broken = spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).alias("id"))
    with pytest.raises(Exception, match="lost"):
        publish(broken, where, "three")
    assert {(r.id, r.build_id) for r in read_published(spark, where).collect()} == {(k, "two") for k in range(3)}
    # the rerun of a failed write, and an older version
    assert publish(spark.range(9), where, "three") == 3 and manifest(spark, where)["build_id"] == "three"
    assert read_published(spark, where).count() == 9 and read_published(spark, where, 1).count() == 5
