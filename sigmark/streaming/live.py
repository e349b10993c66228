"""Arriving points and claims, with what is known of a key kept in the stream's own state.

A batch reads its own rows only: the state (RocksDB, with the checkpoint) has
each curve's points and each claim's id, so cost follows what arrives and what
it touches, not history.  State and output move together: a batch that runs
again after a failure starts from the state before it, and overwrites its own
folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators import curves, features

#: What a verdict says of a curve.
FIELDS = ["n_points", "fittability", "censoring", "handling", "regime", "model", "t50"]
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
POINT = "seq long, t double, y double"


def point_stream(spark: SparkSession, path: str, schema: StructType, per_batch: int = 1) -> DataFrame:
    """Parquet files of points as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


class CurvePoints(StatefulProcessor):
    """Keeps the points of a curve, and gives all of them whenever some arrive.

    A curve without new points for idle milliseconds is forgotten; points that come
    later begin it anew.
    """

    def __init__(self, idle: int | None = None) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getListState("points", POINT)
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for new in rows:
            self.points.appendList(list(new[["seq", "t", "y"]].itertuples(index=False, name=None)))
        if self.idle is not None:
            if self.due.exists():
                self.handle.deleteTimer(self.due.get()[0])
            at = timerValues.getCurrentProcessingTimeInMs() + self.idle
            self.due.update((at,))
            self.handle.registerTimer(at)
        every = pd.DataFrame(list(self.points.get()), columns=["seq", "t", "y"])
        every.insert(0, "curve_id", key[0])
        yield every

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.points.clear()
        self.due.clear()
        return iter([])

    def close(self) -> None:
        pass


def _run(rows: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    return rows.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def with_history(points: DataFrame, idle: int | None = None) -> DataFrame:
    """All points, old and new, of each curve that a batch touches."""
    points.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kind = points.schema["curve_id"].dataType.simpleString()
    own = points.select("curve_id", F.col("seq").cast("long").alias("seq"), F.col("t").cast("double").alias("t"), F.col("y").cast("double").alias("y")).groupBy("curve_id")
    return own.transformWithStateInPandas(CurvePoints(idle), f"curve_id {kind}, {POINT}", "Update", "None" if idle is None else "ProcessingTime")


def analyze_stream(points: DataFrame, verdicts: str, checkpoint: str, idle: int | None = None) -> StreamingQuery:
    """Each batch analyses the curves that it touches, with all their points: triage, model, half-time, regime.

    Without idle the query ends when it has read what is there; with it, it goes on
    until it is stopped, since timers may always fall due.
    """

    def analyse(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            clean = curves.first_rows(batch).select("curve_id", "t", "y")
            features.analysis(clean).select("curve_id", *FIELDS, F.lit(epoch).alias("as_of")).write.mode("overwrite").parquet(f"{verdicts}/epoch={epoch}")

    return _run(with_history(points, idle), analyse, checkpoint, **({} if idle is None else {"processingTime": "1 second"}))


def latest(verdicts: DataFrame) -> DataFrame:
    """The newest verdict of each curve."""
    return verdicts.groupBy("curve_id").agg(F.max_by(F.struct(*FIELDS), "as_of").alias("v")).select("curve_id", "v.*")


def ledger_stream(claims: DataFrame, ledger: str, checkpoint: str, known: DataFrame | None = None) -> StreamingQuery:
    """Append each claim whose id has not been seen, by a state of ids that is kept for good; known: an older ledger's claims, where the checkpoint is new."""
    claims.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    fresh = claims if known is None else claims.join(known.select("claim_id").distinct(), "claim_id", "left_anti")

    def append(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{ledger}/epoch={epoch}")

    return _run(fresh.dropDuplicates(["claim_id"]), append, checkpoint)
