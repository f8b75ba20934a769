"""Counts by each key's latest level on a stream (STR-5, STR-7): a key that changes its
level moves from one count to the other instead of adding to both.

The state is one (time, tie, level) per key in the RocksDB store, kept in the stream's
checkpoint. Every batch emits signed rows (-1 the old level, +1 the new one), stored by
batch id, so a replayed batch replaces its own rows and the counts are one sum over them.
With ``keep`` a key unseen for that long is dropped by an event-time timer and leaves its
count, so the state holds the recently seen keys only.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..sources import sinks as SK

register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS = "k string, level string, at long, tie long, ts timestamp"
SIGNED = "level string, change long"


def newest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last row of every key in each Arrow batch. Only the last row counts, so a key
    that holds a third of the rows reaches the state as one row per batch."""
    for b in batches:
        yield b.sort_values(["at", "tie"], kind="stable").drop_duplicates("k", keep="last")


class Latest(StatefulProcessor):
    """Latest level of one key; ``keep_ms`` None keeps it for good."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("latest", "at long, tie long, level string")

    def handleInputRows(self, key, rows, timerValues):
        old = self.state.get()
        new = old
        for b in rows:
            for at, tie, level in zip(b["at"].tolist(), b["tie"].tolist(), b["level"].tolist()):
                if new is None or (at, tie) > (new[0], new[1]):
                    new = (at, tie, level)
        if new is not old:
            self.state.update(new)
            if self.keep_ms is not None:
                if old is not None:
                    self.handle.deleteTimer(old[0] // 1000 + self.keep_ms)
                self.handle.registerTimer(new[0] // 1000 + self.keep_ms)
        was, now = None if old is None else old[2], None if new is None else new[2]
        if was != now:
            out = ([(was, -1)] if old is not None else []) + [(now, 1)]
            yield pd.DataFrame(out, columns=["level", "change"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        old = self.state.get()
        # a timer set before a later row moved the key's time on says nothing
        if old is not None and old[0] // 1000 + self.keep_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield pd.DataFrame([(old[2], -1)], columns=["level", "change"])

    def close(self) -> None:
        pass


def changes(stream: DataFrame, key: str, level: str, ts: str, tie: str, keep_ms: int | None = None,
            delay: str = "0 seconds") -> DataFrame:
    """Signed rows (level, change) of a stream. ``tie``: a whole number that orders rows of
    one time. Rows without key, level or time change nothing. Rows older than a key's
    latest change nothing, however late they come; with ``keep_ms`` those more than
    ``delay`` behind the newest time are left out, as their keys may have expired."""
    rows = (stream.select(F.col(key).cast("string").alias("k"), F.col(level).cast("string").alias("level"),
                          F.unix_micros(F.col(ts).cast("timestamp")).alias("at"),
                          F.coalesce(F.col(tie).cast("long"), F.lit(0)).alias("tie"), F.col(ts).cast("timestamp").alias("ts"))
            .where("k IS NOT NULL AND level IS NOT NULL AND at IS NOT NULL").mapInPandas(newest, ROWS))
    if keep_ms is not None:
        rows = rows.withWatermark("ts", delay)
    return rows.groupBy("k").transformWithStateInPandas(
        Latest(keep_ms), SIGNED, "Update", "None" if keep_ms is None else "EventTime")


def run_latest(signed: DataFrame, root: str, checkpoint: str):
    """Process what is available; the changes of batch n go to ``root/changes/batch_id=n``."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        SK.write_batch_partition(batch.groupBy("level").agg(F.sum("change").alias("change")), f"{root}/changes", batch_id)

    spark = signed.sparkSession
    was = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)           # read when the query starts
    try:
        q = (signed.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    finally:
        spark.conf.set(PROVIDER, was)
    q.awaitTermination()
    return q


def counts(spark: SparkSession, root: str) -> DataFrame:
    """level, n: keys whose latest level it is."""
    return (spark.read.parquet(f"{root}/changes").groupBy("level").agg(F.sum("change").alias("n")).where("n != 0"))
