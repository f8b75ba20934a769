"""Sinks and table maintenance (SNK-*).

Layers are written to new version directories, so a job never overwrites a
path that its own plan reads (Spark refuses that), and a failed run leaves
the previous version intact. Directories live under the cluster's shared
checkpoint folder unless the caller passes a path.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from ..functions import constants as K
from ..operators.joins import BROADCAST_ROWS
from ..operators.sequence import first_per_key


def write_version(df: DataFrame, root: str, layer: str, fmt: str = "parquet") -> str:
    """Full refresh of a layer as a new version directory (SNK-1); returns the path."""
    path = f"{root.rstrip('/')}/{layer}/v-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").format(fmt).save(path)
    return path


def append_csv(df: DataFrame, path: str) -> None:
    """Append rows to a CSV directory; each part file has its header (SNK-3)."""
    df.write.mode("append").option("header", True).csv(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Overwrite a CSV export (SNK-6..9)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType,
                  fmt: str = "parquet") -> DataFrame:
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def insert_or_ignore(new: DataFrame, path: str, key: Sequence[str],
                     order: Sequence[str] | None = None, fmt: str = "parquet",
                     batch_id: int | None = None, buckets: int | None = None,
                     writers: int = 1) -> None:
    """Append only rows whose key is not stored yet (SNK-4). Within the batch
    the first row per key (by ``order``) wins.

    With ``batch_id`` the rows carry the batch that inserted them (as partition
    ``batch_id=<n>``, or as a column of a bucketed table), so they can be read
    back by pruning; a replay inserts nothing new.

    With ``buckets`` the table is also partitioned by ``bucket = hash(key) mod
    buckets``; an upsert then reads only the buckets its batch touches (a list
    of at most ``buckets`` small integers), not the whole stored key column.
    Meant for micro-batches, whose key count is small.

    The de-duplicated batch is computed once and kept for the three uses below
    (touched buckets, keys to look up, rows to append).
    """
    keys = list(key)
    batch = first_per_key(new, keys, list(order or keys))
    if buckets:
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(int(buckets))))
    batch = batch.persist()
    try:
        stored = read_or_empty(new.sparkSession, path, new.schema, fmt)
        if buckets and "bucket" in stored.columns:
            touched = [r[0] for r in batch.select("bucket").distinct().collect()]
            stored = stored.where(F.col("bucket").isin(touched))
        # only stored keys that occur in the batch matter; few keys may be broadcast, so the
        # stored table is scanned, not shuffled; more would pass through the driver (the
        # cached batch is a fraction of their hash table) and are merged where they are
        many = batch.count() > BROADCAST_ROWS
        mine = batch.select(*keys)
        existing = stored.select(*keys).join(mine.hint("merge") if many else mine, keys, "left_semi")
        fresh = batch.join(existing.hint("merge") if many else existing, keys, "left_anti")
        if batch_id is not None:
            fresh = fresh.withColumn("batch_id", F.lit(int(batch_id)))
        # bucketed tables keep batch_id as a column (files of one batch share it, so
        # Parquet statistics skip the rest); directories stay bounded by ``buckets``
        parts = ["bucket"] if buckets else (["batch_id"] if batch_id is not None else [])
        if buckets:
            # ``writers`` tasks, and new files, per bucket directory and batch
            part = F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(int(writers)))
            fresh = fresh.repartition(F.col("bucket"), part)
        w = fresh.write.mode("append").format(fmt)
        (w.partitionBy(*parts) if parts else w).save(path)
    finally:
        batch.unpersist()


def write_batch_partition(df: DataFrame, path: str, batch_id: int,
                          fmt: str = "parquet") -> None:
    """Write one micro-batch as partition ``batch_id=<n>`` (SNK-5); a replay of
    the same batch replaces only its own partition (dynamic overwrite)."""
    # a per-write option, not the session setting: concurrent writers cannot
    # switch each other to a static overwrite (which would drop other partitions)
    (df.withColumn("batch_id", F.lit(int(batch_id)))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").format(fmt).save(path))


def ensure_table(spark: SparkSession, path: str, schema: T.StructType,
                 fmt: str = "parquet") -> DataFrame:
    """Create an empty typed table at ``path`` when absent (SNK-12)."""
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException:
        spark.createDataFrame([], schema).write.mode("overwrite").format(fmt).save(path)
        return spark.read.format(fmt).load(path)


def save_model(model, path: str) -> None:
    """Persist a fitted pipeline (SNK-13)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def drop_tables(spark: SparkSession, root: str, order: Sequence[str]) -> list[str]:
    """Remove stored tables under ``root`` in the given order, children before the
    tables they refer to (SNK-12); returns the names that existed."""
    jvm = spark._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    gone = []
    for name in order:
        p = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            fs.delete(p, True)
            gone.append(name)
    return gone


def compact(spark: SparkSession, path: str, target: str, by: str | None = None,
            rows_per_file: int = 1_000_000) -> None:
    """Rewrite a table of many small batch files as ``target`` with larger ones, all
    rows kept. With ``by`` the directories of that column stay."""
    df = spark.read.parquet(path)
    w = (df.hint("rebalance", by) if by else df.hint("rebalance")).write.option("maxRecordsPerFile", rows_per_file)
    (w.partitionBy(by) if by else w).parquet(target)
