"""Stored intermediates and small helpers shared by the operators."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds (16 MB instead of 64)."""
    spark.conf.set(BATCH_BYTES, str(16 * 1024 * 1024))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """``key`` set to ``value`` for a block; the caller's setting comes back after it."""
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under spark.checkpoint.dir and read it back.

    The copy cuts the lineage and survives lost executors. Shuffle files of the
    write are removed when it ends; the plan is not run again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with setting(spark, CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_stored(*frames: DataFrame) -> None:
    """Remove copies made by ``store`` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path is None:
            continue
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        p.getFileSystem(conf).delete(p, True)


def parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)


def id_hash(col: Column) -> Column:
    """crc32 of the id as text, as the hold-out rules name it."""
    return F.crc32(col.cast("string").cast("binary"))
