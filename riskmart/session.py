"""Session construction and cluster-shared scratch locations.

On a cluster the session is built by the platform; ``configure`` only fills in
settings that are still unset, so a cluster's own choices always win.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings this library relies on. They are applied only when the session does
# not define them already.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Parquet timestamps without a zone stay wall-clock values, as DuckDB reads them.
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    # the JVM does not compile methods above 8,000 bytes of bytecode: wider stages run as
    # separate operators, whose code Spark splits, instead of one interpreted method
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def _driver_memory() -> str:
    """Local driver heap: 60 % of physical memory, at most 16 GB."""
    import os
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
        gb = max(1, min(16, int(total * 0.6 / 2**30)))
    except (ValueError, OSError, AttributeError):
        gb = 4
    return f"{gb}g"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "riskmart", extra: dict | None = None) -> SparkSession:
    """Local session for tests and benchmarks (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", _driver_memory())
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    )
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply DEFAULTS where the session leaves them unset."""
    for k, v in DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def in_thread(spark: SparkSession, fn):
    """``fn`` for a worker thread, with the caller's job group and local properties."""
    from pyspark import inheritable_thread_target
    return inheritable_thread_target(spark)(fn)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Uses ``spark.checkpoint.dir`` when the cluster names one. Only when it is
    unset on a local master (tests) is a fresh folder under the system temp dir
    taken; on a cluster executors would each write to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="riskmart-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def parallelism(spark: SparkSession) -> int:
    """Task slots to size explicit partitionings by (shuffle partitions if the
    core count is not visible, e.g. on a remote session)."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def range_partitions(spark: SparkSession) -> int:
    """Partition count for explicit range partitionings: the larger of the task
    slots and ``spark.sql.shuffle.partitions``, which a cluster sizes to its data
    (so a range partition stays near the shuffle target size)."""
    try:
        shuffle = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    except ValueError:
        shuffle = 200
    return max(parallelism(spark), shuffle)


def app_id(spark: SparkSession) -> str:
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001
        return spark.conf.get("spark.app.id", None) or str(id(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique directory under the shared checkpoint root."""
    return checkpoint_root(spark).rstrip("/") + f"/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str = "stage"):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read
    it back, so a two-pass job (a statistic, then its use) does not recompute
    the upstream plan, and the lineage is cut at a durable copy that survives
    the loss of executors."""
    spark = df.sparkSession
    p = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(p)
    return spark.read.parquet(p)
