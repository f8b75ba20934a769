"""Silver, star and gold kept current by change propagation (JOB-4, JOB-6, JOB-7, STR-3/4).

A batch of raw encounters changes silver only for the patients it names. ``apply_batch``
compares the batch's first encounter per patient with the stored one and appends the
difference: a row with sign 1 for a new first encounter, and one with sign -1 for the row
it replaces (an earlier encounter that came late). Stored rows are read from the touched
patients' buckets only. What the other layers need of it is appended with the batch:

* gold sums per risk level (patients, score, stay and medication totals; at most one row
  per level and batch), so KPIs and distribution add up rows, not patients;
* signed counts per lab-count value, from which the 75th percentile is read exactly
  however many rows there are (one row per distinct whole number and batch).

The dimensions, the fact and the patient summary are one-to-one projections of a silver
row, so they are views over the current rows. A batch that runs again sees the state of
the batches before it and replaces its own partitions by equal ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from ..operators.sequence import first_per_key, running_total
from ..session import materialize
from ..sources import readers as R
from ..sources.sinks import read_or_empty
from . import warehouse as W

ORDER = "admitted_at"
BUCKETS = 64
CHANGES, LABS, GOLD = "silver_changes", "lab_counts", "gold_sums"
ROW_COLUMNS = [c for c in W.SILVER_COLUMNS if c != "high_lab_procedures"]
SUMS = {"risk_score": "decimal(12,4)", "time_in_hospital": "long", "num_medications": "long"}


def _write(df: DataFrame, path: str, batch_id: int, parts: list[str]) -> None:
    if parts:   # one file per directory, not one per directory and task
        df = df.repartition(*parts)
    (df.withColumn("batch_id", F.lit(int(batch_id))).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*parts, "batch_id").parquet(path))


def changes(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Signed silver rows that turn the stored first encounters into those with ``batch``.

    Both hold one or more rows per patient; order is (``ORDER``, visit_id), nulls first.
    """
    order = [ORDER, "visit_id"]
    new = first_per_key(batch, "patient_id", order)
    old = first_per_key(stored, "patient_id", order)
    cols = [*ROW_COLUMNS, ORDER, "bucket"]
    pair = (new.select("patient_id", F.struct(*cols).alias("new"))
            .join(old.select("patient_id", F.struct(*cols).alias("old")).hint("merge"), "patient_id", "left")
            .where(F.col("old").isNull() | (F.struct(*[F.col(f"new.{c}") for c in order])
                                            < F.struct(*[F.col(f"old.{c}") for c in order]))))
    both = F.array(F.struct(F.col("new").alias("row"), F.lit(1).alias("sign")),
                   F.struct(F.col("old").alias("row"), F.lit(-1).alias("sign")))
    return (pair.select(F.explode(F.filter(both, lambda x: x["row"].isNotNull())).alias("x"))
            .select("x.row.*", "x.sign"))


def apply_batch(raw: DataFrame, root: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """Take one batch of raw encounters into the layers under ``root``."""
    spark = raw.sparkSession
    batch = W.first_encounters(raw, ORDER, keep=[ORDER]) \
        .withColumn("bucket", F.pmod(F.xxhash64("patient_id"), F.lit(int(buckets))).cast("int"))
    batch = materialize(batch.select(*ROW_COLUMNS, ORDER, "bucket"), "incremental-batch")
    touched = [r[0] for r in batch.select("bucket").distinct().collect()]      # at most ``buckets`` numbers
    schema = batch.withColumn("sign", F.lit(1)).withColumn("batch_id", F.lit(0)).schema
    stored = read_or_empty(spark, f"{root}/{CHANGES}", schema) \
        .where(F.col("bucket").isin(touched) & (F.col("batch_id") < int(batch_id)) & (F.col("sign") == 1)) \
        .select(*batch.columns)
    stored = stored.join(batch.select("patient_id").hint("merge"), "patient_id", "left_semi")
    delta = materialize(changes(batch, stored), "incremental-delta")
    _write(delta, f"{root}/{CHANGES}", batch_id, ["bucket"])
    labs = delta.groupBy(F.col("num_lab_procedures").alias("value")).agg(F.sum("sign").alias("n")).where("n != 0")
    _write(labs, f"{root}/{LABS}", batch_id, [])
    rows = W.scored(delta)
    sums = [x for c, t in SUMS.items()
            for x in (F.sum(F.col(c).cast(t) * F.col("sign")).alias(f"s_{c}"),
                      F.sum(F.when(F.col(c).isNotNull(), F.col("sign"))).cast("long").alias(f"n_{c}"))]
    _write(rows.groupBy("risk_level").agg(F.sum("sign").alias("n"), *sums), f"{root}/{GOLD}", batch_id, [])


# ------------------------------------------------------------------ reading
def threshold(spark: SparkSession, root: str, q: float = K.HIGH_LAB_QUANTILE, name: str = "__threshold") -> DataFrame:
    """One row with the exact linear-interpolated quantile of the current rows' lab
    counts, from the signed counts per value; null without rows."""
    counts = (spark.read.parquet(f"{root}/{LABS}").where("value IS NOT NULL").groupBy("value")
              .agg(F.sum("n").alias("n")).where("n > 0"))
    ranked = running_total(counts, "value", ["n"])
    total = counts.agg((F.lit(q) * (F.sum("n") - 1)).alias("pos"))
    at = ranked.crossJoin(F.broadcast(total)).agg(
        F.min(F.when(F.col("cum_n") > F.floor("pos"), F.col("value"))).alias("a"),
        F.min(F.when(F.col("cum_n") > F.ceil("pos"), F.col("value"))).alias("b"), F.first("pos").alias("pos"))
    return at.select((F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.floor("pos"))).cast("double").alias(name))


def current_rows(spark: SparkSession, root: str) -> DataFrame:
    """The current first encounter of every patient, without the quantile's flag."""
    rows = spark.read.parquet(f"{root}/{CHANGES}").where("sign = 1").select(*ROW_COLUMNS, ORDER)
    return first_per_key(rows, "patient_id", [ORDER, "visit_id"]).select(*ROW_COLUMNS)


def read_layer(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A layer as the full rebuild would give it (the fact without its running id)."""
    if name == "gold_hospital_kpis":
        return kpis(spark, root)
    if name == "gold_risk_distribution":
        return distribution(spark, root)
    rows = current_rows(spark, root)
    if name == "silver":
        return (rows.crossJoin(F.broadcast(threshold(spark, root)))
                .withColumn("high_lab_procedures", S.above_flag("num_lab_procedures", F.col("__threshold")))
                .select(*W.SILVER_COLUMNS))
    if name == "dim_patient":
        return rows.select(*W.DIM_PATIENT_COLUMNS)
    if name == "dim_visit_metrics":
        return W.dim_visit_metrics(rows)
    fact = W.fact(rows, with_id=False)
    if name == "fact":
        return fact
    if name == "gold_patient_risk_summary":
        return W.scored(rows).withColumn("risk_percentage", F.round(F.col("risk_score") * F.lit(100.0), 1)) \
            .select(*W.SUMMARY_COLUMNS)
    raise ValueError(f"no such layer: {name}")


def _sums(spark: SparkSession, root: str) -> DataFrame:
    cols = [f"{p}_{c}" for c in SUMS for p in ("s", "n")]
    return (spark.read.parquet(f"{root}/{GOLD}").groupBy("risk_level")
            .agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in cols]).where("n > 0"))


def kpis(spark: SparkSession, root: str) -> DataFrame:
    """The KPI row (AGG-1) from the batches' sums."""
    t = _sums(spark, root).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_patients"),
        F.coalesce(F.sum(F.when(F.col("risk_level") == "High", F.col("n"))), F.lit(0)).alias("high_risk_patients"),
        *[F.sum(f"{p}_{c}").cast("double").alias(f"{p}_{c}") for c in SUMS for p in ("s", "n")])

    def mean(c: str, digits: int):
        return F.round(S.safe_ratio(f"s_{c}", f"n_{c}"), digits)

    return t.select(
        "total_patients", "high_risk_patients",
        F.round(F.col("high_risk_patients") * F.lit(100.0) / F.nullif(F.col("total_patients"), F.lit(0)), 1)
        .alias("high_risk_rate"),
        mean("risk_score", 4).alias("avg_risk_score"), mean("time_in_hospital", 1).alias("avg_length_of_stay"),
        mean("num_medications", 1).alias("avg_medications"))


def distribution(spark: SparkSession, root: str) -> DataFrame:
    """Patients per level with percent of all (AGG-4) from the batches' sums."""
    per = _sums(spark, root).select("risk_level", F.col("n").alias("patient_count"))
    total = per.agg(F.sum("patient_count").alias("__total"))
    return (per.crossJoin(F.broadcast(total))
            .withColumn("percentage", F.round(F.col("patient_count") * F.lit(100.0) / F.nullif("__total", F.lit(0)), 1))
            .drop("__total"))


def compact(spark: SparkSession, root: str, target: str, buckets: int = BUCKETS) -> int:
    """Write the layers of all batches so far as one batch under ``target``, without rows
    that were replaced; returns its batch id. Later batches go on from there."""
    changes_, last = spark.read.parquet(f"{root}/{CHANGES}"), 0
    last = int(changes_.agg(F.max("batch_id")).first()[0] or 0)
    rows = first_per_key(changes_.where("sign = 1").drop("batch_id"), "patient_id", [ORDER, "visit_id"])
    _write(rows, f"{target}/{CHANGES}", last, ["bucket"])
    labs = spark.read.parquet(f"{root}/{LABS}").groupBy("value").agg(F.sum("n").alias("n")).where("n != 0")
    _write(labs, f"{target}/{LABS}", last, [])
    _write(_sums(spark, root), f"{target}/{GOLD}", last, [])
    return last


def stream(spark: SparkSession, source: str, root: str, checkpoint: str, schema, max_files: int = 1):
    """Apply every landed file as batches of a Structured Streaming query, then stop."""
    raw = R.stream_source(spark, source, schema, "parquet", max_files=max_files)
    q = (raw.writeStream.foreachBatch(lambda df, i: apply_batch(df, root, i)).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
