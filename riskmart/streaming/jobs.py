"""Structured Streaming jobs (STR-1..8).

New records arrive as files; each micro-batch is scored with column
expressions (no per-row service call), written idempotently per batch id, and
the gold tables are refreshed inside ``foreachBatch`` from per-batch partial
sums (no rescan of the stored fact).
Every query has a checkpoint location under the shared checkpoint folder, so
a failed or stopped run restarts where it left off (STR-8), and a replayed
batch overwrites only its own partition.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions import scalars as S
from ..session import in_thread, parallelism
from ..sources import sinks as SK
from ..sources.readers import stream_source
from .models import scorer


def land_files(df: DataFrame, path: str, n_files: int, order: list[str]) -> None:
    """Write ``df`` as ``n_files`` files split by ``order`` ranges (arrivals)."""
    df.repartitionByRange(n_files, *order).write.mode("overwrite").parquet(path)


def files_per_arrival(spark: SparkSession, arrivals: int) -> int:
    """Files to land per arrival, so that a micro-batch of ``arrivals`` fills the task slots."""
    return -(-parallelism(spark) // arrivals)


def run_available(writer, checkpoint: str):
    """Process everything available now, then stop (restartable)."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


# ------------------------------------------------------------------ STR-5: running counts
def band_counts(stream: DataFrame, level: Column | str, value: str) -> DataFrame:
    """Running rows and mean value per level (complete mode, no watermark)."""
    lv = F.col(level) if isinstance(level, str) else level
    return stream.groupBy(lv.alias("level")).agg(F.count(F.lit(1)).alias("n"),
                                                 F.avg(value).alias("avg_value"))


def distinct_per_level(stream: DataFrame, key: str, level: str) -> DataFrame:
    """Exact distinct keys per level on a stream (STR-6, STR-7):
    ``dropDuplicates`` keeps one row per (key, level) in state, then counts."""
    return (stream.dropDuplicates([key, level]).groupBy(level)
            .agg(F.count(F.lit(1)).alias("distinct_keys")))


def distinct_per_level_bounded(stream: DataFrame, key: str, level: str, ts: str,
                               delay: str) -> DataFrame:
    """STR-7 with bounded state: duplicates of (key, level) arriving within
    ``delay`` of the first one are dropped and the state is evicted once the
    watermark passes; exact when every repeat arrives within ``delay``."""
    return (stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key, level])
            .groupBy(level).agg(F.count(F.lit(1)).alias("distinct_keys")))


def overwrite_each_batch(path: str):
    """foreachBatch sink that replaces a small result table per batch."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)
    return sink


def complete_to_table(agg: DataFrame, path: str, checkpoint: str):
    w = agg.writeStream.outputMode("complete").foreachBatch(overwrite_each_batch(path))
    return run_available(w, checkpoint)


# ------------------------------------------------------------------ STR-1..4: live path
ENC_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in
     ["encounter_id", "patient_nbr", "race", "gender", "age", "time_in_hospital",
      "num_lab_procedures", "num_medications", "number_inpatient", "number_outpatient",
      "number_emergency", "diag_1", "insulin", "change", "readmitted"]]
    + [T.StructField("admitted_at", T.TimestampType())])


def score_records(batch: DataFrame) -> DataFrame:
    """Score raw records (STR-2): with the heuristic formula, or with the probability of a
    fitted model where the batch carries ``model_score`` (see ``models``). An absent
    number counts as 0; one that is no number cannot be scored, and the record gets
    0.5 / Medium, as does every record without a usable model. Records without numeric
    ids have no key and are left out (see ``unkeyed``)."""
    age = S.age_numeric("age")

    def number(c: str):
        return F.when(F.col(c).isNull(), F.lit(0.0)).otherwise(S.safe_number(c, None))

    inp, meds = number("number_inpatient"), number("num_medications")
    fitted = "model_score" in batch.columns
    raw = F.col("model_score") if fitted else S.heuristic_score(age, inp, meds)
    version = F.col("model_version") if fitted else F.lit(K.MODEL_VERSION)
    score = F.coalesce(raw, F.lit(K.FALLBACK_SCORE))
    level = F.when(raw.isNull(), F.lit(K.FALLBACK_LEVEL)).otherwise(S.risk_level(raw, "left"))
    return batch.select(
        F.col("encounter_id").try_cast("long").alias("visit_id"),
        F.col("patient_nbr").try_cast("long").alias("patient_id"),
        score.alias("risk_score"), level.alias("risk_level"),
        S.readmit_flag("readmitted").alias("readmitted_binary"),
        S.age_numeric("age").alias("age"), "gender", "race",
        S.safe_number("time_in_hospital", 0).try_cast("int").alias("time_in_hospital"),
        S.safe_number("num_medications", 0).try_cast("int").alias("num_medications"),
        S.code_category("diag_1").alias("diag_1_category"), version.alias("model_version")
    ).where(F.col("visit_id").isNotNull() & F.col("patient_id").isNotNull())


def unkeyed(batch: DataFrame) -> DataFrame:
    """Records of a batch whose ids are no numbers, as they came."""
    return batch.where(F.col("encounter_id").try_cast("long").isNull()
                       | F.col("patient_nbr").try_cast("long").isNull())


def predictions_of(scored: DataFrame) -> DataFrame:
    """Prediction rows of a scored batch (SNK-5): one per record, keyed by the
    encounter, with percent, level, model version and time."""
    return scored.select(
        F.col("visit_id").alias("prediction_id"), "patient_id", "risk_score",
        S.percent_even("risk_score", 1).alias("risk_percentage"), "risk_level",
        F.col("readmitted_binary").alias("actual_readmitted"),
        F.current_timestamp().alias("predicted_at"), "model_version")


# key-hash buckets of the stored dimensions; an upsert reads only the buckets
# its micro-batch touches. A larger table takes more buckets and more writers.
DIM_BUCKETS = 64
GOLD = ("gold_risk_distribution", "gold_hospital_kpis")


def read_gold(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The gold table of the last finished refresh. Each refresh writes new version
    directories and then its row in ``gold_versions``, so a reader never meets a
    table that is being replaced."""
    last = spark.read.parquet(f"{root}/gold_versions").agg(F.max_by("version", "batch_id")).first()[0]
    return spark.read.parquet(f"{root}/{name}/{last}")


def live_batch(root: str, buckets: int = DIM_BUCKETS, writers: int = 1, registry: str | None = None):
    """foreachBatch body (STR-3, STR-4). With ``registry`` the published model scores the
    records, else the heuristic formula.

    * Dimensions and the (patient, risk level) pairs are insert-or-ignore,
      each row tagged with the batch that first stored it.
    * Fact and prediction rows go to partition ``batch_id`` (overwritten on replay).
    * The batch's contribution to gold is one row of partial sums, computed
      from the rows this batch stored (read back by a ``batch_id`` filter that
      Parquet statistics resolve per file) and written to
      ``gold_parts/batch_id=<n>``.
    * Gold is the sum over one small row per batch, so a refresh never rescans
      the fact; it is written as a new version and then named in ``gold_versions``. A replayed batch inserts nothing new, rewrites its own fact and
      parts partitions with the same content, and leaves gold unchanged.
    """
    by_model = scorer(registry, root) if registry else None

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        scored = score_records(by_model(batch, batch_id) if by_model else batch).persist()
        try:
            # the five writes are independent small jobs: submit them together so
            # the scheduler overlaps them (one driver thread per job)
            writes = [
                # a patient seen twice in one batch keeps a deterministic row
                lambda: SK.insert_or_ignore(
                    scored.select("patient_id", "age", "gender", "race"),
                    f"{root}/dim_patient", ["patient_id"], ["age", "gender", "race"],
                    batch_id=batch_id, buckets=buckets, writers=writers),
                lambda: SK.insert_or_ignore(
                    scored.select("visit_id", "time_in_hospital", "num_medications",
                                  "diag_1_category"),
                    f"{root}/dim_visit_metrics", ["visit_id"], ["visit_id"],
                    batch_id=batch_id, buckets=buckets, writers=writers),
                lambda: SK.insert_or_ignore(
                    scored.select("patient_id", "risk_level"), f"{root}/patient_levels",
                    ["patient_id", "risk_level"], ["patient_id"], batch_id=batch_id,
                    buckets=buckets, writers=writers),
                lambda: SK.write_batch_partition(
                    scored.select("visit_id", "patient_id", "risk_score", "risk_level",
                                  "readmitted_binary"), f"{root}/fact", batch_id),
                lambda: SK.write_batch_partition(predictions_of(scored),
                                                 f"{root}/model_predictions", batch_id),
            ]
            with ThreadPoolExecutor(max_workers=len(writes)) as pool:
                for f in [pool.submit(in_thread(spark, w)) for w in writes]:
                    f.result()
        finally:
            scored.unpersist()
        SK.write_batch_partition(batch_contribution(spark, root, batch_id, buckets),
                                 f"{root}/gold_parts", batch_id)
        parts = spark.read.parquet(f"{root}/gold_parts")
        version = f"v-{batch_id}-{uuid.uuid4().hex[:8]}"
        for name, make in zip(GOLD, (distribution_from_parts, kpis_from_parts)):
            make(parts).write.parquet(f"{root}/{name}/{version}")
        SK.write_batch_partition(spark.range(1).select(F.lit(version).alias("version")),
                                 f"{root}/gold_versions", batch_id)
    return run


def batch_contribution(spark: SparkSession, root: str, batch_id: int,
                       buckets: int = DIM_BUCKETS) -> DataFrame:
    """One row of partial sums for what batch ``batch_id`` stored. Of the stored visit
    dimension only the buckets of this batch's visits are read."""
    mine = F.col("batch_id") == F.lit(int(batch_id))
    pairs = spark.read.parquet(f"{root}/patient_levels").where(mine)
    patients = spark.read.parquet(f"{root}/dim_patient").where(mine)
    fact = spark.read.parquet(f"{root}/fact").where(mine).drop("batch_id")
    touched = [r[0] for r in fact.select(F.pmod(F.xxhash64("visit_id"), F.lit(buckets)).alias("b"))
               .distinct().collect()]                 # at most ``buckets`` numbers
    dv = spark.read.parquet(f"{root}/dim_visit_metrics").where(F.col("bucket").isin(touched)) \
        .drop("batch_id", "bucket")
    # dimension rows of this batch's visits only (semi join on the batch's keys)
    dv = dv.join(fact.select("visit_id"), "visit_id", "left_semi")
    f = fact.join(dv, "visit_id", "left")
    lv = F.col("risk_level")
    p = pairs.agg(*[F.count(F.when(lv == F.lit(x), 1)).alias(f"n_{x.lower()}")
                    for x in K.RISK_LEVELS])
    n = patients.agg(F.count(F.lit(1)).alias("n_patients"))
    s = f.agg(F.sum("risk_score").alias("sum_score"), F.count("risk_score").alias("n_score"),
              F.sum("time_in_hospital").alias("sum_los"),
              F.count("time_in_hospital").alias("n_los"),
              F.sum("num_medications").alias("sum_meds"),
              F.count("num_medications").alias("n_meds"))
    return p.crossJoin(n).crossJoin(s)


def _totals(parts: DataFrame) -> DataFrame:
    cols = [f"n_{x.lower()}" for x in K.RISK_LEVELS] + [
        "n_patients", "sum_score", "n_score", "sum_los", "n_los", "sum_meds", "n_meds"]
    return parts.agg(*[F.sum(c).alias(c) for c in cols])


def distribution_from_parts(parts: DataFrame) -> DataFrame:
    """Distinct patients per level and percent of distinct patients (AGG-4)."""
    t = _totals(parts)
    rows = t.select(F.explode(F.array(*[
        F.struct(F.lit(x).alias("risk_level"), F.col(f"n_{x.lower()}").alias("patient_count"))
        for x in K.RISK_LEVELS])).alias("r"), "n_patients")
    return rows.select(
        "r.risk_level", F.col("r.patient_count").cast("long").alias("patient_count"),
        F.round(F.col("r.patient_count") * F.lit(100.0)
                / F.nullif(F.col("n_patients"), F.lit(0)), 1).alias("percentage"),
    ).where(F.col("patient_count") > 0)


def kpis_from_parts(parts: DataFrame) -> DataFrame:
    """The KPI row (AGG-1) from the summed partials."""
    t = _totals(parts)
    return t.select(
        F.col("n_patients").cast("long").alias("total_patients"),
        F.col("n_high").cast("long").alias("high_risk_patients"),
        F.round(F.col("n_high") * F.lit(100.0) / F.nullif(F.col("n_patients"), F.lit(0)), 1)
        .alias("high_risk_rate"),
        F.round(S.safe_ratio("sum_score", "n_score"), 4).alias("avg_risk_score"),
        F.round(S.safe_ratio("sum_los", "n_los"), 1).alias("avg_length_of_stay"),
        F.round(S.safe_ratio("sum_meds", "n_meds"), 1).alias("avg_medications"))


def live_pipeline(spark: SparkSession, source: str, root: str, checkpoint: str,
                  max_files: int = 2, trigger_seconds: int | None = None,
                  buckets: int = DIM_BUCKETS, writers: int = 1, registry: str | None = None):
    """The live path as one streaming query (STR-1..4). With
    ``trigger_seconds`` it keeps running on that period (the 10 s refresh);
    without, it processes what is available and stops."""
    stream = stream_source(spark, source, ENC_SCHEMA, "parquet", max_files)
    w = stream.writeStream.foreachBatch(live_batch(root, buckets, writers, registry)).option("checkpointLocation", checkpoint)
    if trigger_seconds:
        return w.trigger(processingTime=f"{trigger_seconds} seconds").start()
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return q
