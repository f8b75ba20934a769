"""Operational tables, BI exports and the medallion run (JOB-8..11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions import constants as K
from ..functions import scalars as S
from ..operators.aggregates import monthly_rate, table_counts, zero_filled_levels
from ..operators.sequence import first_per_key
from ..operators.validation import require_rows
from ..sources import readers as R
from ..sources import sinks as SK
from . import warehouse as W

# FIXED VALUE: factor list stored with every seeded prediction
TOP_FACTORS = "number_inpatient,num_medications,age_numeric,number_diagnoses,time_in_hospital"


def _get(df: DataFrame, col: str, default):
    return F.col(col) if col in df.columns else F.lit(default)


def operational_tables(processed: DataFrame) -> dict[str, DataFrame]:
    """patients, patient_visits, model_predictions from processed rows (JOB-10).

    Keys are the source patient and encounter ids (not row positions), and the
    stored score is the deterministic heuristic score.
    """
    p = processed
    pid = F.col("patient_nbr").try_cast("long")
    vid = F.col("encounter_id").try_cast("long")
    age = _get(p, "age_numeric", None)
    patients = p.select(
        pid.alias("patient_id"), age.cast("int").alias("age"),
        S.age_group(age).alias("age_group"),
        _get(p, "gender", None).alias("gender"), _get(p, "race", None).alias("race"),
        _get(p, "num_medications", 0).try_cast("int").alias("num_medications"),
        _get(p, "num_lab_procedures", 0).try_cast("int").alias("num_lab_procedures"),
        _get(p, "num_procedures", 0).try_cast("int").alias("num_procedures"),
        _get(p, "number_diagnoses", 0).try_cast("int").alias("number_diagnoses"),
        _get(p, "time_in_hospital", 0).try_cast("int").alias("time_in_hospital"),
        _get(p, "diag_1_category", "Other").alias("diag_1_category"),
        _get(p, "diag_2_category", "Other").alias("diag_2_category"),
        _get(p, "diag_3_category", "Other").alias("diag_3_category"),
        _get(p, "diabetesMed", "No").cast("string").alias("diabetes_med"),
        _get(p, "insulin", "No").cast("string").alias("insulin"),
        _get(p, "A1Cresult", "None").cast("string").alias("a1c_result"),
    )
    visits = p.select(
        vid.alias("visit_id"), pid.alias("patient_id"),
        _get(p, "admission_type_id", 1).try_cast("int").alias("admission_type_id"),
        _get(p, "discharge_disposition_id", 1).try_cast("int").alias("discharge_disposition_id"),
        _get(p, "admission_source_id", 1).try_cast("int").alias("admission_source_id"),
        _get(p, "number_outpatient", 0).try_cast("int").alias("number_outpatient"),
        _get(p, "number_emergency", 0).try_cast("int").alias("number_emergency"),
        _get(p, "number_inpatient", 0).try_cast("int").alias("number_inpatient"),
        _get(p, "total_visits", 0).try_cast("int").alias("total_visits"),
        _get(p, "medication_change", 0).cast("boolean").alias("medication_change"),
        _get(p, "high_lab_procedures", 0).cast("boolean").alias("high_lab_procedures"),
    )
    score = S.heuristic_score(F.coalesce(age, F.lit(50.0)),
                              _get(p, "number_inpatient", 0), _get(p, "num_medications", 5))
    predictions = p.select(
        vid.alias("prediction_id"), pid.alias("patient_id"), score.alias("risk_score"),
        S.percent_even(score, 1).alias("risk_percentage"),
        S.risk_level(score).alias("risk_level"),
        _get(p, "readmitted_binary", 0).try_cast("int").alias("actual_readmitted"),
        F.lit(TOP_FACTORS).alias("top_factors"),
        F.current_timestamp().alias("predicted_at"),
        F.lit(K.MODEL_VERSION).alias("model_version"),
    )
    return {"patients": patients, "patient_visits": visits, "model_predictions": predictions}


def bi_exports(patients: DataFrame, predictions: DataFrame, encounters: DataFrame | None = None
               ) -> dict[str, DataFrame]:
    """Patient summary, risk by demographics, monthly trend (JOB-11, SNK-7)."""
    pred = predictions.select("patient_id", "risk_score", "risk_percentage", "risk_level")
    merged = patients.join(pred, "patient_id", "left")
    summary = merged.select("patient_id", "age", "age_group", "gender", "race",
                            "num_medications", "num_lab_procedures", "time_in_hospital",
                            "diag_1_category", "risk_score", "risk_percentage", "risk_level")
    demo = (merged.where(F.col("age_group").isNotNull() & F.col("gender").isNotNull())
            .groupBy("age_group", "gender")
            .agg(F.avg("risk_score").alias("avg_risk"),
                 F.count("patient_id").alias("patient_count"),
                 F.sum(S.equals_flag("risk_level", "High")).cast("long").alias("high_risk_count")))
    out = {"patient_risk_summary": summary, "risk_by_demographics": demo}
    if encounters is not None:
        out["readmission_trends"] = monthly_rate(encounters, "admitted_at",
                                                 F.col("readmitted") == K.READMIT_TOKEN)
    return out


def tableau_master(patients: DataFrame, visits: DataFrame, predictions: DataFrame) -> DataFrame:
    """patients ⋈ visits ⟕ latest prediction, each key column once (SNK-8, PRJ-5).

    One prediction per patient, so n visits and n predictions give n rows."""
    order = [c for c in ("predicted_at", "prediction_id") if c in predictions.columns]
    latest = first_per_key(predictions, "patient_id", order or ["risk_score"], descending=True)
    return (patients.join(visits.hint("merge"), "patient_id")
            .join(latest.hint("merge"), "patient_id", "left"))


def gold_from_silver(silver_df: DataFrame, predictions: DataFrame | None = None
                     ) -> dict[str, DataFrame]:
    """Row-grain gold built straight from silver + predictions (JOB-8):
    summary with fallback scores, KPIs over rows, zero-filled level counts."""
    summary = (W.scored(silver_df, predictions)
               .withColumn("risk_percentage", S.percent_even("risk_score", 1)))
    hi = F.col("risk_level") == "High"
    kpis = (summary.agg(
        F.count(F.lit(1)).alias("total_patients"),
        F.count(F.when(hi, F.lit(1))).alias("high_risk_patients"),
        F.bround(F.avg("risk_score"), 4).alias("avg_risk_score"),
        F.bround(F.avg("time_in_hospital"), 1).alias("avg_length_of_stay"),
        F.bround(F.avg("num_medications"), 1).alias("avg_medications"))
        .withColumn("high_risk_rate",
                    S.share_percent("high_risk_patients",
                                    F.nullif(F.col("total_patients"), F.lit(0)), 1)))
    dist = zero_filled_levels(summary, K.RISK_LEVELS)
    return {"summary": summary, "kpis": kpis, "distribution": dist}


def ingest_bronze(raw: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Land raw records in bronze with an explicit write mode (SRC-9, D19):
    ``overwrite`` for a full load, ``append`` for new records (SNK-2: the caller
    says which; the size of a batch never decides)."""
    if mode not in ("overwrite", "append"):
        raise ValueError("mode must be 'overwrite' or 'append'")
    R.to_bronze(raw).write.mode(mode).parquet(path)


def medallion(raw: DataFrame, root: str, predictions: DataFrame | None = None) -> dict[str, str]:
    """Raw -> bronze -> silver -> dims -> fact -> gold, each layer written as a
    new version directory under ``root`` and read back by the next layer
    (JOB-9). Returns the layer paths."""
    spark = raw.sparkSession
    paths: dict[str, str] = {}
    paths["bronze_patient_visits"] = SK.write_version(R.to_bronze(raw), root, "bronze")
    bronze = require_rows(spark.read.parquet(paths["bronze_patient_visits"]), "bronze")
    s = W.with_audit(W.silver(bronze))
    paths["silver_patient_visits"] = SK.write_version(C.conform(s, C.SILVER), root, "silver")
    silver = require_rows(spark.read.parquet(paths["silver_patient_visits"]), "silver")
    paths.update(_write_all({"dim_patient": (W.dim_patient(silver), "dim_patient"),
                             "dim_visit_metrics": (W.dim_visit_metrics(silver), "dim_visit")},
                            root))
    f = W.fact(silver, predictions, with_id=True).withColumn("timestamp", F.current_timestamp())
    paths["fact_patient_visits"] = SK.write_version(C.conform(f, C.FACT_PATIENT_VISITS), root,
                                                    "fact")
    fact = require_rows(spark.read.parquet(paths["fact_patient_visits"]), "fact")
    dp = spark.read.parquet(paths["dim_patient"])
    dv = spark.read.parquet(paths["dim_visit_metrics"])
    now = F.current_timestamp()
    gold = {
        "gold_patient_risk_summary": W.patient_risk_summary(fact, dp, dv),
        "gold_hospital_kpis": W.hospital_kpis(fact, dv),
        "gold_risk_distribution": W.risk_distribution(fact),
    }
    paths.update(_write_all({name: (df.withColumn("updated_at", now), name)
                             for name, df in gold.items()}, root))
    return paths


def _write_all(layers: dict, root: str) -> dict[str, str]:
    """Write independent layers as concurrent jobs (one driver thread each), so
    small jobs overlap on the cluster; returns their version paths."""
    from concurrent.futures import ThreadPoolExecutor
    from ..session import in_thread
    with ThreadPoolExecutor(max_workers=len(layers)) as pool:
        futures = {name: pool.submit(in_thread(df.sparkSession, SK.write_version), df, root, layer)
                   for name, (df, layer) in layers.items()}
        return {name: f.result() for name, f in futures.items()}


def layer_counts(spark, paths: dict[str, str]) -> DataFrame:
    """Row counts of every warehouse table; tables not written count 0 (AGG-22)."""
    tabs = {n: (spark.read.parquet(paths[n]) if n in paths else None) for n in C.TABLES}
    return table_counts(tabs)
