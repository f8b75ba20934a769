"""Typed schemas of the eleven warehouse tables (SNK-12).

Primary and foreign keys are not enforced by Spark; they are checked by
``operators.validation`` (duplicate keys, orphans, null keys).
"""

from __future__ import annotations

from pyspark.sql import types as T

from .functions import constants as K

S, I, L, D, B, TS = (T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(),
                     T.BooleanType(), T.TimestampType())


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


PATIENTS = _schema(
    ("patient_id", L), ("age", I), ("age_group", S), ("gender", S), ("race", S),
    ("num_medications", I), ("num_lab_procedures", I), ("num_procedures", I),
    ("number_diagnoses", I), ("time_in_hospital", I), ("diag_1_category", S),
    ("diag_2_category", S), ("diag_3_category", S), ("diabetes_med", S), ("insulin", S),
    ("a1c_result", S), ("created_at", TS))

PATIENT_VISITS = _schema(
    ("visit_id", L), ("patient_id", L), ("admission_type_id", I),
    ("discharge_disposition_id", I), ("admission_source_id", I), ("number_outpatient", I),
    ("number_emergency", I), ("number_inpatient", I), ("total_visits", I),
    ("medication_change", B), ("high_lab_procedures", B))

MODEL_PREDICTIONS = _schema(
    ("prediction_id", L), ("patient_id", L), ("risk_score", D), ("risk_percentage", D),
    ("risk_level", S), ("actual_readmitted", I), ("top_factors", S), ("predicted_at", TS),
    ("model_version", S))

# the 50 raw text columns, the encounter time (orders a patient's encounters)
# and the ingest timestamp
BRONZE = T.StructType([T.StructField(c, S) for c in K.RAW_COLUMNS]
                      + [T.StructField("admitted_at", TS), T.StructField("ingested_at", TS)])

SILVER = _schema(
    ("patient_id", L), ("visit_id", L), ("age", I), ("age_group", S), ("gender", S),
    ("race", S), ("time_in_hospital", I), ("num_lab_procedures", I), ("num_procedures", I),
    ("num_medications", I), ("number_inpatient", I), ("number_outpatient", I),
    ("number_emergency", I), ("total_visits", I), ("number_diagnoses", I),
    ("diag_1_category", S), ("diag_2_category", S), ("diag_3_category", S), ("insulin", S),
    ("diabetes_med", S), ("a1c_result", S), ("medication_change", I),
    ("high_lab_procedures", I), ("total_medications_active", I), ("readmitted_binary", I),
    ("processed_at", TS))

DIM_PATIENT = _schema(("patient_id", L), ("age", I), ("age_group", S), ("gender", S),
                      ("race", S))

DIM_VISIT_METRICS = _schema(
    ("visit_id", L), ("time_in_hospital", I), ("num_lab_procedures", I), ("num_procedures", I),
    ("num_medications", I), ("total_visits", I), ("number_inpatient", I),
    ("number_outpatient", I), ("number_emergency", I), ("diag_1_category", S),
    ("insulin", S), ("diabetes_med", S), ("a1c_result", S))

FACT_PATIENT_VISITS = _schema(
    ("id", L), ("patient_id", L), ("visit_id", L), ("timestamp", TS), ("risk_score", D),
    ("risk_level", S), ("readmitted_binary", I))

GOLD_PATIENT_RISK_SUMMARY = _schema(
    ("patient_id", L), ("visit_id", L), ("age", I), ("age_group", S), ("gender", S),
    ("race", S), ("diag_1_category", S), ("num_medications", I), ("num_lab_procedures", I),
    ("time_in_hospital", I), ("total_visits", I), ("number_inpatient", I), ("insulin", S),
    ("diabetes_med", S), ("a1c_result", S), ("risk_score", D), ("risk_percentage", D),
    ("risk_level", S), ("updated_at", TS))

GOLD_HOSPITAL_KPIS = _schema(
    ("total_patients", L), ("high_risk_patients", L), ("high_risk_rate", D),
    ("avg_risk_score", D), ("avg_length_of_stay", D), ("avg_medications", D),
    ("updated_at", TS))

GOLD_RISK_DISTRIBUTION = _schema(("risk_level", S), ("patient_count", L), ("percentage", D),
                                 ("updated_at", TS))

# parents first, so children are dropped first when reversed
TABLES = {
    "patients": PATIENTS,
    "patient_visits": PATIENT_VISITS,
    "model_predictions": MODEL_PREDICTIONS,
    "bronze_patient_visits": BRONZE,
    "silver_patient_visits": SILVER,
    "dim_patient": DIM_PATIENT,
    "dim_visit_metrics": DIM_VISIT_METRICS,
    "fact_patient_visits": FACT_PATIENT_VISITS,
    "gold_patient_risk_summary": GOLD_PATIENT_RISK_SUMMARY,
    "gold_hospital_kpis": GOLD_HOSPITAL_KPIS,
    "gold_risk_distribution": GOLD_RISK_DISTRIBUTION,
}

PRIMARY_KEYS = {
    "patients": ["patient_id"], "patient_visits": ["visit_id"],
    "model_predictions": ["prediction_id"], "silver_patient_visits": ["patient_id"],
    "dim_patient": ["patient_id"], "dim_visit_metrics": ["visit_id"],
    "fact_patient_visits": ["id"], "gold_patient_risk_summary": ["visit_id"],
    "gold_risk_distribution": ["risk_level"],
}

FOREIGN_KEYS = [
    ("patient_visits", "patient_id", "patients", "patient_id"),
    ("model_predictions", "patient_id", "patients", "patient_id"),
    ("fact_patient_visits", "patient_id", "dim_patient", "patient_id"),
    ("fact_patient_visits", "visit_id", "dim_visit_metrics", "visit_id"),
]


def conform(df, schema: T.StructType):
    """Cast and order ``df`` to ``schema``; absent columns become typed nulls."""
    from pyspark.sql import functions as F
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None))
                       .cast(f.dataType).alias(f.name) for f in schema.fields])
