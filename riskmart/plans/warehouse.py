"""Warehouse jobs: raw -> silver -> star (dims, fact) -> gold (JOB-4..8).

Each job is a function from DataFrames to DataFrames; nothing is collected.
The orchestrator (``medallion``) decides which layers are written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from ..operators.quantiles import quantile_row
from ..operators.sequence import dense_row_id, first_per_key
from ..operators.shape import with_defaults
from ..session import materialize

DIM_PATIENT_COLUMNS = ["patient_id", "age", "age_group", "gender", "race"]
DIM_VISIT_COLUMNS = [
    "visit_id", "time_in_hospital", "num_lab_procedures", "num_procedures",
    "num_medications", "total_visits", "number_inpatient", "number_outpatient",
    "number_emergency", "diag_1_category", "insulin", "diabetes_med", "a1c_result",
]
SILVER_COLUMNS = [
    "patient_id", "visit_id", "age", "age_group", "gender", "race",
    "time_in_hospital", "num_lab_procedures", "num_procedures", "num_medications",
    "number_inpatient", "number_outpatient", "number_emergency", "total_visits",
    "number_diagnoses", "diag_1_category", "diag_2_category", "diag_3_category",
    "insulin", "diabetes_med", "a1c_result", "medication_change",
    "high_lab_procedures", "total_medications_active", "readmitted_binary",
]
SUMMARY_COLUMNS = [
    "patient_id", "visit_id", "age", "age_group", "gender", "race", "diag_1_category",
    "num_medications", "num_lab_procedures", "time_in_hospital", "total_visits",
    "number_inpatient", "insulin", "diabetes_med", "a1c_result",
    "risk_score", "risk_percentage", "risk_level",
]


def quantile_threshold(df: DataFrame, column: str, q: float = K.HIGH_LAB_QUANTILE,
                       name: str = "__threshold") -> DataFrame:
    """One-row table holding the exact linear-interpolated ``q`` quantile (AGG-17),
    found with bounded memory per task (see ``operators.quantiles``)."""
    return quantile_row(df, column, q, name)


def flag_above_quantile(df: DataFrame, column: str, out: str,
                        q: float = K.HIGH_LAB_QUANTILE) -> DataFrame:
    """``out`` = 1 where ``column`` exceeds its global ``q`` quantile (SCA-10).

    The quantile is a one-row aggregate, so joining it to every row by a
    broadcast cross join is bounded by construction.
    """
    t = quantile_threshold(df, column, q)
    return (df.crossJoin(F.broadcast(t))
            .withColumn(out, S.above_flag(column, F.col("__threshold")))
            .drop("__threshold"))


def silver(raw: DataFrame, order_col: str | None = "admitted_at",
           materialize_rows: bool = True) -> DataFrame:
    """Bronze/raw encounters (text) -> typed silver, one row per patient (JOB-4)."""
    out = first_encounters(raw, order_col)
    if materialize_rows:
        # the quantile is a second pass over the same rows: read a stored copy
        out = materialize(out, "silver-rows")
    out = flag_above_quantile(out, "num_lab_procedures", "high_lab_procedures")
    return out.select(*SILVER_COLUMNS)


def first_encounters(raw: DataFrame, order_col: str | None = "admitted_at", keep: Sequence[str] = ()) -> DataFrame:
    """Silver rows without the flag that needs all rows' quantile, and the raw columns
    ``keep``.

    Keeps each patient's first encounter by (``order_col``, encounter id). Rows
    whose patient or encounter id is no number have no key: ``rejected`` lists them,
    here they are left out rather than merged into one row.
    """
    kept = list(keep)
    present = set(raw.columns)
    # only the columns silver uses travel through the keep-first shuffle (the
    # kept row is a struct, whose fields the optimizer cannot prune); absent
    # raw columns are added as defaults after it
    used = ["age", "gender", "race", *K.NUMERIC_RAW_COLUMNS, *K.DIAG_COLUMNS, "insulin",
            "diabetesMed", "A1Cresult", *K.MEDICATION_COLS, "readmitted"]
    order = ([order_col] if order_col and order_col in present else []) + ["visit_id"]
    keep = [c for c in dict.fromkeys(used + order[:-1] + kept) if c in present]
    typed = raw.select(
        F.col("patient_nbr").try_cast("long").alias("patient_id"),
        F.col("encounter_id").try_cast("long").alias("visit_id"),
        *[F.col(c) for c in keep],
    ).where(valid_ids())
    first = with_defaults(first_per_key(typed, "patient_id", order),
                          {c: None for c in used})

    # try_cast: an out-of-range raw number becomes null instead of failing the job
    num = {c: F.coalesce(S.safe_number(c, 0).try_cast("int"), F.lit(0))
           for c in K.NUMERIC_RAW_COLUMNS}
    age = S.age_numeric("age")
    # an absent medication column counts as "No"; a null value counts as 1
    med_flags = [S.not_no_flag(F.col(m)) if m in present else F.lit(0)
                 for m in K.MEDICATION_COLS]
    return first.select(
        "patient_id", "visit_id",
        age.alias("age"),
        S.age_group(age).alias("age_group"),
        "gender", "race",
        num["time_in_hospital"].alias("time_in_hospital"),
        num["num_lab_procedures"].alias("num_lab_procedures"),
        num["num_procedures"].alias("num_procedures"),
        num["num_medications"].alias("num_medications"),
        num["number_inpatient"].alias("number_inpatient"),
        num["number_outpatient"].alias("number_outpatient"),
        num["number_emergency"].alias("number_emergency"),
        S.row_sum([num[c] for c in K.VISIT_COLUMNS]).cast("int").alias("total_visits"),
        num["number_diagnoses"].alias("number_diagnoses"),
        S.code_category("diag_1").alias("diag_1_category"),
        S.code_category("diag_2").alias("diag_2_category"),
        S.code_category("diag_3").alias("diag_3_category"),
        F.coalesce(F.col("insulin"), F.lit("Unknown")).alias("insulin"),
        F.coalesce(F.col("diabetesMed"), F.lit("Unknown")).alias("diabetes_med"),
        F.coalesce(F.col("A1Cresult"), F.lit("Unknown")).alias("a1c_result"),
        S.member_flag("insulin", ["Up", "Down"]).alias("medication_change"),
        sum(med_flags, F.lit(0)).cast("int").alias("total_medications_active"),
        S.readmit_flag("readmitted").alias("readmitted_binary"), *kept,
    )


def valid_ids() -> Column:
    return F.col("patient_id").isNotNull() & F.col("visit_id").isNotNull()


def rejected(raw: DataFrame) -> DataFrame:
    """Raw rows that silver cannot key, with the ids as they came and the reason."""
    patient, visit = F.col("patient_nbr"), F.col("encounter_id")
    return raw.select(
        patient.alias("patient_nbr"), visit.alias("encounter_id"),
        F.when(patient.try_cast("long").isNull(), "patient_nbr").otherwise("encounter_id").alias("reason"),
    ).where(patient.try_cast("long").isNull() | visit.try_cast("long").isNull())


def with_audit(df: DataFrame, name: str = "processed_at") -> DataFrame:
    """Audit timestamp column (SNK-11)."""
    return df.withColumn(name, F.current_timestamp())


def dim_patient(silver_df: DataFrame) -> DataFrame:
    return silver_df.select(*DIM_PATIENT_COLUMNS).distinct()


def dim_visit_metrics(silver_df: DataFrame) -> DataFrame:
    return silver_df.select(*DIM_VISIT_COLUMNS).distinct()


def latest_predictions(predictions: DataFrame) -> DataFrame:
    """Latest prediction per patient, so the fact join cannot multiply rows."""
    order = [c for c in ("predicted_at", "prediction_id") if c in predictions.columns]
    return first_per_key(predictions.select("patient_id", "risk_score", "risk_level", *order),
                         "patient_id", order or ["risk_score"], descending=True)


def fact(silver_df: DataFrame, predictions: DataFrame | None = None,
         with_id: bool = True) -> DataFrame:
    """Fact rows: silver ⟕ predictions, fallback score where unmatched (JOB-6).

    ``risk_level`` of a fallback row comes from its (rounded) score with the
    right-closed bands.
    """
    out = scored(silver_df.select("patient_id", "visit_id", "readmitted_binary", "age_group",
                                  "number_inpatient", "num_medications"), predictions).select(
        "patient_id", "visit_id", "risk_score", "risk_level", "readmitted_binary")
    if with_id:
        out = dense_row_id(out, ["visit_id"], out="id")
    return out.select(*([c for c in ["id"] if with_id]),
                      "patient_id", "visit_id", "risk_score", "risk_level", "readmitted_binary")


def scored(base: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """Silver rows with risk_score and risk_level: the latest prediction, or the
    fallback score where there is none (JOI-1, JOI-6)."""
    if predictions is not None:
        p = latest_predictions(predictions).select(
            "patient_id", F.col("risk_score").alias("__score"), F.col("risk_level").alias("__level"))
        base = base.join(p.hint("merge"), "patient_id", "left")
    else:
        base = (base.withColumn("__score", F.lit(None).cast("double"))
                .withColumn("__level", F.lit(None).cast("string")))
    fb = S.fallback_score("age_group", "number_inpatient", "num_medications")
    return (base.withColumn("risk_score", F.coalesce(F.col("__score"), fb))
            .withColumn("risk_level", F.coalesce(F.col("__level"), S.risk_level(fb)))
            .drop("__score", "__level"))


def hospital_kpis(fact_df: DataFrame, dim_visit: DataFrame) -> DataFrame:
    """One-row KPI table over distinct patients (AGG-1)."""
    j = fact_df.join(dim_visit.select("visit_id", "time_in_hospital", "num_medications").hint("merge"),
                     "visit_id", "left")
    # one row per patient first: distinct counts become plain sums over it
    sums = [x for c in ("risk_score", "time_in_hospital", "num_medications")
            for x in (F.sum(c).alias(f"s_{c}"), F.count(c).alias(f"n_{c}"))]
    per = j.groupBy("patient_id").agg(
        F.max((F.col("risk_level") == "High").cast("int")).alias("high"), *sums)
    known = F.col("patient_id").isNotNull()
    t = per.agg(F.count("patient_id").alias("total_patients"),
                F.coalesce(F.sum(F.when(known, F.coalesce("high", F.lit(0)))), F.lit(0)).cast("long")
                .alias("high_risk_patients"),
                *[F.sum(f"{p}_{c}").alias(f"{p}_{c}") for p in ("s", "n")
                  for c in ("risk_score", "time_in_hospital", "num_medications")])

    def mean(c: str, digits: int) -> Column:
        return F.round(S.safe_ratio(f"s_{c}", f"n_{c}"), digits)

    return t.select(
        "total_patients", "high_risk_patients",
        F.round(F.col("high_risk_patients") * F.lit(100.0)
                / F.nullif(F.col("total_patients"), F.lit(0)), 1).alias("high_risk_rate"),
        mean("risk_score", 4).alias("avg_risk_score"),
        mean("time_in_hospital", 1).alias("avg_length_of_stay"),
        mean("num_medications", 1).alias("avg_medications"))


def risk_distribution(fact_df: DataFrame, level: str = "risk_level",
                      key: str = "patient_id") -> DataFrame:
    """Distinct patients per level with percent of all distinct patients (AGG-4, JOI-4)."""
    per = fact_df.groupBy(level).agg(F.countDistinct(key).alias("patient_count"))
    total = fact_df.agg(F.countDistinct(key).alias("__total"))
    return (per.crossJoin(F.broadcast(total))
            .withColumn("percentage", F.round(F.col("patient_count") * F.lit(100.0)
                                              / F.nullif(F.col("__total"), F.lit(0)), 1))
            .drop("__total"))


def patient_risk_summary(fact_df: DataFrame, dim_p: DataFrame, dim_v: DataFrame) -> DataFrame:
    """Star join fact ⋈ dim_patient ⋈ dim_visit_metrics at visit grain (JOI-2)."""
    j = (fact_df.select("patient_id", "visit_id", "risk_score", "risk_level")
         .join(dim_p.hint("merge"), "patient_id")
         .join(dim_v.hint("merge"), "visit_id"))
    return j.select(
        "patient_id", "visit_id", "age", "age_group", "gender", "race", "diag_1_category",
        "num_medications", "num_lab_procedures", "time_in_hospital", "total_visits",
        "number_inpatient", "insulin", "diabetes_med", "a1c_result",
        "risk_score", F.round(F.col("risk_score") * F.lit(100.0), 1).alias("risk_percentage"),
        "risk_level",
    )


def mart(raw: DataFrame, predictions: DataFrame | None = None,
         with_id: bool = False) -> dict[str, DataFrame]:
    """All warehouse layers over ``raw`` as lazy DataFrames."""
    s = silver(raw)
    dp, dv = dim_patient(s), dim_visit_metrics(s)
    f = fact(s, predictions, with_id=with_id)
    return {
        "silver": s, "dim_patient": dp, "dim_visit_metrics": dv, "fact": f,
        "gold_patient_risk_summary": patient_risk_summary(f, dp, dv),
        "gold_hospital_kpis": hospital_kpis(f, dv),
        "gold_risk_distribution": risk_distribution(f),
    }
