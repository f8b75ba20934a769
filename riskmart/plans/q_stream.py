"""Streaming queries: each lands a provided table as files, runs the stream to
completion (availableNow) and returns the stored result, which must equal the
batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as T
from ..session import scratch_path
from ..sources.readers import stream_source
from ..functions import constants as K
from ..operators.linear import LinearModel
from ..streaming import jobs as J
from ..streaming import latest as L
from ..streaming import models as M
from . import sqlgen as G
from .features import clean, engineer, fit_params
from .q_ml import FEATURES, FIXED, FIXED_BIAS, LINEAR_SQL, MARGIN_SQL, linear_model, linear_sql
from .registry import query

EVENTS_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, " \
                "props string"


def _events_stream(spark, d, root):
    J.land_files(T.load(spark, d, "events"), f"{root}/in", 8, ["ts", "event_id"])
    from pyspark.sql.types import _parse_datatype_string
    return stream_source(spark, f"{root}/in", _parse_datatype_string(EVENTS_SCHEMA),
                         "parquet", max_files=2)


@query("stream_band_counts", ops=("STR-1", "STR-5", "STR-4"), sql="""
SELECT event_type AS level, COUNT(*) AS n, AVG(value) AS avg_value FROM events GROUP BY event_type""")
def q_stream_counts(spark, d):
    root = scratch_path(spark, "stream-counts")
    s = _events_stream(spark, d, root)
    J.complete_to_table(J.band_counts(s, "event_type", "value"), f"{root}/out", f"{root}/ckpt")
    return spark.read.parquet(f"{root}/out")


@query("stream_dedup", ops=("STR-6", "STR-7"), sql="""
SELECT event_type, COUNT(DISTINCT user_id) AS distinct_keys FROM events GROUP BY event_type""")
def q_stream_dedup(spark, d):
    root = scratch_path(spark, "stream-dedup")
    s = _events_stream(spark, d, root)
    J.complete_to_table(J.distinct_per_level(s, "user_id", "event_type"), f"{root}/out",
                        f"{root}/ckpt")
    return spark.read.parquet(f"{root}/out")


@query("stream_dedup_watermark", ops=("STR-7", "STR-6"), sql="""
SELECT event_type, COUNT(DISTINCT user_id) AS distinct_keys FROM events GROUP BY event_type""")
def q_stream_dedup_wm(spark, d):
    root = scratch_path(spark, "stream-dedup-wm")
    s = _events_stream(spark, d, root)
    # the events span one month, so a 40-day delay holds every repeat
    agg = J.distinct_per_level_bounded(s, "user_id", "event_type", "ts", "40 days")
    J.complete_to_table(agg, f"{root}/out", f"{root}/ckpt")
    return spark.read.parquet(f"{root}/out")


STREAM_SCORED_SQL = f"""
sc AS (
  SELECT TRY_CAST(encounter_id AS BIGINT) AS visit_id, TRY_CAST(patient_nbr AS BIGINT) AS patient_id,
         TRY_CAST(COALESCE({G.safe_double('time_in_hospital')}, 0) AS INTEGER) AS los,
         TRY_CAST(COALESCE({G.safe_double('num_medications')}, 0) AS INTEGER) AS meds,
         COALESCE(raw, 0.5) AS risk_score,
         CASE WHEN raw IS NULL THEN 'Medium' ELSE {G.risk_level('raw', 'left')} END AS risk_level
  FROM (SELECT *, {G.heuristic_score(G.age_numeric('age'),
                                      f"COALESCE({G.safe_double('number_inpatient')}, 0)",
                                      f"COALESCE({G.safe_double('num_medications')}, 0)")} AS raw
        FROM enc))"""


ARRIVALS, PER_BATCH = 6, 3


def _run_live(spark, root):
    J.live_pipeline(spark, f"{root}/in", f"{root}/wh", f"{root}/ckpt", max_files=PER_BATCH * J.files_per_arrival(spark, PER_BATCH))


def _live(spark, d):
    root = scratch_path(spark, "live")
    J.land_files(T.encounters(spark, d), f"{root}/in", ARRIVALS * J.files_per_arrival(spark, PER_BATCH),
                 ["admitted_at", "encounter_id"])
    _run_live(spark, root)
    return root


@query("stream_gold_refresh", ops=("STR-1", "STR-2", "STR-3", "STR-4", "SNK-4", "SNK-5", "SRC-7"),
       sql=G.with_ctes(G.ENC, f"""
SELECT risk_level, COUNT(DISTINCT patient_id) AS patient_count,
       {G.rnd('COUNT(DISTINCT patient_id) * 100.0 / NULLIF(t.total, 0)', 1)} AS percentage
FROM sc, (SELECT COUNT(DISTINCT patient_id) AS total FROM sc) t GROUP BY risk_level, t.total""",
                       STREAM_SCORED_SQL))
def q_stream_gold(spark, d):
    root = _live(spark, d)
    return J.read_gold(spark, f"{root}/wh", "gold_risk_distribution")


@query("stream_kpis", ops=("STR-4", "AGG-1", "STR-3"), sql=G.with_ctes(G.ENC, f"""
SELECT COUNT(DISTINCT patient_id) AS total_patients,
       COUNT(DISTINCT CASE WHEN risk_level = 'High' THEN patient_id END) AS high_risk_patients,
       {G.rnd("COUNT(DISTINCT CASE WHEN risk_level = 'High' THEN patient_id END) * 100.0 / NULLIF(COUNT(DISTINCT patient_id), 0)", 1)}
         AS high_risk_rate,
       {G.rnd('AVG(risk_score)', 4)} AS avg_risk_score,
       {G.rnd('AVG(los)', 1)} AS avg_length_of_stay,
       {G.rnd('AVG(meds)', 1)} AS avg_medications
FROM sc""", STREAM_SCORED_SQL))
def q_stream_kpis(spark, d):
    root = _live(spark, d)
    return J.read_gold(spark, f"{root}/wh", "gold_hospital_kpis")


@query("stream_replay", ops=("STR-8", "SNK-5", "STR-3"), sql=G.with_ctes(G.ENC, """
SELECT COUNT(*) AS fact_rows, COUNT(DISTINCT visit_id) AS visits,
       COUNT(*) AS prediction_rows,
       (SELECT COUNT(DISTINCT patient_id) FROM sc) AS dim_patients,
       (SELECT COUNT(DISTINCT patient_id) FROM sc) AS kpi_patients
FROM sc""", STREAM_SCORED_SQL))
def q_stream_replay(spark, d):
    root = _live(spark, d)
    # restart on the same checkpoint: nothing new, nothing written twice
    _run_live(spark, root)
    # replay of an already processed batch id replaces its own partition only
    first = spark.read.parquet(f"{root}/wh/fact").where(F.col("batch_id") == 0).select("visit_id")
    batch0 = spark.read.parquet(f"{root}/in").join(
        first.select(F.col("visit_id").cast("string").alias("encounter_id")).hint("merge"), "encounter_id",
        "left_semi")
    J.live_batch(f"{root}/wh")(batch0, 0)
    fact = spark.read.parquet(f"{root}/wh/fact")
    dims = spark.read.parquet(f"{root}/wh/dim_patient")
    kpis = J.read_gold(spark, f"{root}/wh", "gold_hospital_kpis")
    preds = spark.read.parquet(f"{root}/wh/model_predictions")
    return (fact.agg(F.count(F.lit(1)).alias("fact_rows"),
                     F.countDistinct("visit_id").alias("visits"))
            .crossJoin(preds.agg(F.count(F.lit(1)).alias("prediction_rows")))
            .crossJoin(dims.agg(F.count(F.lit(1)).alias("dim_patients")))
            .crossJoin(kpis.select(F.col("total_patients").alias("kpi_patients"))))



# ------------------------------------------------------------------ STR-2: a fitted model on the stream
SWAP_DAY = "1995-07-01"
LIVE_NUMBERS = ("number_inpatient", "number_outpatient", "number_emergency", "num_medications",
                "num_lab_procedures", "time_in_hospital")


@query("stream_model_swap", ops=("STR-2", "SNK-5", "SNK-13", "ENC-3", "SCO-3"), sql=linear_sql(f"""
SELECT visit_id, model_version, risk_score, {G.risk_level("risk_score", "left")} AS risk_level,
       {G.rnd_even("risk_score * 100.0", 1)} AS risk_percentage
FROM (SELECT visit_id, CASE WHEN late THEN 'fitted' ELSE 'start' END AS model_version,
             {G.rnd_even(f"1.0 / (1.0 + exp(-(CASE WHEN late THEN {MARGIN_SQL} ELSE {FIXED_BIAS} + {LINEAR_SQL} END)))", 4)}
               AS risk_score
      FROM live, fitted)""").replace("\nSELECT visit_id, model_version", f""", live AS (
  SELECT visit_id, late, age_numeric, {", ".join(LIVE_NUMBERS)},
         number_inpatient + number_outpatient + number_emergency AS total_visits, medication_change, insulin_flag,
         CASE WHEN num_lab_procedures > p75 THEN 1 ELSE 0 END AS high_lab_procedures
  FROM (SELECT TRY_CAST(encounter_id AS BIGINT) AS visit_id, admitted_at >= TIMESTAMP '{SWAP_DAY}' AS late,
               CAST({G.lookup('age', K.AGE_MAP, K.AGE_DEFAULT)} AS DOUBLE) AS age_numeric,
               {", ".join(f"COALESCE({G.safe_double(c)}, 0) AS {c}" for c in LIVE_NUMBERS)},
               CASE WHEN change = 'Ch' THEN 1 ELSE 0 END AS medication_change,
               CASE WHEN insulin = 'No' THEN 0 ELSE 1 END AS insulin_flag FROM enc),
       (SELECT quantile_cont(num_lab_procedures, 0.75) AS p75 FROM clean))
SELECT visit_id, model_version""", 1))
def q_stream_model_swap(spark, d):
    """Records up to a day are scored live by a first model, those from that day on by the
    fitted one, published while the stream's checkpoint stays."""
    enc = T.encounters(spark, d)
    cleaned = clean(enc, keep_ids=True)
    cut = fit_params(cleaned).first()["lab_threshold"]
    root = scratch_path(spark, "live-model")
    registry = f"{root}/registry"
    late = F.col("admitted_at") >= F.lit(SWAP_DAY).cast("timestamp")

    per = J.files_per_arrival(spark, 2)

    def arrive(rows):
        rows.repartitionByRange(2 * per, "admitted_at", "encounter_id").write.mode("append").parquet(f"{root}/in")
        J.live_pipeline(spark, f"{root}/in", f"{root}/wh", f"{root}/ckpt", max_files=4 * per, registry=registry)

    M.publish(spark, registry, "start", LinearModel(tuple(FIXED), tuple(FIXED.values()), FIXED_BIAS, 0, 0.0), list(FIXED))
    arrive(enc.where(~late))
    fitted, _, _ = linear_model(spark, d, engineer(cleaned, cut))
    M.publish(spark, registry, "fitted", fitted, FEATURES, cut)
    arrive(enc.where(late))
    return spark.read.parquet(f"{root}/wh/model_predictions").select(
        F.col("prediction_id").alias("visit_id"), "model_version", "risk_score", "risk_level", "risk_percentage")


@query("stream_latest_level", ops=("STR-5", "STR-7", "STR-6"), sql="""
SELECT level, COUNT(*) AS n
FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS level FROM events
      WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL GROUP BY user_id) GROUP BY level""")
def q_stream_latest(spark, d):
    """Users by the type of their latest event, kept by a keyed state."""
    root = scratch_path(spark, "stream-latest")
    s = _events_stream(spark, d, root)
    L.run_latest(L.changes(s, "user_id", "event_type", "ts", "event_id"), root, f"{root}/ckpt")
    return L.counts(spark, root)
