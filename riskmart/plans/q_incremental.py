"""Layers kept current by three landed batches, against the full rebuild in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as T
from ..session import app_id, scratch_path
from . import incremental as I
from . import sqlgen as G
from . import warehouse as W
from .registry import query

BATCHES = 3
_ROOTS: dict[tuple[str, str], str] = {}


def landed(spark, d) -> str:
    """Layers after three batches and a second run of the middle one. A patient's
    encounters are dealt over the batches by a hash, so earlier ones come late."""
    key = (app_id(spark), d.rstrip("/"))
    if key not in _ROOTS:
        root = scratch_path(spark, "incremental")
        raw = T.encounters(spark, d)
        deal = F.pmod(F.xxhash64("encounter_id"), F.lit(BATCHES))
        for i in (*range(BATCHES), 1):
            I.apply_batch(raw.where(deal == i), root, i)
        _ROOTS[key] = root
    return _ROOTS[key]


@query("incremental_silver", ops=("JOB-4", "AGG-17", "SCA-10", "STR-3"), sql=G.with_ctes(G.SILVER, """
SELECT * FROM silver"""))
def q_incremental_silver(spark, d):
    return I.read_layer(spark, landed(spark, d), "silver")


@query("incremental_fact", ops=("JOB-6", "STR-3"), sql=G.with_ctes(G.MART, """
SELECT patient_id, visit_id, risk_score, risk_level, readmitted_binary FROM fact"""))
def q_incremental_fact(spark, d):
    return I.read_layer(spark, landed(spark, d), "fact")


@query("incremental_summary", ops=("JOB-7", "JOI-2"), sql=G.with_ctes(
    G.MART, "SELECT " + ", ".join(W.SUMMARY_COLUMNS) + " FROM gold"))
def q_incremental_summary(spark, d):
    return I.read_layer(spark, landed(spark, d), "gold_patient_risk_summary")


@query("incremental_kpis", ops=("JOB-7", "AGG-1", "STR-4"), sql=G.with_ctes(G.MART, f"""
SELECT COUNT(*) AS total_patients, COUNT(*) FILTER (risk_level = 'High') AS high_risk_patients,
       {G.rnd("COUNT(*) FILTER (risk_level = 'High') * 100.0 / NULLIF(COUNT(*), 0)", 1)} AS high_risk_rate,
       {G.rnd('AVG(risk_score)', 4)} AS avg_risk_score, {G.rnd('AVG(time_in_hospital)', 1)} AS avg_length_of_stay,
       {G.rnd('AVG(num_medications)', 1)} AS avg_medications FROM gold"""))
def q_incremental_kpis(spark, d):
    return I.read_layer(spark, landed(spark, d), "gold_hospital_kpis")


@query("incremental_distribution", ops=("JOB-7", "AGG-4", "STR-5"), sql=G.with_ctes(G.MART, f"""
SELECT risk_level, COUNT(*) AS patient_count,
       {G.rnd('COUNT(*) * 100.0 / NULLIF((SELECT COUNT(*) FROM gold), 0)', 1)} AS percentage
FROM gold GROUP BY risk_level"""))
def q_incremental_distribution(spark, d):
    return I.read_layer(spark, landed(spark, d), "gold_risk_distribution")
