"""Queries over the encounter adapter and the warehouse layers (minimum slice,
scalars, star/gold)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as T
from ..functions import constants as K
from ..functions import scalars as S
from ..operators.sequence import first_per_key
from . import sqlgen as G
from . import warehouse as W
from .registry import query


# ------------------------------------------------------------------ minimum slice
def risk_by_age_gender(gold):
    """AGG-8: mean risk, patients and high-risk patients per age group and gender."""
    return (gold.where(F.col("age_group").isNotNull() & F.col("gender").isNotNull())
            .groupBy("age_group", "gender")
            .agg(F.avg("risk_score").alias("avg_risk"),
                 F.count(F.lit(1)).alias("patient_count"),
                 F.sum(S.equals_flag("risk_level", "High")).cast("long").alias("high_risk_count")))


@query("group_age_gender", ops=("AGG-8", "WIN-1", "SCA-1", "SCA-2", "SCA-3", "SCA-5", "SCA-6",
                                "SCA-14", "SCO-2", "JOI-2"),
       sql=G.with_ctes(G.MART, """
SELECT age_group, gender, AVG(risk_score) AS avg_risk, COUNT(*) AS patient_count,
       CAST(SUM(CASE WHEN risk_level = 'High' THEN 1 ELSE 0 END) AS BIGINT) AS high_risk_count
FROM gold WHERE age_group IS NOT NULL AND gender IS NOT NULL
GROUP BY age_group, gender"""))
def q_group_age_gender(spark, d):
    return risk_by_age_gender(T.mart(spark, d)["gold_patient_risk_summary"])


# ------------------------------------------------------------------ WIN-1
@query("dedup_first_per_key", ops=("WIN-1",), sql="""
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
  SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice,
         ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
  FROM orders) WHERE rn = 1""")
def q_dedup(spark, d):
    o = T.load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return first_per_key(o, "o_custkey", ["o_orderdate", "o_orderkey"])


@query("latest_per_key", ops=("WIN-1",), sql="""
SELECT o_custkey, o_orderkey, o_orderdate FROM (
  SELECT o_custkey, o_orderkey, o_orderdate,
         ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders) WHERE rn = 1""")
def q_latest(spark, d):
    o = T.load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return first_per_key(o, "o_custkey", ["o_orderdate", "o_orderkey"], descending=True)


# ------------------------------------------------------------------ encounter adapter
@query("encounters_adapter", ops=("SRC-8",), sql=G.with_ctes(G.ENC, "SELECT * FROM enc"))
def q_enc(spark, d):
    # the full derivation from the provided tables, not the landed copy
    return T.encounters_lazy(spark, d)


# ------------------------------------------------------------------ scalars
@query("code_category", ops=("SCA-1", "SCA-21"), sql=G.with_ctes(G.ENC, f"""
SELECT encounter_id, diag_1, {G.code_category('diag_1')} AS diag_category FROM enc"""))
def q_code_category(spark, d):
    e = T.encounters(spark, d)
    return e.select("encounter_id", "diag_1", S.code_category("diag_1").alias("diag_category"))


@query("age_bucket_lookup", ops=("SCA-2", "SCA-3"), sql=G.with_ctes(G.ENC, f"""
SELECT age, {G.age_numeric('age')} AS age_numeric,
       {G.bins(G.age_numeric('age'), K.AGE_EDGES, K.AGE_LABELS)} AS age_group,
       COUNT(*) AS n
FROM enc GROUP BY ALL"""))
def q_age_lookup(spark, d):
    e = T.encounters(spark, d)
    a = S.age_numeric("age")
    return (e.groupBy("age", a.alias("age_numeric"), S.age_group(a).alias("age_group"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("bin_labels_right", ops=("SCA-4", "SCA-3"), sql=f"""
SELECT p_partkey, p_size,
       {G.bins('p_size', K.MED_EDGES, K.MED_LABELS)} AS size_bin,
       {G.bins('p_size', [0, 10, 20, 30, 40, 50], ['a', 'b', 'c', 'd', 'e'])} AS size_band
FROM part""")
def q_bin_right(spark, d):
    p = T.load(spark, d, "part")
    return p.select("p_partkey", "p_size", S.medication_bin("p_size").alias("size_bin"),
                    S.bin_labels("p_size", [0, 10, 20, 30, 40, 50],
                                 ["a", "b", "c", "d", "e"]).alias("size_band"))


@query("bin_labels_left", ops=("SCA-5", "SCA-25"), sql=f"""
SELECT event_id, value,
       {G.risk_level('value / 100.0', 'left')} AS level_left,
       {G.risk_level('value / 100.0', 'right')} AS level_right,
       CASE WHEN value / 100.0 > 0.6 THEN 'high' WHEN value / 100.0 > 0.3 THEN 'medium'
            WHEN value IS NOT NULL THEN 'low' END AS severity
FROM events""")
def q_bin_left(spark, d):
    e = T.load(spark, d, "events")
    r = F.col("value") / F.lit(100.0)
    return e.select("event_id", "value", S.risk_level(r, "left").alias("level_left"),
                    S.risk_level(r, "right").alias("level_right"),
                    S.severity_band(r).alias("severity"))


@query("flags_row_sum", ops=("SCA-6", "SCA-7", "SCA-8", "SCA-9", "SCA-14", "SCA-15"),
       sql=G.with_ctes(G.ENC, f"""
SELECT encounter_id,
  CASE WHEN COALESCE(readmitted, '') = '<30' THEN 1 ELSE 0 END AS readmit_flag,
  CASE WHEN insulin IN ('Up', 'Down') THEN 1 ELSE 0 END AS insulin_changed,
  CASE WHEN insulin = 'No' THEN 0 ELSE 1 END AS insulin_active,
  CASE WHEN change = 'Ch' THEN 1 ELSE 0 END AS medication_change,
  COALESCE({G.safe_double('number_inpatient')}, 0) + COALESCE({G.safe_double('number_outpatient')}, 0)
    + COALESCE({G.safe_double('number_emergency')}, 0) AS total_visits,
  (CASE WHEN {G.code_category('diag_1')} <> 'Other' THEN 1 ELSE 0 END)
    + (CASE WHEN race <> '?' THEN 1 ELSE 0 END) AS n_known
FROM enc"""))
def q_flags(spark, d):
    e = T.encounters(spark, d)
    return e.select(
        "encounter_id",
        S.readmit_flag("readmitted").alias("readmit_flag"),
        S.member_flag("insulin", ["Up", "Down"]).alias("insulin_changed"),
        S.not_no_flag("insulin").alias("insulin_active"),
        S.equals_flag("change", "Ch").alias("medication_change"),
        S.row_sum([S.safe_number(c, None) for c in K.VISIT_COLUMNS]).alias("total_visits"),
        S.count_true([S.code_category("diag_1") != "Other", F.col("race") != "?"]).alias("n_known"),
    )


@query("above_p75_flag", ops=("SCA-10", "AGG-17"), sql="""
SELECT l_orderkey, l_linenumber, l_quantity,
       CASE WHEN l_quantity > t.p THEN 1 ELSE 0 END AS high_quantity, t.p AS threshold
FROM lineitem, (SELECT quantile_cont(l_quantity, 0.75) AS p FROM lineitem) t""")
def q_p75(spark, d):
    li = T.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    t = W.quantile_threshold(li, "l_quantity", 0.75, "threshold")
    return (li.crossJoin(F.broadcast(t))
            .withColumn("high_quantity", S.above_flag("l_quantity", F.col("threshold")))
            .select("l_orderkey", "l_linenumber", "l_quantity", "high_quantity", "threshold"))


@query("safe_numeric_parse", ops=("SCA-12", "SCA-13"), sql=f"""
SELECT event_id,
  COALESCE({G.safe_double("regexp_extract(props, ':\\s*([^}}]*)', 1)")}, 0) AS k_value,
  COALESCE({G.safe_double("CAST(value AS VARCHAR) || 'x'")}, 0) AS bad_text,
  CAST(TRUNC(value) AS INTEGER) AS value_int, CAST(value > 50 AS VARCHAR) AS flag_text
FROM events""")
def q_safe_parse(spark, d):
    e = T.load(spark, d, "events")
    field = F.regexp_extract("props", r":\s*([^}]*)", 1)
    return e.select(
        "event_id",
        S.safe_number(field, 0).alias("k_value"),
        S.safe_number(F.concat(F.col("value").cast("string"), F.lit("x")), 0).alias("bad_text"),
        F.col("value").cast("int").alias("value_int"),
        (F.col("value") > 50).cast("string").alias("flag_text"),
    )


@query("clip_ratio_round", ops=("SCA-16", "SCA-17", "SCA-18", "SCA-19"), sql=f"""
SELECT c_custkey,
  greatest(0.01::DOUBLE, least(0.99::DOUBLE, c_acctbal / 10000.0)) AS clipped,
  {G.rnd('c_acctbal / 7.0', 1)} AS rounded,
  least(c_nationkey / 5.0, 1.0::DOUBLE) AS capped,
  CAST(c_acctbal AS DOUBLE) / NULLIF(c_nationkey, 0) AS per_nation
FROM customer""")
def q_clip(spark, d):
    c = T.load(spark, d, "customer")
    return c.select(
        "c_custkey",
        S.clip(F.col("c_acctbal") / F.lit(10000.0), 0.01, 0.99).alias("clipped"),
        F.round(F.col("c_acctbal") / F.lit(7.0), 1).alias("rounded"),
        S.capped_ratio("c_nationkey").alias("capped"),
        S.safe_ratio("c_acctbal", "c_nationkey").alias("per_nation"),
    )


# ------------------------------------------------------------------ layers
@query("silver_job", ops=("JOB-4", "SCA-12", "SCA-13", "PRJ-1", "PRJ-2"),
       sql=G.with_ctes(G.SILVER, "SELECT * FROM silver"))
def q_silver(spark, d):
    # the silver job itself, not the stored layer
    return T.mart_lazy(spark, d)["silver"]


@query("dims", ops=("JOB-5", "SET-2", "AGG-21"),
       sql=G.with_ctes(G.MART, """
SELECT 'patient' AS dim, COUNT(*) AS n_rows, COUNT(DISTINCT patient_id) AS n_keys FROM dim_patient
UNION ALL
SELECT 'visit', COUNT(*), COUNT(DISTINCT visit_id) FROM dim_visit_metrics"""))
def q_dims(spark, d):
    m = T.mart(spark, d)
    p = m["dim_patient"].agg(F.lit("patient").alias("dim"), F.count(F.lit(1)).alias("n_rows"),
                             F.countDistinct("patient_id").alias("n_keys"))
    v = m["dim_visit_metrics"].agg(F.lit("visit").alias("dim"), F.count(F.lit(1)).alias("n_rows"),
                                   F.countDistinct("visit_id").alias("n_keys"))
    return p.unionByName(v)


@query("fact", ops=("JOB-6", "JOI-1", "JOI-6", "SNK-10", "WIN-2", "SCO-2"),
       sql=G.with_ctes(G.MART, "SELECT * FROM fact"))
def q_fact(spark, d):
    # the fact job itself (dense surrogate ids), not the stored layer
    return T.mart_lazy(spark, d, with_id=True)["fact"]


@query("star_summary", ops=("JOI-2", "JOB-7"), sql=G.with_ctes(G.MART, "SELECT * FROM gold"))
def q_star(spark, d):
    return T.mart(spark, d)["gold_patient_risk_summary"]


@query("kpi_row", ops=("AGG-1", "JOB-7"), sql=G.with_ctes(G.MART, f"""
SELECT COUNT(DISTINCT f.patient_id) AS total_patients,
  COUNT(DISTINCT CASE WHEN f.risk_level = 'High' THEN f.patient_id END) AS high_risk_patients,
  {G.rnd("COUNT(DISTINCT CASE WHEN f.risk_level = 'High' THEN f.patient_id END) * 100.0 / NULLIF(COUNT(DISTINCT f.patient_id), 0)", 1)} AS high_risk_rate,
  {G.rnd('AVG(f.risk_score)', 4)} AS avg_risk_score,
  {G.rnd('AVG(dv.time_in_hospital)', 1)} AS avg_length_of_stay,
  {G.rnd('AVG(dv.num_medications)', 1)} AS avg_medications
FROM fact f LEFT JOIN dim_visit_metrics dv ON f.visit_id = dv.visit_id"""))
def q_kpi(spark, d):
    return T.mart(spark, d)["gold_hospital_kpis"]


@query("band_distribution", ops=("AGG-4", "JOI-4"), sql=G.with_ctes(G.MART, f"""
SELECT f.risk_level, COUNT(DISTINCT f.patient_id) AS patient_count,
       {G.rnd('COUNT(DISTINCT f.patient_id) * 100.0 / NULLIF(t.total, 0)', 1)} AS percentage
FROM fact f, (SELECT COUNT(DISTINCT patient_id) AS total FROM fact) t
GROUP BY f.risk_level, t.total""", ))
def q_band(spark, d):
    return T.mart(spark, d)["gold_risk_distribution"]
