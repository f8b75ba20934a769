"""Queries for the composite jobs, sources and sinks (files are written under
the session's shared checkpoint folder and read back)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import tables as T
from ..functions import constants as K
from ..operators import ml as ML
from ..session import scratch_path
from ..sources import quarantine as Q
from ..sources import readers as R
from ..sources import sinks as SK
from . import operational as O
from . import sqlgen as G
from .features import clean, engineer
from .registry import query

# ------------------------------------------------------------------ SQL forms of the jobs
_TEXT = ["race", "gender", "age", "insulin", "change", "readmitted", "diag_1"]
_NUM = ["time_in_hospital", "num_lab_procedures", "num_medications", "number_inpatient",
        "number_outpatient", "number_emergency"]
_TOKENS = ", ".join(G.q(t) for t in K.NULL_TOKENS)


def _mode(col: str, src: str) -> str:
    return (f"COALESCE((SELECT {col} FROM {src} WHERE {col} IS NOT NULL GROUP BY {col} "
            f"ORDER BY COUNT(*) DESC, {col} LIMIT 1), 'Unknown')")


def clean_sql(keep_ids: bool) -> str:
    text_out = ["race", "gender", "age"]
    ids = "encounter_id, patient_nbr, " if keep_ids else ""
    return f"""
c0 AS (
  SELECT encounter_id, patient_nbr,
    {", ".join(f"CASE WHEN {c} IN ({_TOKENS}) THEN NULL ELSE {c} END AS {c}" for c in _TEXT)},
    {", ".join(f"{G.safe_double(c)} AS {c}" for c in _NUM)},
    admitted_at
  FROM enc),
c1 AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY patient_nbr
                 ORDER BY admitted_at, TRY_CAST(encounter_id AS BIGINT)) AS rn FROM c0)
  WHERE rn = 1),
c2 AS (
  SELECT {ids}race, gender, age, {", ".join(_NUM)}, insulin, change, admitted_at,
         CASE WHEN readmitted = '<30' THEN 1 ELSE 0 END AS readmitted_binary,
         {G.code_category('diag_1')} AS diag_1_category
  FROM c1),
cst AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in _NUM)} FROM c2),
clean AS (
  SELECT {ids}{", ".join(f"COALESCE({c}, {_mode(c, 'c2')}) AS {c}" for c in text_out)},
    {", ".join(f"COALESCE({c}, m_{c}) AS {c}" for c in _NUM)},
    COALESCE(insulin, {_mode('insulin', 'c2')}) AS insulin,
    COALESCE(change, {_mode('change', 'c2')}) AS change,
    admitted_at, readmitted_binary,
    COALESCE(diag_1_category, {_mode('diag_1_category', 'c2')}) AS diag_1_category
  FROM c2, cst)"""


FEATURES_SQL = f"""
feat AS (
  SELECT * EXCLUDE (p75),
    COALESCE(number_inpatient, 0) + COALESCE(number_outpatient, 0)
      + COALESCE(number_emergency, 0) AS total_visits,
    CASE WHEN change = 'Ch' THEN 1 ELSE 0 END AS medication_change,
    CASE WHEN num_lab_procedures > p75 THEN 1 ELSE 0 END AS high_lab_procedures,
    CAST({G.lookup('age', K.AGE_MAP, K.AGE_DEFAULT)} AS DOUBLE) AS age_numeric,
    {G.bins('num_medications', K.MED_EDGES, K.MED_LABELS)} AS num_medications_bin,
    CASE WHEN insulin = 'No' THEN 0 ELSE 1 END AS insulin_flag,
    CASE WHEN insulin = 'No' THEN 0 ELSE 1 END AS total_medications_active,
    CASE WHEN diag_1_category <> 'Other' THEN 1 ELSE 0 END AS num_diagnoses
  FROM clean, (SELECT quantile_cont(num_lab_procedures, 0.75) AS p75 FROM clean))"""


def features_df(spark, d, keep_ids=False):
    # clean() already ends on a stored copy plus literal fills, so the feature
    # quantile can re-read it cheaply instead of writing a second copy
    return engineer(clean(T.encounters(spark, d), keep_ids=keep_ids), materialize_rows=False)


ENCODED = ["race", "gender", "age", "diag_1_category", "change", "num_medications_bin"]


# ------------------------------------------------------------------ JOB-1..3, ENC
@query("clean_job", ops=("JOB-1", "PRJ-3", "PRJ-4", "AGG-18", "AGG-19", "SRC-1"),
       sql=G.with_ctes(G.ENC, "SELECT * FROM clean", clean_sql(False)))
def q_clean(spark, d):
    return clean(T.encounters(spark, d))


@query("feature_job", ops=("JOB-2", "SCA-2", "SCA-4", "SCA-8", "SCA-9", "SCA-10", "SCA-14",
                           "SCA-15"),
       sql=G.with_ctes(G.ENC, "SELECT * FROM feat", clean_sql(False) + "," + FEATURES_SQL))
def q_features(spark, d):
    return features_df(spark, d)


@query("label_encode", ops=("ENC-1", "ENC-2"), sql=G.with_ctes(
    G.ENC, "SELECT " + ", ".join(
        "CAST(DENSE_RANK() OVER (ORDER BY CASE WHEN TRY_CAST(encounter_id AS BIGINT) % 7 != 0 "
        f"THEN COALESCE(CAST({c} AS VARCHAR), 'nan') ELSE 'nan' END) - 1 AS DOUBLE) AS {c}_idx"
        for c in ENCODED) + ", readmitted_binary FROM feat",
    clean_sql(True) + "," + FEATURES_SQL))
def q_label_encode(spark, d):
    f = features_df(spark, d, keep_ids=True)
    # nulls are injected, since the source tables hold none
    f = f.select(*[F.when(F.col("encounter_id").try_cast("long") % 7 != 0, F.col(c)).alias(c)
                   if c in ENCODED else F.col(c) for c in f.columns])
    f = ML.nan_text(f, ENCODED)
    return ML.label_encoder(ENCODED).fit(f).transform(f).select(
        *[f"{c}_idx" for c in ENCODED], "readmitted_binary")


@query("apply_encoders", ops=("ENC-2", "ENC-1", "TOP-11"), sql=G.with_ctes(G.ENC, f"""
SELECT f.encounter_id,
       COALESCE(r.race_idx, 0.0) AS race_idx, COALESCE(a.age_idx, 0.0) AS age_idx
FROM feat f
LEFT JOIN (SELECT race, CAST(DENSE_RANK() OVER (ORDER BY race) - 1 AS DOUBLE) AS race_idx
           FROM (SELECT DISTINCT COALESCE(race, 'nan') AS race FROM feat
                 WHERE {G.hash_rank('TRY_CAST(encounter_id AS BIGINT)')} % 1000 < 800))
  r ON COALESCE(f.race, 'nan') = r.race
LEFT JOIN (SELECT age, CAST(DENSE_RANK() OVER (ORDER BY age) - 1 AS DOUBLE) AS age_idx
           FROM (SELECT DISTINCT COALESCE(age, 'nan') AS age FROM feat
                 WHERE {G.hash_rank('TRY_CAST(encounter_id AS BIGINT)')} % 1000 < 800))
  a ON COALESCE(f.age, 'nan') = a.age""", clean_sql(True) + "," + FEATURES_SQL))
def q_apply_encoders(spark, d):
    from ..operators.topk import hash_split
    f = ML.nan_text(features_df(spark, d, keep_ids=True), ["race", "age"])
    f = hash_split(f, F.col("encounter_id").try_cast("long"), 800, 42)
    model = ML.label_encoder(["race", "age"]).fit(f.where(F.col("split") == "train"))
    out = ML.unknown_to_zero(model.transform(f), model, ["race", "age"])
    return out.select("encounter_id", "race_idx", "age_idx")


MODEL_FEATURES = ["age_numeric", "number_inpatient", "num_medications", "time_in_hospital",
                  "number_diagnoses", "total_visits"]


@query("model_frame", ops=("ENC-3", "PRJ-2"), sql=G.with_ctes(
    G.ENC, "SELECT age_numeric, number_inpatient, num_medications, time_in_hospital, "
    "0.0::DOUBLE AS number_diagnoses, total_visits FROM feat",
    clean_sql(False) + "," + FEATURES_SQL))
def q_model_frame(spark, d):
    from ..operators.shape import align
    return align(features_df(spark, d), MODEL_FEATURES, {"number_diagnoses": 0.0}, "double")


@query("feature_exports", ops=("JOB-3", "SNK-6", "SNK-13", "SCA-10"), sql=G.with_ctes(
    G.ENC, """SELECT COUNT(*) AS n_rows, SUM(readmitted_binary) AS positives,
                     SUM(high_lab_procedures) AS high_lab_rows,
                     (SELECT quantile_cont(num_lab_procedures, 0.75) FROM clean) AS lab_threshold
              FROM feat""",
    clean_sql(False) + "," + FEATURES_SQL))
def q_feature_exports(spark, d):
    from .features import fit_params
    root = scratch_path(spark, "features")
    cleaned = clean(T.encounters(spark, d))
    # fit-time parameters are stored with the encoders and reused when scoring
    fit_params(cleaned).write.mode("overwrite").parquet(f"{root}/models/params")
    threshold = spark.read.parquet(f"{root}/models/params").first()["lab_threshold"]
    f = engineer(cleaned, lab_threshold=threshold)
    SK.export_csv(f, f"{root}/processed/readable")
    text = ML.nan_text(f, ENCODED)
    model = ML.label_encoder(ENCODED).fit(text)
    SK.save_model(model, f"{root}/models/encoders")
    # scoring reads the stored encoders, as a later run would
    enc = SK.load_model(f"{root}/models/encoders").transform(text).drop(*ENCODED)
    SK.export_csv(ML.drop_text_columns(enc), f"{root}/processed/encoded")
    back = spark.read.option("header", True).csv(f"{root}/processed/encoded")
    return back.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.sum(F.col("readmitted_binary").cast("long")).alias("positives"),
                    F.sum(F.col("high_lab_procedures").cast("long")).alias("high_lab_rows"),
                    F.lit(threshold).cast("double").alias("lab_threshold"))


# ------------------------------------------------------------------ JOB-10/11
def operational(spark, d):
    return O.operational_tables(features_df(spark, d, keep_ids=True))


OPS_SQL = f"""
ops AS (
  SELECT TRY_CAST(encounter_id AS BIGINT) AS prediction_id,
         TRY_CAST(patient_nbr AS BIGINT) AS patient_id,
         {G.heuristic_score('age_numeric', 'number_inpatient', 'num_medications')} AS risk_score,
         CAST(readmitted_binary AS INTEGER) AS actual_readmitted,
         CAST(age_numeric AS INTEGER) AS age,
         {G.bins('age_numeric', K.AGE_EDGES, K.AGE_LABELS)} AS age_group, gender, race,
         CAST(num_medications AS INTEGER) AS num_medications,
         CAST(num_lab_procedures AS INTEGER) AS num_lab_procedures,
         CAST(time_in_hospital AS INTEGER) AS time_in_hospital, diag_1_category
  FROM feat)"""


@query("operational_load", ops=("JOB-10", "SCO-1", "PRJ-1", "PRJ-2", "PRJ-6", "SNK-11"),
       sql=G.with_ctes(G.ENC, f"""
SELECT prediction_id, patient_id, risk_score, {G.rnd_even('risk_score * 100', 1)} AS risk_percentage,
       {G.risk_level('risk_score')} AS risk_level, actual_readmitted,
       '{O.TOP_FACTORS}' AS top_factors, '{K.MODEL_VERSION}' AS model_version
FROM ops""", clean_sql(True) + "," + FEATURES_SQL + "," + OPS_SQL))
def q_operational(spark, d):
    return operational(spark, d)["model_predictions"].drop("predicted_at")


@query("bi_exports", ops=("JOB-11", "SNK-7", "SNK-6", "AGG-8"), sql=G.with_ctes(G.ENC, f"""
SELECT age_group, gender, AVG(risk_score) AS avg_risk, COUNT(patient_id) AS patient_count,
       CAST(SUM(CASE WHEN {G.risk_level('risk_score')} = 'High' THEN 1 ELSE 0 END) AS BIGINT)
         AS high_risk_count
FROM ops WHERE age_group IS NOT NULL AND gender IS NOT NULL GROUP BY age_group, gender""",
    clean_sql(True) + "," + FEATURES_SQL + "," + OPS_SQL))
def q_bi(spark, d):
    t = operational(spark, d)
    root = scratch_path(spark, "bi")
    out = O.bi_exports(t["patients"], t["model_predictions"], T.encounters(spark, d))
    for name, df in out.items():
        SK.export_csv(df, f"{root}/{name}")
    schema = "age_group string, gender string, avg_risk double, patient_count long, " \
             "high_risk_count long"
    return spark.read.option("header", True).schema(schema).csv(f"{root}/risk_by_demographics")


@query("readmission_trends", ops=("AGG-29", "SNK-7"), sql=G.with_ctes(G.ENC, f"""
SELECT CAST(date_trunc('month', admitted_at) AS DATE) AS month, COUNT(*) AS total_patients,
       COUNT(CASE WHEN readmitted = '<30' THEN 1 END) AS readmissions,
       {G.share_even("COUNT(CASE WHEN readmitted = '<30' THEN 1 END)", "COUNT(*)", 1)}
         AS readmission_rate
FROM enc GROUP BY 1"""))
def q_trends(spark, d):
    t = operational(spark, d)
    return O.bi_exports(t["patients"], t["model_predictions"],
                        T.encounters(spark, d))["readmission_trends"]


@query("tableau_master", ops=("SNK-8", "JOI-3", "PRJ-5"), sql=G.with_ctes(G.ENC, """
SELECT COUNT(*) AS n_rows, COUNT(DISTINCT patient_id) AS n_patients,
       COUNT(prediction_id) AS n_with_prediction
FROM (SELECT o.patient_id, o2.prediction_id FROM ops o JOIN ops o2
      ON o.patient_id = o2.patient_id)""",
    clean_sql(True) + "," + FEATURES_SQL + "," + OPS_SQL))
def q_tableau(spark, d):
    t = operational(spark, d)
    m = O.tableau_master(t["patients"], t["patient_visits"].drop("visit_id"),
                         t["model_predictions"])
    return m.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.countDistinct("patient_id").alias("n_patients"),
                 F.count("prediction_id").alias("n_with_prediction"))


# ------------------------------------------------------------------ medallion (JOB-4..9)
@query("bronze_load", ops=("SRC-9", "SRC-8", "SNK-1", "SNK-11"), sql=G.with_ctes(G.ENC, """
SELECT COUNT(*) AS n_rows, COUNT(DISTINCT encounter_id) AS n_encounters,
       COUNT(CASE WHEN race = '?' THEN 1 END) AS race_tokens FROM enc"""))
def q_bronze(spark, d):
    root = scratch_path(spark, "bronze")
    p = SK.write_version(R.to_bronze(T.encounters(spark, d)), root, "bronze")
    b = spark.read.parquet(p)
    return b.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.countDistinct("encounter_id").alias("n_encounters"),
                 F.count(F.when(F.col("race") == "?", 1)).alias("race_tokens"))


@query("medallion_counts", ops=("JOB-9", "AGG-22", "SNK-1", "SNK-12", "VAL-6", "WIN-2"),
       sql=G.with_ctes(G.MART, """
SELECT 'bronze_patient_visits' AS table_name, COUNT(*) AS row_count FROM enc
UNION ALL SELECT 'silver_patient_visits', COUNT(*) FROM silver
UNION ALL SELECT 'dim_patient', COUNT(*) FROM dim_patient
UNION ALL SELECT 'dim_visit_metrics', COUNT(*) FROM dim_visit_metrics
UNION ALL SELECT 'fact_patient_visits', COUNT(*) FROM fact
UNION ALL SELECT 'gold_patient_risk_summary', COUNT(*) FROM gold
UNION ALL SELECT 'gold_hospital_kpis', 1
UNION ALL SELECT 'gold_risk_distribution', COUNT(DISTINCT risk_level) FROM fact
UNION ALL SELECT 'patients', 0 UNION ALL SELECT 'patient_visits', 0
UNION ALL SELECT 'model_predictions', 0"""))
def q_medallion(spark, d):
    root = scratch_path(spark, "warehouse")
    paths = O.medallion(T.encounters(spark, d), root)
    return O.layer_counts(spark, paths)


@query("gold_refresh", ops=("JOB-7", "SNK-1"), sql=G.with_ctes(G.MART, f"""
SELECT p.patient_id, f.visit_id, f.risk_score, {G.rnd('f.risk_score * 100', 1)} AS risk_percentage,
       f.risk_level, p.age_group, v.diag_1_category
FROM fact f JOIN dim_patient p ON f.patient_id = p.patient_id
JOIN dim_visit_metrics v ON f.visit_id = v.visit_id"""))
def q_gold_refresh(spark, d):
    root = scratch_path(spark, "warehouse")
    paths = O.medallion(T.encounters(spark, d), root)
    g = spark.read.parquet(paths["gold_patient_risk_summary"])
    return g.select("patient_id", "visit_id", "risk_score", "risk_percentage", "risk_level",
                    "age_group", "diag_1_category")


@query("gold_alt", ops=("JOB-8", "AGG-2", "AGG-5", "JOI-1", "JOI-6", "SCO-2"),
       sql=G.with_ctes(G.MART, f"""
SELECT COUNT(*) AS total_patients,
       COUNT(CASE WHEN risk_level = 'High' THEN 1 END) AS high_risk_patients,
       {G.share_even("COUNT(CASE WHEN risk_level = 'High' THEN 1 END)", "COUNT(*)", 1)}
         AS high_risk_rate,
       {G.rnd_even('AVG(risk_score)', 4)} AS avg_risk_score,
       {G.rnd_even('AVG(s.time_in_hospital)', 1)} AS avg_length_of_stay,
       {G.rnd_even('AVG(s.num_medications)', 1)} AS avg_medications
FROM fact f JOIN silver s ON f.visit_id = s.visit_id"""))
def q_gold_alt(spark, d):
    return O.gold_from_silver(T.mart(spark, d)["silver"])["kpis"]


@query("fact_with_predictions", ops=("JOB-6", "JOI-1", "JOI-5", "JOI-6"),
       sql=G.with_ctes(G.ENC, f"""
SELECT s.patient_id, s.visit_id,
  COALESCE(p.risk_score, {G.fallback_score('s.age_group', 's.number_inpatient', 's.num_medications')})
    AS risk_score,
  COALESCE(p.risk_level, {G.risk_level(G.fallback_score('s.age_group', 's.number_inpatient', 's.num_medications'))})
    AS risk_level,
  s.readmitted_binary
FROM silver s LEFT JOIN (
  SELECT patient_id, risk_score, {G.risk_level('risk_score')} AS risk_level FROM ops
  WHERE patient_id IN (SELECT patient_id FROM silver WHERE number_inpatient > 0)
) p ON s.patient_id = p.patient_id""",
    G.SILVER_SQL + "," + clean_sql(True) + "," + FEATURES_SQL + "," + OPS_SQL))
def q_fact_pred(spark, d):
    from . import warehouse as W
    m = T.mart(spark, d)
    s = m["silver"]
    preds = operational(spark, d)["model_predictions"]
    # only patients with prior inpatient stays were sent to the scoring service
    sent = s.where(F.col("number_inpatient") > 0).select("patient_id")
    preds = preds.join(sent.hint("merge"), "patient_id", "left_semi")
    return W.fact(s, preds, with_id=False)


# ------------------------------------------------------------------ sources and sinks
@query("csv_round_trip", ops=("SRC-1", "SRC-2", "SNK-3", "SNK-6"), sql="""
SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END
         AS c_mktsegment, c_acctbal FROM customer""")
def q_csv(spark, d):
    root = scratch_path(spark, "csv")
    c = T.load(spark, d, "customer").select(
        "c_custkey", "c_name", "c_nationkey",
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("?")).otherwise(F.col("c_mktsegment"))
        .alias("c_mktsegment"), "c_acctbal")
    # two appends into nested folders; the reader finds both by file name
    SK.append_csv(c.where(F.col("c_nationkey") < 12), f"{root}/raw/a/customers")
    SK.append_csv(c.where(F.col("c_nationkey") >= 12), f"{root}/raw/b/customers")
    schema = ("c_custkey long, c_name string, c_nationkey int, c_mktsegment string, "
              "c_acctbal double")
    return R.read_csv(spark, f"{root}/raw", schema=schema, tokens=["?"], recursive=True,
                      name_glob="*.csv").drop("c_nationkey")


# a feed of order lines that a sender damaged: fields lost or doubled, quotes left open,
# text in the number column
_DAMAGE = (("too few fields", 11), ("too many fields", 13), ("unclosed quote", 17), ("wrong type", 19))


@query("csv_quarantine", ops=("SRC-1", "SRC-9", "VAL-7"), sql=f"""
SELECT CASE {" ".join(f"WHEN o_orderkey % {n} = 0 THEN '{r}'" for r, n in _DAMAGE)} ELSE 'row' END AS outcome,
       COUNT(*) AS n_lines, CAST(SUM(o_orderkey) AS BIGINT) AS sum_key,
       COUNT(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS n_status
FROM orders GROUP BY 1""")
def q_quarantine(spark, d):
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("string")
    quoted = F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit(', ""x"""'))
    status = F.when(F.col("o_orderstatus") == "P", "?").otherwise(F.col("o_orderstatus"))
    whole = [key.cast("string"), status, price, quoted]
    line = F.concat_ws(",", *whole)
    forms = {"too few fields": F.concat_ws(",", *whole[:3]), "too many fields": F.concat_ws(",", *whole, price),
             "unclosed quote": F.concat(line, F.lit(',"')),
             "wrong type": F.concat_ws(",", key.cast("string"), status, F.lit("n/k x"), quoted)}
    broken = line
    for r, n in reversed(_DAMAGE):
        broken = F.when(key % n == 0, forms[r]).otherwise(broken)
    path = scratch_path(spark, "csv-damaged")
    T.load(spark, d, "orders").select(broken.alias("value")).write.text(path)
    schema = "o_orderkey long, o_orderstatus string, o_totalprice double, note string"
    rows, bad = Q.read_csv_checked(spark, path, schema)
    rows = rows.select(F.lit("row").alias("outcome"), "o_orderkey", F.col("o_orderstatus").alias("status"))
    cells = F.split("line", ",")
    bad = bad.select(F.col("reason").alias("outcome"), F.get(cells, F.lit(0)).cast("long").alias("o_orderkey"),
                     F.nullif(F.get(cells, F.lit(1)), F.lit("?")).alias("status"))
    return rows.union(bad).groupBy("outcome").agg(
        F.count("*").alias("n_lines"), F.sum("o_orderkey").alias("sum_key"), F.count("status").alias("n_status"))


@query("insert_or_ignore", ops=("SNK-4", "STR-7", "JOI-5"), sql="""
SELECT o_custkey AS patient_id,
       COALESCE(MIN(CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN o_orderkey END),
                MIN(o_orderkey)) AS first_order
FROM orders GROUP BY o_custkey""")
def q_insert_ignore(spark, d):
    path = scratch_path(spark, "dim")
    o = T.load(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"),
                                          F.col("o_orderkey").alias("first_order"),
                                          "o_orderdate")
    early = o.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")).drop("o_orderdate")
    late = o.where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")).drop("o_orderdate")
    # early keys are inserted first; later batches (and a replay) keep stored rows
    SK.insert_or_ignore(early, path, ["patient_id"], ["first_order"])
    SK.insert_or_ignore(late, path, ["patient_id"], ["first_order"])
    SK.insert_or_ignore(early, path, ["patient_id"], ["first_order"])
    # one stored row per key: the first order of the earliest batch holding the key
    return spark.read.parquet(path)


@query("code_table_sections", ops=("SRC-3", "JOI-7"), sql="""
SELECT 'region_id' AS section, r_regionkey AS id, r_name AS description FROM region
UNION ALL SELECT 'nation_id', n_nationkey, n_name FROM nation
UNION ALL SELECT 'priority_id', CAST(substr(o_orderpriority, 1, 1) AS INTEGER),
                 'priority, ' || substr(o_orderpriority, 3) FROM orders GROUP BY o_orderpriority""")
def q_code_sections(spark, d):
    root = scratch_path(spark, "codes")
    reg = T.load(spark, d, "region").select(F.lit(0).alias("sec"), F.col("r_regionkey").alias("id"),
                                            F.col("r_name").alias("txt"))
    nat = T.load(spark, d, "nation").select(F.lit(1).alias("sec"), F.col("n_nationkey").alias("id"),
                                            F.col("n_name").alias("txt"))
    pri = (T.load(spark, d, "orders").select("o_orderpriority").distinct()
           .select(F.lit(2).alias("sec"), F.substring("o_orderpriority", 1, 1).cast("int").alias("id"),
                   F.concat(F.lit("priority, "), F.expr("substr(o_orderpriority, 3)")).alias("txt")))
    names = F.element_at(F.array(F.lit("region_id"), F.lit("nation_id"), F.lit("priority_id")),
                         F.col("sec") + 1)
    body = reg.unionByName(nat).unionByName(pri).select(
        "sec", F.lit(1).alias("kind"), "id",
        # quoted text follows the comma directly; plain text may carry leading blanks
        F.concat(F.col("id").cast("string"),
                 F.when(F.col("txt").contains(","), F.concat(F.lit(',"'), F.col("txt"), F.lit('"')))
                 .otherwise(F.concat(F.lit(",  "), F.col("txt"))), F.lit("\r")).alias("value"))
    heads = spark.range(3).select(F.col("id").cast("int").alias("sec"), F.lit(0).alias("kind"),
                                  F.lit(-1).alias("id"))
    heads = heads.withColumn("value", F.concat(names, F.lit(",description\r")))
    seps = spark.range(2).select(F.col("id").cast("int").alias("sec"), F.lit(2).alias("kind"),
                                 F.lit(10 ** 6).alias("id"), F.lit(",\r").alias("value"))
    lines = heads.unionByName(body).unionByName(seps)
    # the code table is a fixed small file: one ordered partition
    (lines.coalesce(1).sortWithinPartitions("sec", "kind", "id").select("value")
     .write.mode("overwrite").text(f"{root}/IDs_mapping"))
    return R.code_sections(spark, f"{root}/IDs_mapping").select(
        "section", "id", "description")


@query("parquet_views", ops=("SRC-4", "SRC-6", "QRY-10", "TOP-7"), sql="""
SELECT n.n_name, COUNT(*) AS customers, AVG(c.c_acctbal) AS avg_balance
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name ORDER BY customers DESC, n.n_name""")
def q_views(spark, d):
    R.register_views(spark, d)          # every table of the directory
    text = """SELECT n.n_name, COUNT(*) AS customers, AVG(c.c_acctbal) AS avg_balance
              FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
              GROUP BY n.n_name ORDER BY customers DESC, n.n_name"""
    return adhoc_sql(spark, text)


# plan nodes that write or run programs, and functions that call any Java method
WRITING = re.compile(r"(?m)^[\s:+|-]*'?(Insert|Merge|Update|Delete|Create|Replace|Drop|Alter|Truncate|Load|Write|Overwrite|Append"
                     r"|ScriptTransformation|\w+Command)")
CALLING = re.compile(r"(?i)\b(try_reflect|reflect|java_method)\s*\(")


def require_query(spark, text: str) -> None:
    """ValueError unless ``text`` is one SELECT/WITH query. The statement is parsed, not
    run: a WITH clause may also lead an INSERT, and a SELECT may run a program."""
    head = text.lstrip().split(None, 1)[0].upper() if text.strip() else ""
    if head not in ("SELECT", "WITH"):
        raise ValueError("only SELECT or WITH statements are allowed")
    plan = spark.sql("EXPLAIN EXTENDED " + text).first()[0]
    parsed = plan.split("== Analyzed Logical Plan ==")[0]
    if WRITING.search(parsed) or CALLING.search(text):
        raise ValueError("only queries are allowed")


def adhoc_sql(spark, text: str, cap: int | None = None):
    """Run one read-only statement over the registered views (QRY-10), whole
    unless the caller asks for at most ``cap`` rows (TOP-7). Only SELECT/WITH
    queries are accepted."""
    require_query(spark, text)
    out = spark.sql(text)
    return out if cap is None else out.limit(cap)


@query("adhoc_sql", ops=("QRY-10", "TOP-7"), sql="""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def q_adhoc(spark, d):
    R.register_views(spark, d, ["orders"])
    return adhoc_sql(spark, "SELECT o_orderkey, o_totalprice FROM orders "
                            "ORDER BY o_totalprice DESC, o_orderkey", cap=100)
