"""SQL text for the oracle checks (DuckDB dialect).

These strings restate each operator's meaning as plain SQL so an independent
engine can check the Spark plans; they are not used to run anything in Spark.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from ..functions import constants as K
from ..functions.scalars import NUMERIC_TEXT
from .encounters import ENCOUNTERS_SQL


def q(s: str) -> str:
    return "'" + str(s).replace("'", "''") + "'"


def rnd(expr: str, d: int) -> str:
    """ROUND with Spark's rule for doubles: half-up on the shortest decimal text."""
    return f"CAST(ROUND(CAST(CAST(({expr}) AS DOUBLE) AS VARCHAR)::DECIMAL(38,16), {d}) AS DOUBLE)"


def rnd_even(expr: str, d: int) -> str:
    """Half-even ROUND on the shortest decimal text (Spark ``bround``; numpy/pandas)."""
    return (f"CAST(round_even(CAST(CAST(({expr}) AS DOUBLE) AS VARCHAR)::DECIMAL(38,16), {d}) "
            f"AS DOUBLE)")


def share_even(num: str, den: str, d: int) -> str:
    """pandas ``(num / den * 100).round(d)``."""
    return rnd_even(f"CAST({num} AS DOUBLE) / {den} * 100.0", d)


def hash_rank(key: str, seed: int = 42) -> str:
    """The sample/split hash of ``scalars.hash_rank``."""
    return f"((({key}) % 2147483648 + 2147483648) % 2147483648 * 1103515245 + {seed}) % 2147483648"


def lookup(x: str, mapping: Mapping, default=None) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {v if not isinstance(v, str) else q(v)}"
                     for k, v in mapping.items())
    e = f"(CASE {x} {whens} END)"
    if default is None:
        return e
    d = default if not isinstance(default, str) else q(default)
    return f"COALESCE({e}, {d})"


def bins(x: str, edges: Sequence[float], labels: Sequence[str], closed: str = "right") -> str:
    parts = []
    if closed == "right":
        for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
            parts.append(f"WHEN {x} > {lo} AND {x} <= {hi} THEN {q(lab)}")
    else:
        pairs = list(zip(edges[:-1], labels))
        for lo, lab in reversed(pairs[1:]):
            parts.append(f"WHEN {x} >= {lo} THEN {q(lab)}")
        parts.append(f"WHEN {x} IS NOT NULL THEN {q(pairs[0][1])}")
    return "(CASE " + " ".join(parts) + " END)"


def safe_double(x: str) -> str:
    return (f"(CASE WHEN regexp_matches({x}, {q(NUMERIC_TEXT)}) "
            f"THEN TRY_CAST(trim({x}) AS DOUBLE) END)")


def safe_int(x: str, default: int = 0) -> str:
    return f"COALESCE(TRY_CAST(TRUNC(COALESCE({safe_double(x)}, {default})) AS INTEGER), 0)"


def code_category(x: str) -> str:
    t = f"trim(CAST({x} AS VARCHAR))"
    num = safe_double(t)
    nulls = ", ".join(q(s) for s in K.DIAG_NULL_TOKENS)
    parts = [f"WHEN {x} IS NULL OR {x} IN ({nulls}) THEN {q(K.DIAG_DEFAULT)}"]
    for prefix, label in K.DIAG_PREFIXES:
        parts.append(f"WHEN starts_with({t}, {q(prefix)}) THEN {q(label)}")
    parts.append(f"WHEN {num} IS NULL THEN {q(K.DIAG_DEFAULT)}")
    for label, lo, hi, inc, singles in K.DIAG_RANGES:
        cond = f"({num} >= {lo} AND {num} {'<=' if inc else '<'} {hi})"
        for s in singles:
            cond += f" OR {num} = {s}"
        parts.append(f"WHEN {cond} THEN {q(label)}")
    return "(CASE " + " ".join(parts) + f" ELSE {q(K.DIAG_DEFAULT)} END)"


def age_numeric(x: str) -> str:
    return f"CAST({lookup(x, K.AGE_MAP, K.AGE_DEFAULT)} AS INTEGER)"


def fallback_score(age_group: str, inpatient: str, meds: str) -> str:
    proxy = f"CAST({lookup(age_group, K.AGE_GROUP_PROXY, K.AGE_GROUP_PROXY_DEFAULT)} AS DOUBLE)"
    raw = f"(0.1::DOUBLE + {proxy} / 10.0::DOUBLE + {inpatient} * 0.08::DOUBLE + {meds} / 100.0::DOUBLE)"
    return rnd_even(f"greatest(0.01::DOUBLE, least(0.99::DOUBLE, {raw}))", 4)


def heuristic_score(age: str, inpatient: str, meds: str) -> str:
    base = (f"(0.1::DOUBLE + least({age} / 200.0::DOUBLE, 0.2::DOUBLE) "
            f"+ least({inpatient} * 0.15::DOUBLE, 0.3::DOUBLE) "
            f"+ least({meds} / 50.0::DOUBLE, 0.15::DOUBLE))")
    return f"least({rnd_even(base, 4)}, 0.95::DOUBLE)"


def risk_level(x: str, closed: str = "right") -> str:
    return bins(x, K.RISK_EDGES, K.RISK_LABELS, closed)


# ------------------------------------------------------------------ layers as CTEs
SILVER_SQL = f"""
silver AS (
  WITH typed AS (
    SELECT TRY_CAST(patient_nbr AS BIGINT) AS patient_id,
           TRY_CAST(encounter_id AS BIGINT) AS visit_id, *
    FROM enc
  ), firsts AS (
    SELECT * FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY patient_id ORDER BY admitted_at, visit_id) AS rn
      FROM typed) WHERE rn = 1
  ), s1 AS (
    SELECT patient_id, visit_id,
      {age_numeric('age')} AS age,
      {bins(age_numeric('age'), K.AGE_EDGES, K.AGE_LABELS)} AS age_group,
      gender, race,
      {safe_int('time_in_hospital')} AS time_in_hospital,
      {safe_int('num_lab_procedures')} AS num_lab_procedures,
      0 AS num_procedures,
      {safe_int('num_medications')} AS num_medications,
      {safe_int('number_inpatient')} AS number_inpatient,
      {safe_int('number_outpatient')} AS number_outpatient,
      {safe_int('number_emergency')} AS number_emergency,
      CAST({safe_int('number_inpatient')} + {safe_int('number_outpatient')}
           + {safe_int('number_emergency')} AS INTEGER) AS total_visits,
      0 AS number_diagnoses,
      {code_category('diag_1')} AS diag_1_category,
      'Other' AS diag_2_category,
      'Other' AS diag_3_category,
      COALESCE(insulin, 'Unknown') AS insulin,
      'Unknown' AS diabetes_med,
      'Unknown' AS a1c_result,
      CASE WHEN insulin IN ('Up', 'Down') THEN 1 ELSE 0 END AS medication_change,
      CASE WHEN insulin = 'No' THEN 0 ELSE 1 END AS total_medications_active,
      CASE WHEN readmitted = '<30' THEN 1 ELSE 0 END AS readmitted_binary
    FROM firsts
  )
  SELECT patient_id, visit_id, age, age_group, gender, race, time_in_hospital,
         num_lab_procedures, num_procedures, num_medications, number_inpatient,
         number_outpatient, number_emergency, total_visits, number_diagnoses,
         diag_1_category, diag_2_category, diag_3_category, insulin, diabetes_med,
         a1c_result, medication_change,
         CASE WHEN num_lab_procedures > t.p75 THEN 1 ELSE 0 END AS high_lab_procedures,
         total_medications_active, readmitted_binary
  FROM s1, (SELECT quantile_cont(num_lab_procedures, 0.75) AS p75 FROM s1) t
)"""

FACT_SQL = f"""
fact AS (
  SELECT ROW_NUMBER() OVER (ORDER BY visit_id) AS id, patient_id, visit_id,
         {fallback_score('age_group', 'number_inpatient', 'num_medications')} AS risk_score,
         {risk_level(fallback_score('age_group', 'number_inpatient', 'num_medications'))}
           AS risk_level,
         readmitted_binary
  FROM silver
)"""

DIMS_SQL = """
dim_patient AS (SELECT DISTINCT patient_id, age, age_group, gender, race FROM silver),
dim_visit_metrics AS (
  SELECT DISTINCT visit_id, time_in_hospital, num_lab_procedures, num_procedures,
         num_medications, total_visits, number_inpatient, number_outpatient,
         number_emergency, diag_1_category, insulin, diabetes_med, a1c_result
  FROM silver)"""

SUMMARY_SQL = f"""
gold AS (
  SELECT p.patient_id, f.visit_id, p.age, p.age_group, p.gender, p.race, v.diag_1_category,
         v.num_medications, v.num_lab_procedures, v.time_in_hospital, v.total_visits,
         v.number_inpatient, v.insulin, v.diabetes_med, v.a1c_result,
         f.risk_score, {rnd('f.risk_score * 100', 1)} AS risk_percentage, f.risk_level
  FROM fact f
  JOIN dim_patient p ON f.patient_id = p.patient_id
  JOIN dim_visit_metrics v ON f.visit_id = v.visit_id
)"""

ENC = "WITH " + ENCOUNTERS_SQL
SILVER = ENC + "," + SILVER_SQL
MART = SILVER + "," + FACT_SQL + "," + DIMS_SQL + "," + SUMMARY_SQL


def with_ctes(base: str, body: str, extra: str = "") -> str:
    """``base`` CTE chain, optional extra CTEs, then the final SELECT ``body``."""
    return base + ("," + extra if extra else "") + "\n" + body
