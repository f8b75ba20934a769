"""Dashboard and assistant queries, profiles, joins and top-k lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as T
from ..functions import constants as K
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import profile as P
from ..operators import topk as TK
from ..operators import validation as V
from ..operators.sequence import rank_column
from . import sqlgen as G
from .registry import query

LEVELS = K.RISK_LEVELS


def gold(spark, d):
    return T.mart(spark, d)["gold_patient_risk_summary"]


def MG(body: str) -> str:
    return G.with_ctes(G.MART, body)


# ------------------------------------------------------------------ aggregates on the mart
@query("kpi_row_grain", ops=("AGG-2", "AGG-3", "AGG-15", "AGG-20"), sql=MG("""
SELECT COUNT(*) AS total_rows,
       COUNT(CASE WHEN risk_level = 'High' THEN 1 END) AS high_risk_rows,
       AVG(CASE WHEN risk_level = 'High' THEN 100.0 ELSE 0.0 END) AS high_risk_pct,
       AVG(risk_score) AS avg_risk_score,
       AVG(risk_percentage) AS avg_risk_percentage,
       AVG(time_in_hospital) AS avg_stay,
       AVG(num_medications) AS avg_medications,
       MAX(CASE WHEN risk_level = 'High' THEN risk_score END) AS max_high_score,
       AVG(CASE WHEN risk_level = 'High' THEN risk_score END) AS avg_high_score
FROM gold"""))
def q_kpi_grain(spark, d):
    g = gold(spark, d)
    hi = F.col("risk_level") == "High"
    return g.agg(
        F.count(F.lit(1)).alias("total_rows"),
        A.count_if(hi).alias("high_risk_rows"),
        A.pct_true(hi).alias("high_risk_pct"),
        F.avg("risk_score").alias("avg_risk_score"),
        F.avg("risk_percentage").alias("avg_risk_percentage"),
        F.avg("time_in_hospital").alias("avg_stay"),
        F.avg("num_medications").alias("avg_medications"),
        F.max(F.when(hi, F.col("risk_score"))).alias("max_high_score"),
        F.avg(F.when(hi, F.col("risk_score"))).alias("avg_high_score"),
    )


@query("warehouse_stats", ops=("AGG-3", "JOI-1"), sql=MG("""
SELECT COUNT(*) AS total_patients,
       COUNT(CASE WHEN f.risk_level = 'High' THEN 1 END) AS high_risk,
       AVG(f.risk_score) AS avg_risk,
       AVG(v.time_in_hospital) AS avg_stay,
       AVG(f.readmitted_binary) * 100.0 AS readmission_rate
FROM fact f LEFT JOIN dim_visit_metrics v ON f.visit_id = v.visit_id"""))
def q_wh_stats(spark, d):
    m = T.mart(spark, d)
    j = m["fact"].join(m["dim_visit_metrics"].select("visit_id", "time_in_hospital").hint("merge"),
                       "visit_id", "left")
    return j.agg(F.count(F.lit(1)).alias("total_patients"),
                 A.count_if(F.col("risk_level") == "High").alias("high_risk"),
                 F.avg("risk_score").alias("avg_risk"),
                 F.avg("time_in_hospital").alias("avg_stay"),
                 (F.avg("readmitted_binary") * F.lit(100.0)).alias("readmission_rate"))


@query("band_distribution_zero_fill", ops=("AGG-5", "SET-1", "WIN-4"), sql=MG(f"""
SELECT l.risk_level, COALESCE(c.n, 0) AS patient_count,
       {G.share_even('COALESCE(c.n, 0)', 'NULLIF(SUM(COALESCE(c.n, 0)) OVER (), 0)', 1)}
         AS percentage
FROM (VALUES ('Low'), ('Medium'), ('High'), ('Critical')) l(risk_level)
LEFT JOIN (SELECT risk_level, COUNT(*) AS n FROM gold GROUP BY risk_level) c
  ON l.risk_level = c.risk_level"""))
def q_band_zero(spark, d):
    return A.zero_filled_levels(gold(spark, d), LEVELS + ["Critical"])


@query("level_counts", ops=("AGG-6", "TOP-5"), sql=MG("""
SELECT risk_level, COUNT(*) AS n FROM gold GROUP BY risk_level"""))
def q_level_counts(spark, d):
    return A.level_counts(gold(spark, d)).orderBy("risk_level")


@query("age_volume", ops=("AGG-7", "TOP-5"), sql=MG("""
SELECT age_group, COUNT(*) AS patients, AVG(risk_score) AS avg_risk
FROM gold WHERE age_group IS NOT NULL GROUP BY age_group"""))
def q_age_volume(spark, d):
    g = gold(spark, d)
    return A.grouped_stats(g, ["age_group"], {"patients": F.count(F.lit(1)),
                                              "avg_risk": F.avg("risk_score")}
                           ).orderBy("age_group")


@query("group_pct_high", ops=("AGG-9", "AGG-10"), sql=MG("""
SELECT age_group, AVG(risk_score) AS avg_risk, COUNT(*) AS patient_count,
       CAST(SUM(CASE WHEN risk_level = 'High' THEN 1 ELSE 0 END) AS BIGINT) AS high_risk_count,
       AVG(CASE WHEN risk_level = 'High' THEN 100.0 ELSE 0.0 END) AS high_risk_pct
FROM gold WHERE age_group IS NOT NULL GROUP BY age_group"""))
def q_pct_high(spark, d):
    hi = F.col("risk_level") == "High"
    return A.grouped_stats(gold(spark, d), ["age_group"], {
        "avg_risk": F.avg("risk_score"), "patient_count": F.count(F.lit(1)),
        "high_risk_count": F.sum(S.equals_flag("risk_level", "High")).cast("long"),
        "high_risk_pct": A.pct_true(hi)})


@query("diagnosis_risk", ops=("AGG-11",), sql=MG("""
SELECT diag_1_category, AVG(risk_score) AS avg_risk, COUNT(patient_id) AS n
FROM gold WHERE diag_1_category IS NOT NULL GROUP BY diag_1_category"""))
def q_diag_risk(spark, d):
    return A.grouped_stats(gold(spark, d), ["diag_1_category"], {
        "avg_risk": F.avg("risk_score"), "n": F.count("patient_id")}
    ).orderBy(F.desc("avg_risk"))


@query("department_table", ops=("AGG-12",), sql=MG("""
SELECT diag_1_category AS department, COUNT(patient_id) AS patient_count,
       AVG(risk_score) AS avg_risk, AVG(time_in_hospital) AS avg_stay,
       AVG(num_medications) AS avg_meds
FROM gold WHERE diag_1_category IS NOT NULL GROUP BY diag_1_category"""))
def q_department(spark, d):
    g = gold(spark, d)
    out = A.grouped_stats(g, ["diag_1_category"], {
        "patient_count": F.count("patient_id"), "avg_risk": F.avg("risk_score"),
        "avg_stay": F.avg("time_in_hospital"), "avg_meds": F.avg("num_medications")})
    return out.withColumnRenamed("diag_1_category", "department").orderBy(F.desc("avg_risk"))


@query("gender_level_counts", ops=("AGG-13",), sql=MG("""
SELECT gender, risk_level, COUNT(*) AS n FROM gold
WHERE gender IS NOT NULL AND risk_level IS NOT NULL GROUP BY gender, risk_level"""))
def q_gender_level(spark, d):
    return A.grouped_stats(gold(spark, d), ["gender", "risk_level"], {"n": F.count(F.lit(1))})


@query("stacked_pivot", ops=("AGG-14",), sql=MG("""
SELECT diag_1_category,
  COUNT(CASE WHEN risk_level = 'Low' THEN 1 END) AS "Low",
  COUNT(CASE WHEN risk_level = 'Medium' THEN 1 END) AS "Medium",
  COUNT(CASE WHEN risk_level = 'High' THEN 1 END) AS "High"
FROM gold GROUP BY diag_1_category"""))
def q_pivot(spark, d):
    return A.pivot_counts(gold(spark, d), "diag_1_category", "risk_level", LEVELS)


@query("dax_measures", ops=("AGG-15", "SCA-24"), sql=MG(f"""
SELECT risk_level,
       COUNT(*) AS n,
       AVG(risk_percentage) AS avg_risk_pct,
       AVG(time_in_hospital) AS avg_stay,
       CAST(SUM(readmitted_binary) AS DOUBLE) / NULLIF(COUNT(*), 0) AS readmission_rate,
       {G.lookup('risk_level', K.LEVEL_COLOURS, K.LEVEL_COLOUR_DEFAULT)} AS colour
FROM (SELECT g.*, f.readmitted_binary FROM gold g JOIN fact f ON g.visit_id = f.visit_id)
GROUP BY risk_level"""))
def q_dax(spark, d):
    m = T.mart(spark, d)
    g = m["gold_patient_risk_summary"].join(m["fact"].select("visit_id", "readmitted_binary"),
                                            "visit_id")
    out = g.groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("n"), F.avg("risk_percentage").alias("avg_risk_pct"),
        F.avg("time_in_hospital").alias("avg_stay"),
        S.safe_ratio(F.sum("readmitted_binary"), F.count(F.lit(1))).alias("readmission_rate"))
    return out.withColumn("colour", S.level_colour("risk_level"))


@query("value_counts_share", ops=("AGG-16", "WIN-4"), sql=f"""
SELECT o_orderpriority, COUNT(*) AS "count",
       CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER () AS share
FROM orders GROUP BY o_orderpriority""")
def q_value_counts(spark, d):
    return A.value_counts(T.load(spark, d, "orders"), "o_orderpriority", normalize=True)


@query("monthly_rate", ops=("AGG-29", "SCA-27"), sql=f"""
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
       COUNT(*) AS total_patients,
       COUNT(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS readmissions,
       {G.share_even("COUNT(CASE WHEN o_orderstatus = 'F' THEN 1 END)", "COUNT(*)", 1)}
         AS readmission_rate
FROM orders GROUP BY 1""")
def q_monthly(spark, d):
    o = T.load(spark, d, "orders")
    return A.monthly_rate(o, "o_orderdate", F.col("o_orderstatus") == "F")


@query("class_ratio", ops=("AGG-30",), sql=MG("""
SELECT COUNT(CASE WHEN readmitted_binary = 0 THEN 1 END) AS negatives,
       COUNT(CASE WHEN readmitted_binary = 1 THEN 1 END) AS positives,
       CAST(COUNT(CASE WHEN readmitted_binary = 0 THEN 1 END) AS DOUBLE)
         / NULLIF(COUNT(CASE WHEN readmitted_binary = 1 THEN 1 END), 0) AS ratio
FROM silver"""))
def q_class_ratio(spark, d):
    return A.class_ratio(T.mart(spark, d)["silver"], "readmitted_binary")


@query("argmax_row", ops=("AGG-31", "TRN-7"), sql="""
SELECT c_nationkey, c_custkey, c_acctbal FROM (
  SELECT c_nationkey, c_custkey, c_acctbal,
         ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn
  FROM customer) WHERE rn = 1""")
def q_argmax(spark, d):
    return A.arg_max(T.load(spark, d, "customer"), "c_custkey", "c_acctbal", ["c_nationkey"])


@query("distinct_classes", ops=("AGG-21", "SET-2"), sql=MG("""
SELECT 'race' AS column_name, COUNT(DISTINCT race) AS n_classes FROM silver
UNION ALL SELECT 'diag_1_category', COUNT(DISTINCT diag_1_category) FROM silver
UNION ALL SELECT 'age_group', COUNT(DISTINCT age_group) FROM silver"""))
def q_distinct(spark, d):
    s = T.mart(spark, d)["silver"]
    parts = [s.agg(F.lit(c).alias("column_name"), F.countDistinct(c).alias("n_classes"))
             for c in ("race", "diag_1_category", "age_group")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("filtered_max", ops=("AGG-20", "FIL-1"), sql=MG("""
SELECT AVG(risk_score) AS avg_score, MAX(risk_score) AS max_score, COUNT(*) AS n
FROM gold WHERE risk_level = 'High'"""))
def q_filtered_max(spark, d):
    g = gold(spark, d).where(F.col("risk_level") == "High")
    return g.agg(F.avg("risk_score").alias("avg_score"), F.max("risk_score").alias("max_score"),
                 F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ fill
@query("median_mode_fill", ops=("AGG-18", "AGG-19", "SCA-29", "FIL-5"), sql="""
WITH p AS (
  SELECT p_partkey, NULLIF(p_size, 7) AS p_size, NULLIF(p_retailprice, 0) AS p_retailprice,
         NULLIF(p_brand, 'Brand#13') AS p_brand, p_type FROM part
), st AS (
  SELECT median(p_size) AS m_size, median(p_retailprice) AS m_price,
         COALESCE((SELECT p_brand FROM p WHERE p_brand IS NOT NULL GROUP BY p_brand
                   ORDER BY COUNT(*) DESC, p_brand LIMIT 1), 'Unknown') AS m_brand
  FROM p
)
SELECT p_partkey, COALESCE(p_size, m_size) AS p_size,
       COALESCE(p_retailprice, m_price) AS p_retailprice,
       COALESCE(p_brand, m_brand) AS p_brand, p_type
FROM p, st""")
def q_fill(spark, d):
    p = T.load(spark, d, "part").select(
        "p_partkey", F.nullif(F.col("p_size"), F.lit(7)).alias("p_size"),
        F.nullif(F.col("p_retailprice"), F.lit(0.0)).alias("p_retailprice"),
        F.nullif(F.col("p_brand"), F.lit("Brand#13")).alias("p_brand"), "p_type")
    out = A.median_mode_fill(p, ["p_size", "p_retailprice"], ["p_brand"])
    return out.withColumn("p_size", F.col("p_size").cast("double"))


# ------------------------------------------------------------------ joins
@query("left_join_fallback", ops=("JOI-1", "JOI-5", "JOI-6"), sql="""
WITH big AS (
  SELECT o_custkey, SUM(o_totalprice) AS spend FROM orders
  WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey
)
SELECT c.c_custkey, COALESCE(b.spend, c.c_acctbal) AS spend,
       CASE WHEN b.o_custkey IS NULL THEN 0 ELSE 1 END AS matched
FROM customer c LEFT JOIN big b ON c.c_custkey = b.o_custkey""")
def q_left_fallback(spark, d):
    o = T.load(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    big = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spend"))
    c = T.load(spark, d, "customer").select("c_custkey", "c_acctbal")
    out = J.left_with_fallback(c, big, "c_custkey", "spend", F.col("c_acctbal"))
    return out.select("c_custkey", "spend", "matched")


@query("three_table_master", ops=("JOI-3", "PRJ-5", "SNK-8"), sql="""
WITH li AS (
  SELECT l_orderkey, COUNT(*) AS n_lines, SUM(l_extendedprice) AS gross
  FROM lineitem GROUP BY l_orderkey
)
SELECT o.o_orderkey, o.o_custkey, c.c_name, c.c_mktsegment, o.o_totalprice,
       li.n_lines, li.gross
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN li ON o.o_orderkey = li.l_orderkey""")
def q_master(spark, d):
    li = T.load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_extendedprice").alias("gross"))
    o = T.load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = T.load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                            "c_name", "c_mktsegment")
    return (o.join(c, "o_custkey").join(li, "o_orderkey", "left")
            .select("o_orderkey", "o_custkey", "c_name", "c_mktsegment", "o_totalprice",
                    "n_lines", "gross"))


@query("anti_join_orphans", ops=("JOI-5", "VAL-3"), sql="""
SELECT o_orderkey, o_custkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""")
def q_orphans(spark, d):
    o = T.load(spark, d, "orders").select("o_orderkey", "o_custkey")
    return J.orphans(o, T.load(spark, d, "lineitem"), "o_orderkey", "l_orderkey")


# FIXED-SIZE lookup built from the order-priority codes (JOI-7)
PRIORITY_CODES = [("1-URGENT", 1, "urgent"), ("2-HIGH", 2, "high"), ("3-MEDIUM", 3, "medium"),
                  ("4-NOT SPECIFIED", 4, "unspecified"), ("5-LOW", 5, "low")]


@query("code_lookup_join", ops=("JOI-7",), sql="""
SELECT o.o_orderkey, o.o_orderpriority, l.priority_id, l.description
FROM orders o LEFT JOIN (VALUES ('1-URGENT', 1, 'urgent'), ('2-HIGH', 2, 'high'),
  ('3-MEDIUM', 3, 'medium'), ('5-LOW', 5, 'low'))
  l(o_orderpriority, priority_id, description) ON o.o_orderpriority = l.o_orderpriority""")
def q_lookup(spark, d):
    codes = [r for r in PRIORITY_CODES if r[1] != 4]   # one code left unmapped on purpose
    lk = spark.createDataFrame(codes, "o_orderpriority string, priority_id int, description string")
    o = T.load(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return J.lookup_join(o, lk, "o_orderpriority")


# ------------------------------------------------------------------ profiles
def customer_with_nulls(spark, d):
    c = T.load(spark, d, "customer")
    return c.select("c_custkey", F.nullif(F.col("c_name"), F.lit("Customer#000000001")).alias("c_name"),
                    F.nullif(F.col("c_nationkey"), F.lit(3)).alias("c_nationkey"),
                    F.nullif(F.col("c_acctbal"), F.lit(0.0)).alias("c_acctbal"),
                    F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("c_mktsegment"))


CUSTOMER_NULLS_SQL = """cn AS (
  SELECT c_custkey, NULLIF(c_name, 'Customer#000000001') AS c_name,
         NULLIF(c_nationkey, 3) AS c_nationkey, NULLIF(c_acctbal, 0.0) AS c_acctbal,
         NULLIF(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer)"""


@query("null_profile", ops=("AGG-23", "P3"), sql=f"""
WITH {CUSTOMER_NULLS_SQL}
SELECT column_name, missing, {G.share_even('missing', 'n', 2)} AS missing_pct FROM (
  SELECT 'c_custkey' AS column_name, COUNT(*) - COUNT(c_custkey) AS missing, COUNT(*) AS n FROM cn
  UNION ALL SELECT 'c_name', COUNT(*) - COUNT(c_name), COUNT(*) FROM cn
  UNION ALL SELECT 'c_nationkey', COUNT(*) - COUNT(c_nationkey), COUNT(*) FROM cn
  UNION ALL SELECT 'c_acctbal', COUNT(*) - COUNT(c_acctbal), COUNT(*) FROM cn
  UNION ALL SELECT 'c_mktsegment', COUNT(*) - COUNT(c_mktsegment), COUNT(*) FROM cn)""")
def q_null_profile(spark, d):
    return P.null_profile(customer_with_nulls(spark, d))


@query("shape_profile", ops=("AGG-24", "PRJ-4"), sql="""
SELECT COUNT(*) AS n_rows, 11 AS n_columns, 8 AS n_numeric, 2 AS n_text FROM lineitem""")
def q_shape(spark, d):
    return P.shape_profile(T.load(spark, d, "lineitem"))


@query("table_counts", ops=("AGG-22",), sql="""
SELECT 'customer' AS table_name, COUNT(*) AS row_count FROM customer
UNION ALL SELECT 'orders', COUNT(*) FROM orders
UNION ALL SELECT 'lineitem', COUNT(*) FROM lineitem
UNION ALL SELECT 'part', COUNT(*) FROM part
UNION ALL SELECT 'supplier', COUNT(*) FROM supplier
UNION ALL SELECT 'events', COUNT(*) FROM events
UNION ALL SELECT 'model_predictions', 0""")
def q_table_counts(spark, d):
    tabs = {n: T.load(spark, d, n) for n in ("customer", "orders", "lineitem", "part",
                                             "supplier", "events")}
    tabs["model_predictions"] = None
    return A.table_counts(tabs)


LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql(cols, lower_only=False):
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if a == b and not lower_only:
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, 1.0::DOUBLE AS corr")
            elif i != j and (not lower_only or i < j):
                parts.append(f"SELECT '{a}', '{b}', corr({a}, {b}) FROM lineitem")
    return "\nUNION ALL ".join(parts)


@query("corr_matrix_long", ops=("AGG-25",), sql=_corr_sql(LI_NUM))
def q_corr(spark, d):
    return P.corr_long(T.load(spark, d, "lineitem"), LI_NUM)


@query("top_corr_pairs", ops=("TOP-6", "FIL-4"), sql=f"""
SELECT feature_1, feature_2, corr FROM (
  SELECT 'l_extendedprice' AS feature_1, 'l_quantity' AS feature_2,
         corr(l_extendedprice, l_quantity) AS corr FROM lineitem
  UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', 'l_tax', corr(l_extendedprice, l_tax) FROM lineitem
  UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem
  UNION ALL SELECT 'l_quantity', 'l_tax', corr(l_quantity, l_tax) FROM lineitem
  UNION ALL SELECT 'l_discount', 'l_tax', corr(l_discount, l_tax) FROM lineitem)
WHERE abs(corr) > 0.3""")
def q_top_corr(spark, d):
    li = T.load(spark, d, "lineitem")
    return P.top_corr_pairs(li, ["l_extendedprice", "l_quantity", "l_discount", "l_tax"], 0.3, 20)


@query("histogram_40", ops=("AGG-26", "SCA-28"), sql="""
WITH r AS (SELECT MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem),
b AS (
  SELECT CASE WHEN hi = lo THEN 1
              ELSE least(CAST(floor((l_extendedprice - lo) / ((hi - lo) / 40.0)) AS INTEGER) + 1, 40)
         END AS bin, lo, hi
  FROM lineitem, r WHERE l_extendedprice IS NOT NULL)
SELECT bin, lo + (bin - 1) * ((hi - lo) / 40.0) AS bin_start, lo + bin * ((hi - lo) / 40.0) AS bin_end,
       COUNT(*) AS "count"
FROM b GROUP BY bin, lo, hi""")
def q_hist(spark, d):
    return P.histogram(T.load(spark, d, "lineitem"), "l_extendedprice", 40)


@query("histogram_bins", ops=("SCA-28", "AGG-26"), sql=G.with_ctes(G.MART, """
SELECT bin, lo + (bin - 1) * ((hi - lo) / 14.0) AS bin_start, lo + bin * ((hi - lo) / 14.0) AS bin_end,
       COUNT(*) AS "count"
FROM hb GROUP BY bin, lo, hi""", extra="""
hr AS (SELECT MIN(time_in_hospital) AS lo, MAX(time_in_hospital) AS hi FROM gold),
hb AS (
  SELECT CASE WHEN hi = lo THEN 1
              ELSE least(CAST(floor((time_in_hospital - lo) / ((hi - lo) / 14.0)) AS INTEGER) + 1, 14)
         END AS bin, lo, hi
  FROM gold, hr WHERE time_in_hospital IS NOT NULL)"""))
def q_hist_bins(spark, d):
    return P.histogram(gold(spark, d), "time_in_hospital", 14)


@query("box_stats", ops=("AGG-27",), sql="""
WITH s AS (
  SELECT l_returnflag, MIN(l_quantity) AS "min", quantile_cont(l_quantity, 0.25) AS q1,
         quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3,
         MAX(l_quantity) AS "max"
  FROM lineitem GROUP BY l_returnflag)
SELECT s.*, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence,
  (SELECT COUNT(*) FROM lineitem l WHERE l.l_returnflag = s.l_returnflag
     AND (l.l_quantity < q1 - 1.5 * (q3 - q1) OR l.l_quantity > q3 + 1.5 * (q3 - q1)))
    AS n_outliers
FROM s""")
def q_box(spark, d):
    return P.box_stats(T.load(spark, d, "lineitem"), "l_quantity", ["l_returnflag"])


@query("ols_trend", ops=("AGG-28",), sql="""
SELECT regr_slope(l_extendedprice, l_quantity) AS slope,
       regr_intercept(l_extendedprice, l_quantity) AS intercept,
       regr_r2(l_extendedprice, l_quantity) AS r2, regr_count(l_extendedprice, l_quantity) AS n
FROM lineitem""")
def q_ols(spark, d):
    return P.ols_trend(T.load(spark, d, "lineitem"), "l_extendedprice", "l_quantity")


@query("null_matrix_sample", ops=("TOP-10", "TOP-9"), sql=f"""
WITH {CUSTOMER_NULLS_SQL}
SELECT c_custkey,
  CAST(c_name IS NULL AS INTEGER) AS c_name, CAST(c_nationkey IS NULL AS INTEGER) AS c_nationkey,
  CAST(c_acctbal IS NULL AS INTEGER) AS c_acctbal,
  CAST(c_mktsegment IS NULL AS INTEGER) AS c_mktsegment
FROM cn ORDER BY {G.hash_rank('c_custkey')}, c_custkey LIMIT 200""")
def q_null_matrix(spark, d):
    c = customer_with_nulls(spark, d)
    s = TK.hash_sample(c, "c_custkey", 200, 42)
    return s.select("c_custkey", *[F.col(x).isNull().cast("int").alias(x)
                                   for x in ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")])


# ------------------------------------------------------------------ top-k, samples
@query("topk_score", ops=("TOP-1", "JOI-3", "FIL-1"), sql=MG("""
SELECT g.patient_id, g.risk_score, g.risk_level, g.age, g.gender, g.diag_1_category,
       g.num_medications, f.readmitted_binary
FROM gold g JOIN fact f ON g.visit_id = f.visit_id
WHERE g.risk_level = 'High'
ORDER BY g.risk_score DESC, g.patient_id LIMIT 50"""))
def q_topk(spark, d):
    m = T.mart(spark, d)
    g = m["gold_patient_risk_summary"].where(F.col("risk_level") == "High")
    # the fact has one row per visit, so the 50 rows are known before the join
    top = TK.top_k(g, 50, [F.desc("risk_score"), "patient_id"])
    j = m["fact"].select("visit_id", "readmitted_binary").join(F.broadcast(top), "visit_id")
    return TK.top_k(j, 50, [F.desc("risk_score"), "patient_id"]).select(
        "patient_id", "risk_score", "risk_level", "age", "gender", "diag_1_category",
        "num_medications", "readmitted_binary")


@query("topk_after_star", ops=("TOP-2", "TOP-3", "WIN-3"), sql=MG("""
SELECT ROW_NUMBER() OVER (ORDER BY risk_score DESC, patient_id) AS "rank", patient_id, risk_score,
       num_medications
FROM (SELECT * FROM gold ORDER BY risk_score DESC, patient_id LIMIT 100)"""))
def q_topk_star(spark, d):
    t = TK.top_k(gold(spark, d), 100, [F.desc("risk_score"), "patient_id"])
    return rank_column(t, [F.desc("risk_score"), "patient_id"]).select(
        "rank", "patient_id", "risk_score", "num_medications")


@query("hash_sample", ops=("TOP-9",), sql=f"""
SELECT event_id, event_type, value FROM events
ORDER BY {G.hash_rank('event_id')}, event_id LIMIT 200""")
def q_sample(spark, d):
    e = T.load(spark, d, "events").select("event_id", "event_type", "value")
    return TK.hash_sample(e, "event_id", 200, 42)


@query("stratified_split", ops=("TOP-11",), sql=f"""
SELECT quality, CASE WHEN {G.hash_rank('doc_id')} % 1000 < 800
                     THEN 'train' ELSE 'test' END AS split, COUNT(*) AS n
FROM labels GROUP BY ALL""")
def q_split(spark, d):
    lab = TK.hash_split(T.load(spark, d, "labels"), "doc_id", 800, 42)
    return lab.groupBy("quality", "split").agg(F.count(F.lit(1)).alias("n"))


# every column, so the order is total and the first 100 rows are well defined
LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                  "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                  "l_shipdate"]


@query("bounded_scan", ops=("SRC-5", "TOP-7", "TOP-8"), sql=f"""
SELECT * FROM lineitem ORDER BY {", ".join(LINEITEM_ORDER)} LIMIT 100""")
def q_bounded(spark, d):
    return TK.bounded_scan(T.load(spark, d, "lineitem"), 100, LINEITEM_ORDER)


@query("scatter_projection", ops=("PRJ-7",), sql=MG("""
SELECT age, risk_score, num_medications, total_visits FROM gold"""))
def q_scatter(spark, d):
    return gold(spark, d).select("age", "risk_score", "num_medications", "total_visits")


@query("filters", ops=("FIL-1", "FIL-2", "FIL-3", "FIL-4", "FIL-5"), sql=MG("""
SELECT patient_id, age_group, gender, diag_1_category, risk_score FROM gold
WHERE risk_level = 'High' AND age_group IN ('61-80', '81-100') AND gender = 'Female'
  AND diag_1_category IS NOT NULL AND num_medications > 0"""))
def q_filters(spark, d):
    g = gold(spark, d)
    slicers = {"age_group": ["61-80", "81-100"], "gender": ["Female"], "diag_1_category": None}
    cond = F.col("risk_level") == "High"
    for c, vals in slicers.items():
        if vals is not None:
            cond = cond & F.col(c).isin(*vals)
        else:
            cond = cond & F.col(c).isNotNull()
    return g.where(cond & (F.col("num_medications") > 0)).select(
        "patient_id", "age_group", "gender", "diag_1_category", "risk_score")


@query("patient_drill_through", ops=("FIL-2", "QRY-11"), sql=MG("""
SELECT g.* FROM gold g
WHERE g.patient_id = (SELECT patient_id FROM gold ORDER BY risk_score DESC, patient_id LIMIT 1)"""))
def q_drill(spark, d):
    g = gold(spark, d)
    top = TK.top_k(g.select("patient_id", "risk_score"), 1,
                   [F.desc("risk_score"), "patient_id"]).select("patient_id")
    return g.join(F.broadcast(top), "patient_id", "left_semi")


# ------------------------------------------------------------------ assistant questions
@query("ask_high_risk_count", ops=("QRY-1",), sql=MG(
    "SELECT COUNT(*) AS high_risk_patients FROM gold WHERE risk_level = 'High'"))
def q_ask1(spark, d):
    return gold(spark, d).where(F.col("risk_level") == "High").agg(
        F.count(F.lit(1)).alias("high_risk_patients"))


@query("ask_risk_by_gender", ops=("QRY-2",), sql=MG("""
SELECT gender, AVG(risk_score) AS avg_risk, COUNT(*) AS n,
       (SELECT gender FROM gold GROUP BY gender ORDER BY AVG(risk_score) DESC, gender LIMIT 1)
         AS highest
FROM gold GROUP BY gender"""))
def q_ask2(spark, d):
    g = gold(spark, d)
    per = g.groupBy("gender").agg(F.avg("risk_score").alias("avg_risk"),
                                  F.count(F.lit(1)).alias("n"))
    best = per.agg(F.min_by("gender", F.struct(-F.col("avg_risk"), F.col("gender"))).alias("highest"))
    return per.crossJoin(F.broadcast(best))


@query("ask_top10", ops=("QRY-3",), sql=MG("""
SELECT patient_id, risk_score, risk_level FROM gold
ORDER BY risk_score DESC, patient_id LIMIT 10"""))
def q_ask3(spark, d):
    return TK.top_k(gold(spark, d), 10, [F.desc("risk_score"), "patient_id"]).select(
        "patient_id", "risk_score", "risk_level")


@query("ask_stay_high_risk", ops=("QRY-4",), sql=MG(
    "SELECT AVG(time_in_hospital) AS avg_stay FROM gold WHERE risk_level = 'High'"))
def q_ask4(spark, d):
    return gold(spark, d).where(F.col("risk_level") == "High").agg(
        F.avg("time_in_hospital").alias("avg_stay"))


@query("ask_age_groups", ops=("QRY-5",), sql=MG(
    "SELECT age_group, COUNT(*) AS patients FROM gold GROUP BY age_group"))
def q_ask5(spark, d):
    return gold(spark, d).groupBy("age_group").agg(F.count(F.lit(1)).alias("patients"))


@query("ask_pct_high", ops=("QRY-6",), sql=MG(f"""
SELECT {G.rnd("AVG(CASE WHEN risk_level = 'High' THEN 100.0 ELSE 0.0 END)", 1)} AS pct_high
FROM gold"""))
def q_ask6(spark, d):
    return gold(spark, d).agg(F.round(A.pct_true(F.col("risk_level") == "High"), 1)
                              .alias("pct_high"))


@query("ask_diag_distribution", ops=("QRY-7",), sql=MG("""
SELECT diag_1_category, risk_level, COUNT(*) AS n FROM gold GROUP BY ALL"""))
def q_ask7(spark, d):
    return gold(spark, d).groupBy("diag_1_category", "risk_level").agg(
        F.count(F.lit(1)).alias("n"))


@query("ask_race_counts", ops=("QRY-8",), sql=MG(
    "SELECT race, COUNT(*) AS patients FROM gold GROUP BY race"))
def q_ask8(spark, d):
    return gold(spark, d).groupBy("race").agg(F.count(F.lit(1)).alias("patients"))


@query("ask_meds_high_low", ops=("QRY-9",), sql=MG("""
SELECT risk_level, AVG(num_medications) AS avg_meds FROM gold
WHERE risk_level IN ('High', 'Low') GROUP BY risk_level"""))
def q_ask9(spark, d):
    return (gold(spark, d).where(F.col("risk_level").isin("High", "Low"))
            .groupBy("risk_level").agg(F.avg("num_medications").alias("avg_meds")))


# FIXED VALUES: persona factor bars (label, column, denominator, default)
FACTORS = [("Inpatient Visits", "number_inpatient", 5, 0), ("Medications", "num_medications", 30, 0),
           ("Age", "age", 100, 50), ("Hospital Stay", "time_in_hospital", 14, 1),
           ("Total Visits", "total_visits", 20, 0)]


_FACTOR_UNION = "\nUNION ALL ".join(
    f"SELECT patient_id, '{lab}' AS factor, "
    f"least(COALESCE({c}, {dft}) / {den}.0, 1.0::DOUBLE) AS value FROM gold"
    for lab, c, den, dft in FACTORS)


@query("patient_profile", ops=("QRY-11", "SCA-18", "SCA-25", "EXP-4"), sql=MG(f"""
SELECT patient_id, factor, value,
  CASE WHEN value > 0.6 THEN 'high' WHEN value > 0.3 THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN value > 0.6 THEN '#f56565' WHEN value > 0.3 THEN '#ecc94b' ELSE '#48bb78' END AS colour
FROM ({_FACTOR_UNION}) x"""))
def q_profile(spark, d):
    g = gold(spark, d)
    cols = [S.capped_ratio(F.coalesce(F.col(c), F.lit(dft)), den).alias(lab)
            for lab, c, den, dft in FACTORS]
    wide = g.select("patient_id", *cols)
    long = wide.unpivot("patient_id", [lab for lab, *_ in FACTORS], "factor", "value")
    band = S.severity_band("value")
    colour = (F.when(F.col("value") > 0.6, F.lit(K.LEVEL_COLOURS["High"]))
              .when(F.col("value") > 0.3, F.lit(K.LEVEL_COLOURS["Medium"]))
              .otherwise(F.lit(K.LEVEL_COLOURS["Low"])))
    return long.select("patient_id", "factor", "value", band.alias("band"), colour.alias("colour"))


# ------------------------------------------------------------------ validation
@query("key_uniqueness", ops=("VAL-2",), sql="""
SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""")
def q_key_unique(spark, d):
    return V.duplicate_keys(T.load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("missing_totals", ops=("VAL-4", "VAL-5"), sql=G.with_ctes(G.ENC, """
SELECT COUNT(*) - COUNT(num_lab_procedures) AS num_lab_procedures,
       COUNT(*) - COUNT(race) AS race,
       (SELECT SUM((CASE WHEN num_lab_procedures IS NULL THEN 1 ELSE 0 END)
                 + (CASE WHEN num_medications IS NULL THEN 1 ELSE 0 END)
                 + (CASE WHEN race IS NULL THEN 1 ELSE 0 END)) FROM enc) AS missing_cells
FROM enc"""))
def q_missing(spark, d):
    e = T.encounters(spark, d)
    nn = V.null_counts(e, ["num_lab_procedures", "race"])
    tot = V.total_missing(e.select("num_lab_procedures", "num_medications", "race"))
    return nn.crossJoin(tot)


@query("row_errors", ops=("VAL-7",), sql=G.with_ctes(G.ENC, f"""
SELECT encounter_id, {G.safe_double('diag_1')} AS diag_1_num,
       {G.safe_double('num_lab_procedures')} AS num_lab_procedures_num,
       CASE WHEN diag_1 IS NOT NULL AND {G.safe_double('diag_1')} IS NULL THEN 'diag_1' ELSE '' END
         AS error
FROM enc"""))
def q_row_errors(spark, d):
    e = T.encounters(spark, d).select("encounter_id", "diag_1", "num_lab_procedures")
    out = V.parse_errors(e, ["diag_1", "num_lab_procedures"])
    return out.select("encounter_id", "diag_1_num", "num_lab_procedures_num", "error")


@query("rule_check", ops=("VAL-1",), sql=G.with_ctes(G.SILVER, """
SELECT CASE WHEN age < 0 OR age > 100 OR time_in_hospital < 1 OR num_medications < 0
            OR gender IS NULL THEN 'quarantine' ELSE 'valid' END AS status,
       COUNT(*) AS n
FROM silver GROUP BY 1"""))
def q_rules(spark, d):
    s = T.mart(spark, d)["silver"]
    rules = [("age", None, 0, 100), ("gender", None, None, None),
             ("time_in_hospital", 1, 1, None), ("num_medications", 0, 0, None)]
    valid, bad = V.validate(s, "patient_id", rules)
    return (valid.select(F.lit("valid").alias("status"))
            .unionByName(bad.select(F.lit("quarantine").alias("status")))
            .groupBy("status").agg(F.count(F.lit(1)).alias("n")))


@query("input_rules", ops=("VAL-1", "VAL-7"), sql="""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'gender: required'
                              WHEN o_orderkey % 7 = 0 THEN 'age: above 100'
                              WHEN o_orderkey % 11 = 0 THEN 'num_medications: not a number'
                              WHEN o_orderkey % 13 = 0 THEN 'time_in_hospital: below 1' END AS error
FROM orders
WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0""")
def q_input_rules(spark, d):
    """The 23 scoring-input rules on raw text with planted faults: the quarantine with
    each row's first error."""
    k = F.col("o_orderkey")
    five, seven, eleven, thirteen = (k % 5 == 0), (k % 7 == 0), (k % 11 == 0), (k % 13 == 0)
    raw = T.load(spark, d, "orders").select(
        k.alias("id"), F.when(seven & ~five, F.lit("150")).otherwise(F.lit("55")).alias("age"),
        F.when(~five, F.lit("Male")).alias("gender"),
        F.when(thirteen & ~five & ~seven & ~eleven, F.lit("0")).otherwise(F.lit("3")).alias("time_in_hospital"),
        F.when(eleven & ~five & ~seven, F.lit("many")).otherwise(F.lit("12")).alias("num_medications"))
    _, bad = V.validate(raw, "id")
    return bad.select("id", F.element_at("errors", 1).alias("error"))


@query("rejected_ids", ops=("JOB-4", "VAL-4", "VAL-7"), sql="""
SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'rejected' ELSE 'kept' END AS status, COUNT(*) AS n_rows
FROM orders GROUP BY 1""")
def q_rejected(spark, d):
    """Rows whose patient id is no number are quarantined with a count, not merged."""
    from . import warehouse as W
    k = F.col("o_orderkey")
    raw = T.load(spark, d, "orders").select(
        F.when(k % 97 == 0, F.concat(F.lit("A"), k.cast("string"))).otherwise(k.cast("string")).alias("patient_nbr"),
        k.cast("string").alias("encounter_id"), F.lit("Male").alias("gender"), F.lit("[50-60)").alias("age"),
        F.lit("Other").alias("race"))
    bad = W.rejected(raw).select(F.lit("rejected").alias("status"))
    kept = W.silver(raw, None).select(F.lit("kept").alias("status"))
    return bad.unionByName(kept).groupBy("status").agg(F.count(F.lit(1)).alias("n_rows"))


@query("point_lookup", ops=("FIL-2",), sql="SELECT * FROM customer WHERE c_custkey = 42")
def q_lookup(spark, d):
    return T.load(spark, d, "customer").where(F.col("c_custkey") == 42)


@query("constant_fill", ops=("SCA-29",), sql="""
SELECT c_custkey, COALESCE(NULLIF(c_nationkey, 3), 0) AS c_nationkey,
       COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'Unknown') AS c_mktsegment FROM customer""")
def q_fill(spark, d):
    c = T.load(spark, d, "customer").select("c_custkey", F.expr("NULLIF(c_nationkey, 3)").alias("c_nationkey"),
                                            F.expr("NULLIF(c_mktsegment, 'BUILDING')").alias("c_mktsegment"))
    return c.fillna(0, ["c_nationkey"]).fillna("Unknown", ["c_mktsegment"])


@query("corr_pairs_dependent", ops=("TOP-6", "FIL-4"), sql="""
WITH x AS (SELECT CAST(l_quantity AS DOUBLE) AS q, -CAST(l_quantity AS DOUBLE) - CAST(l_discount AS DOUBLE) AS minus_q,
                  CAST(l_quantity AS DOUBLE) + 20 * CAST(l_tax AS DOUBLE) AS near_q FROM lineitem)
SELECT * FROM (SELECT 'q' AS feature_1, 'minus_q' AS feature_2, corr(q, minus_q) AS corr FROM x
               UNION ALL SELECT 'q', 'near_q', corr(q, near_q) FROM x
               UNION ALL SELECT 'minus_q', 'near_q', corr(minus_q, near_q) FROM x)
WHERE abs(corr) > 0.3 ORDER BY corr DESC LIMIT 2""")
def q_corr_dependent(spark, d):
    """Pairs that do pass the threshold, of either sign; the largest signed ones stay."""
    q, disc, tax = (F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax"))
    x = T.load(spark, d, "lineitem").select(q.alias("q"), (-q - disc).alias("minus_q"), (q + 20 * tax).alias("near_q"))
    return P.top_corr_pairs(x, ["q", "minus_q", "near_q"], 0.3, 2)


# sixty columns by rule, with nulls of their own, over the line items
WIDE = [f"w{i}" for i in range(60)]


def _wide_sql(i: int) -> str:
    """A mix of the line's numbers with column i's own signs and gaps."""
    sign = -1 if i % 3 == 1 else 1
    mix = f"l_quantity * {i % 7 + 1} + {sign} * (l_extendedprice / {100 * (i % 11 + 1)}) + 1000.0 * l_discount * {i % 5} + 1e6"
    return f"CASE WHEN (l_orderkey + l_linenumber * {i + 1}) % {i % 13 + 5} > 0 THEN CAST({mix} AS DOUBLE) END AS w{i}"


WIDE_SQL = "SELECT " + ", ".join(_wide_sql(i) for i in range(60)) + " FROM "


@query("corr_wide", ops=("AGG-25", "TOP-6"), sql=f"""
WITH wide AS ({WIDE_SQL} lineitem),
c AS (SELECT {", ".join(f"corr({a}, {b}) AS {a}_{b}" for i, a in enumerate(WIDE) for b in WIDE[i + 1:])} FROM wide)
SELECT split_part(pair, '_', 1) AS col_a, split_part(pair, '_', 2) AS col_b, ROUND(corr, 7) AS corr
FROM (UNPIVOT c ON COLUMNS(*) INTO NAME pair VALUE corr)""")
def q_corr_wide(spark, d):
    """All 1,770 pairs of 60 columns with gaps in one pass, large offset included."""
    wide = T.load(spark, d, "lineitem").selectExpr(*[_wide_sql(i) for i in range(60)])
    return P.corr_long(wide, WIDE).where(F.expr("int(substr(col_a, 2)) < int(substr(col_b, 2))")) \
        .withColumn("corr", F.round("corr", 7))


# ------------------------------------------------------------------ scalars, text and time
@query("const_flags_casts", ops=("SCA-11", "SCA-13", "SCA-20", "PRJ-6"), sql=G.with_ctes(G.SILVER, """
SELECT patient_id,
  CASE WHEN num_lab_procedures > 44 THEN 1 ELSE 0 END AS high_lab_44,
  CASE WHEN num_lab_procedures > 57 THEN 1 ELSE 0 END AS high_lab_57,
  CAST(readmitted_binary AS BOOLEAN) AS readmitted_flag,
  CAST(age AS VARCHAR) AS age_text,
  CASE WHEN total_visits = 0 THEN 'none' WHEN total_visits < 3 THEN 'few' ELSE 'many' END
    AS visit_band,
  0 AS number_diagnoses_const
FROM silver"""))
def q_const(spark, d):
    s = T.mart(spark, d)["silver"]
    tv = F.col("total_visits")
    return s.select(
        "patient_id",
        S.above_flag("num_lab_procedures", K.HIGH_LAB_CONSTANT).alias("high_lab_44"),
        S.above_flag("num_lab_procedures", K.HIGH_LAB_CONSTANT_ALT).alias("high_lab_57"),
        F.col("readmitted_binary").cast("boolean").alias("readmitted_flag"),
        F.col("age").cast("string").alias("age_text"),
        F.when(tv == 0, "none").when(tv < 3, "few").otherwise("many").alias("visit_band"),
        F.lit(0).alias("number_diagnoses_const"),
    )


@query("case_severity", ops=("SCA-20", "SCA-25"), sql="""
SELECT p_partkey, p_retailprice,
  CASE WHEN p_retailprice / 2000.0 > 0.6 THEN 'high' WHEN p_retailprice / 2000.0 > 0.3 THEN 'medium'
       ELSE 'low' END AS severity
FROM part""")
def q_case_sev(spark, d):
    p = T.load(spark, d, "part")
    return p.select("p_partkey", "p_retailprice",
                    S.severity_band(F.col("p_retailprice") / F.lit(2000.0)).alias("severity"))


@query("text_and_time_format", ops=("SCA-22", "SCA-23", "SCA-26", "SCA-27"), sql="""
SELECT o_orderkey,
  printf('[%d-%d)', CAST(o_custkey % 100 AS INTEGER), CAST(o_custkey % 100 AS INTEGER) + 10)
    AS age_bucket,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso_ts,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
  array_to_string([o_orderstatus, o_orderpriority], ',') AS factors,
  len(string_split(array_to_string([o_orderstatus, o_orderpriority], ','), ',')) AS n_factors
FROM orders""")
def q_text_time(spark, d):
    o = T.load(spark, d, "orders")
    factors = S.join_list(F.array("o_orderstatus", "o_orderpriority"))
    return o.select(
        "o_orderkey",
        S.bucket_text(F.col("o_custkey") % 100).alias("age_bucket"),
        S.iso_text("o_orderdate").alias("iso_ts"),
        S.month_start("o_orderdate").alias("month"),
        factors.alias("factors"),
        F.size(S.split_list(factors)).alias("n_factors"),
    )


@query("concat_rows", ops=("SET-1",), sql="""
SELECT c_name AS name, c_acctbal AS balance, 'customer' AS kind FROM customer
UNION ALL SELECT s_name, s_acctbal, 'supplier' FROM supplier""")
def q_concat(spark, d):
    c = T.load(spark, d, "customer").select(F.col("c_name").alias("name"),
                                            F.col("c_acctbal").alias("balance"),
                                            F.lit("customer").alias("kind"))
    s = T.load(spark, d, "supplier").select(F.col("s_name").alias("name"),
                                            F.col("s_acctbal").alias("balance"),
                                            F.lit("supplier").alias("kind"))
    return c.unionByName(s)


@query("rank_column", ops=("WIN-3", "TOP-4"), sql="""
SELECT ROW_NUMBER() OVER (ORDER BY importance DESC, feature) AS "rank", feature, importance FROM (
  SELECT feature, importance FROM (
    SELECT 'l_quantity' AS feature, abs(corr(l_quantity, l_extendedprice)) AS importance FROM lineitem
    UNION ALL SELECT 'l_discount', abs(corr(l_discount, l_extendedprice)) FROM lineitem
    UNION ALL SELECT 'l_tax', abs(corr(l_tax, l_extendedprice)) FROM lineitem)
  ORDER BY importance DESC, feature LIMIT 2)""")
def q_rank(spark, d):
    li = T.load(spark, d, "lineitem")
    feats = ["l_quantity", "l_discount", "l_tax"]
    wide = li.agg(*[F.abs(F.corr(f, "l_extendedprice")).alias(f) for f in feats])
    long = wide.unpivot([], feats, "feature", "importance")
    top = TK.top_k(long, 2, [F.desc("importance"), "feature"])
    return rank_column(top, [F.desc("importance"), "feature"]).select("rank", "feature",
                                                                      "importance")


# window over partitions of a key: share within customer (kept on key partitions)
@query("share_within_key", ops=("WIN-4",), sql="""
SELECT o_orderkey, o_custkey,
       o_totalprice / NULLIF(SUM(o_totalprice) OVER (PARTITION BY o_custkey), 0) AS share
FROM orders""")
def q_share_key(spark, d):
    o = T.load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return (J.with_key_total(o, "o_custkey", "o_totalprice", "__t")
            .select("o_orderkey", "o_custkey", S.safe_ratio("o_totalprice", "__t").alias("share")))



@query("warehouse_integrity", ops=("VAL-2", "VAL-3", "VAL-4"), sql=MG("""
SELECT 'silver_patient_visits' AS table_name, 'duplicate_key' AS "check",
       (SELECT COUNT(*) FROM (SELECT patient_id FROM silver GROUP BY patient_id HAVING COUNT(*) > 1))
         AS violations
UNION ALL SELECT 'silver_patient_visits', 'null_key', COUNT(*) FROM silver WHERE patient_id IS NULL
UNION ALL SELECT 'dim_patient', 'duplicate_key',
  (SELECT COUNT(*) FROM (SELECT patient_id FROM dim_patient GROUP BY patient_id HAVING COUNT(*) > 1))
UNION ALL SELECT 'dim_patient', 'null_key', COUNT(*) FROM dim_patient WHERE patient_id IS NULL
UNION ALL SELECT 'dim_visit_metrics', 'duplicate_key',
  (SELECT COUNT(*) FROM (SELECT visit_id FROM dim_visit_metrics GROUP BY visit_id HAVING COUNT(*) > 1))
UNION ALL SELECT 'dim_visit_metrics', 'null_key', COUNT(*) FROM dim_visit_metrics WHERE visit_id IS NULL
UNION ALL SELECT 'fact_patient_visits', 'duplicate_key',
  (SELECT COUNT(*) FROM (SELECT id FROM fact GROUP BY id HAVING COUNT(*) > 1))
UNION ALL SELECT 'fact_patient_visits', 'null_key', COUNT(*) FROM fact WHERE id IS NULL
UNION ALL SELECT 'gold_patient_risk_summary', 'duplicate_key',
  (SELECT COUNT(*) FROM (SELECT visit_id FROM gold GROUP BY visit_id HAVING COUNT(*) > 1))
UNION ALL SELECT 'gold_patient_risk_summary', 'null_key', COUNT(*) FROM gold WHERE visit_id IS NULL
UNION ALL SELECT 'gold_risk_distribution', 'duplicate_key',
  (SELECT COUNT(*) FROM (SELECT risk_level FROM (SELECT risk_level FROM fact GROUP BY risk_level)
                         GROUP BY risk_level HAVING COUNT(*) > 1))
UNION ALL SELECT 'gold_risk_distribution', 'null_key', COUNT(*) FROM (
  SELECT DISTINCT risk_level FROM fact) WHERE risk_level IS NULL
UNION ALL SELECT 'fact_patient_visits', 'orphan_patient_id',
  COUNT(*) FROM fact f WHERE NOT EXISTS (SELECT 1 FROM dim_patient p WHERE p.patient_id = f.patient_id)
UNION ALL SELECT 'fact_patient_visits', 'orphan_visit_id',
  COUNT(*) FROM fact f WHERE NOT EXISTS (SELECT 1 FROM dim_visit_metrics v WHERE v.visit_id = f.visit_id)"""))
def q_integrity(spark, d):
    from .. import catalog as C
    m = T.mart(spark, d)
    tabs = {"silver_patient_visits": m["silver"], "dim_patient": m["dim_patient"],
            "dim_visit_metrics": m["dim_visit_metrics"], "fact_patient_visits": m["fact"],
            "gold_patient_risk_summary": m["gold_patient_risk_summary"],
            "gold_risk_distribution": m["gold_risk_distribution"]}
    return V.integrity_report(tabs, C.PRIMARY_KEYS, C.FOREIGN_KEYS)
