"""Encounter adapter: the provided order tables seen as raw encounter records.

One encounter per order; the patient is the customer. Lines of the order give
the counts. The readmission label comes from the customer's next order date.
All output columns are text, like the raw (bronze) layer, plus the
``admitted_at`` timestamp used to order a patient's encounters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sequence import next_in_order

# FIXED VALUES: diagnosis code by o_orderkey % 14
DIAG_CODES = ["250.83", "410", "486", "560", "820", "715", "590", "150",
              "V58", "E885", "?", "785", "abc", "780"]

# FIXED VALUES: insulin text by order-priority digit (others -> No)
INSULIN_BY_PRIORITY = {"1": "Up", "2": "Down", "3": "Steady"}

ENCOUNTER_COLUMNS = [
    "encounter_id", "patient_nbr", "race", "gender", "age", "time_in_hospital",
    "num_lab_procedures", "num_medications", "number_inpatient",
    "number_outpatient", "number_emergency", "diag_1", "insulin", "change",
    "readmitted", "admitted_at",
]


def line_summary(lineitem: DataFrame) -> DataFrame:
    """Per order: quantity sum, line count, lines per return flag."""
    flag = F.col("l_returnflag")
    return lineitem.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("qty"),
        F.count(F.lit(1)).alias("n_lines"),
        F.count(F.when(flag == "R", 1)).alias("n_r"),
        F.count(F.when(flag == "A", 1)).alias("n_a"),
        F.count(F.when(flag == "N", 1)).alias("n_n"),
    )


def encounters(orders: DataFrame, customer: DataFrame, lineitem: DataFrame) -> DataFrame:
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
                      "o_orderpriority")
    o = next_in_order(o, "o_custkey", "o_orderdate", "o_orderkey", "o_orderdate", "next_date")
    c = customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    m = line_summary(lineitem).withColumnRenamed("l_orderkey", "o_orderkey")
    # a compressed table's file size says little of its rows in memory: nothing that grows
    # with the orders is broadcast
    j = o.join(c.hint("merge"), "o_custkey").join(m.hint("merge"), "o_orderkey", "left")

    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    k = cust % 11
    diag = F.element_at(F.array(*[F.lit(d) for d in DIAG_CODES]), (key % 14 + 1).cast("int"))
    prio = F.substring("o_orderpriority", 1, 1)
    insulin = F.coalesce(
        F.try_element_at(F.create_map(*[x for kv in INSULIN_BY_PRIORITY.items()
                                        for x in (F.lit(kv[0]), F.lit(kv[1]))]), prio),
        F.lit("No"))
    nxt = F.col("next_date")
    readmitted = (F.when(nxt.isNull(), F.lit("NO"))
                  .when(nxt <= F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"), F.lit("<30"))
                  .otherwise(F.lit(">30")))
    s = lambda e: e.cast("string")
    return j.select(
        s(key).alias("encounter_id"),
        s(cust).alias("patient_nbr"),
        F.when(key % 17 == 0, F.lit("?")).otherwise(F.col("c_mktsegment")).alias("race"),
        F.when(cust % 2 == 0, F.lit("Female")).otherwise(F.lit("Male")).alias("gender"),
        F.concat(F.lit("["), s(k * 10), F.lit("-"), s(k * 10 + 10), F.lit(")")).alias("age"),
        s(key % 13 + 1).alias("time_in_hospital"),
        s(F.col("qty").cast("bigint")).alias("num_lab_procedures"),
        s(F.col("n_lines")).alias("num_medications"),
        s(F.col("n_r")).alias("number_inpatient"),
        s(F.col("n_a")).alias("number_outpatient"),
        s(F.col("n_n")).alias("number_emergency"),
        diag.alias("diag_1"),
        insulin.alias("insulin"),
        F.when(F.col("o_orderstatus") == "P", F.lit("Ch")).otherwise(F.lit("No")).alias("change"),
        readmitted.alias("readmitted"),
        F.col("o_orderdate").alias("admitted_at"),
    )


# SQL text of the same adapter, used by the oracle queries.
ENCOUNTERS_SQL = """
enc AS (
  WITH m AS (
    SELECT l_orderkey,
           SUM(l_quantity) AS qty,
           COUNT(*) AS n_lines,
           COUNT(CASE WHEN l_returnflag = 'R' THEN 1 END) AS n_r,
           COUNT(CASE WHEN l_returnflag = 'A' THEN 1 END) AS n_a,
           COUNT(CASE WHEN l_returnflag = 'N' THEN 1 END) AS n_n
    FROM lineitem GROUP BY l_orderkey
  ), o AS (
    SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority,
           LEAD(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
             AS next_date
    FROM orders
  )
  SELECT
    CAST(o.o_orderkey AS VARCHAR) AS encounter_id,
    CAST(o.o_custkey AS VARCHAR) AS patient_nbr,
    CASE WHEN o.o_orderkey % 17 = 0 THEN '?' ELSE c.c_mktsegment END AS race,
    CASE WHEN o.o_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
    '[' || CAST((o.o_custkey % 11) * 10 AS VARCHAR) || '-'
        || CAST((o.o_custkey % 11) * 10 + 10 AS VARCHAR) || ')' AS age,
    CAST(o.o_orderkey % 13 + 1 AS VARCHAR) AS time_in_hospital,
    CAST(CAST(m.qty AS BIGINT) AS VARCHAR) AS num_lab_procedures,
    CAST(m.n_lines AS VARCHAR) AS num_medications,
    CAST(m.n_r AS VARCHAR) AS number_inpatient,
    CAST(m.n_a AS VARCHAR) AS number_outpatient,
    CAST(m.n_n AS VARCHAR) AS number_emergency,
    ['250.83','410','486','560','820','715','590','150','V58','E885','?','785','abc','780']
        [CAST(o.o_orderkey % 14 AS INTEGER) + 1] AS diag_1,
    CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'Up' WHEN '2' THEN 'Down'
         WHEN '3' THEN 'Steady' ELSE 'No' END AS insulin,
    CASE WHEN o.o_orderstatus = 'P' THEN 'Ch' ELSE 'No' END AS change,
    CASE WHEN o.next_date IS NULL THEN 'NO'
         WHEN o.next_date <= o.o_orderdate + INTERVAL 30 DAY THEN '<30'
         ELSE '>30' END AS readmitted,
    o.o_orderdate AS admitted_at
  FROM o
  JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN m ON o.o_orderkey = m.l_orderkey
)"""
