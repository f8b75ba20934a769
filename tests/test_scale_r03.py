"""Steps that grew with the data: broadcasts of large sides, files per task, work per row."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskmart import session
from riskmart.functions import constants as K
from riskmart.functions import scalars as S
from riskmart.operators.profile import box_stats
from riskmart.operators.quantiles import grouped_exact_quantiles


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_quantile_rows_are_not_broadcast(spark):
    rows = spark.range(2000).select((F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 7).cast("double").alias("x"))
    out = grouped_exact_quantiles(rows, ["g"], "x", [0.25, 0.5, 0.75])
    assert "BroadcastHashJoin" not in plan(out)
    got = {r["g"]: (r["q0"], r["q1"], r["q2"]) for r in out.collect()}
    for g in range(3):
        x = [i % 7 for i in range(2000) if i % 3 == g]
        assert got[str(g)] == pytest.approx(tuple(np.quantile(x, [0.25, 0.5, 0.75])))


def test_box_stats_repeated_and_missing_values(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), float(rnd.choice([1, 1, 1, 2, 50, -0.5]))) for _ in range(500)] + [("a", None), (None, 1.0), ("c", None)]
    got = {r["g"]: r for r in box_stats(spark.createDataFrame(rows, "g string, x double"), "x", ["g"]).collect()}
    assert set(got) == {"a", "b"}
    for g in "ab":
        x = np.array([v for k, v in rows if k == g and v is not None])
        q1, q3 = np.quantile(x, [0.25, 0.75])
        assert (got[g]["q1"], got[g]["q3"]) == pytest.approx((q1, q3))
        assert got[g]["n_outliers"] == int(((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))).sum())


def test_star_and_encounters_broadcast_no_table(spark, tmp_path):
    from riskmart import tables as T
    from riskmart.plans import warehouse as W
    d = "/root/testdata/sf0.001"
    enc = T.encounters_lazy(spark, d)
    assert "BroadcastHashJoin" not in plan(enc)
    silver = spark.createDataFrame([(1, 10)], "patient_id long, visit_id long")
    fact = silver.select("*", F.lit(0.5).alias("risk_score"), F.lit("Low").alias("risk_level"))
    dv = silver.select("visit_id", F.lit(1).alias("time_in_hospital"), F.lit(2).alias("num_medications"))
    assert "BroadcastHashJoin" not in plan(W.hospital_kpis(fact, dv))


def test_code_category_parses_the_number_once(spark):
    expr = S.code_category("c")
    df = spark.createDataFrame([("250.83",), ("785",), ("V58",), ("E1",), ("?",), ("x",), (None,), (" 251 ",), ("459.5",), ("999",)], "c string")
    assert plan(df.select(expr.alias("x"))).count("RLIKE") <= 1
    want = ["Diabetes", "Circulatory", "Supplementary", "External", "Other", "Other", "Other", "Other", "Other", "Injury"]
    assert [r[0] for r in df.select(expr).collect()] == want
    assert K.DIAG_DEFAULT == "Other"


def test_arrivals_fill_the_task_slots(spark):
    from riskmart.streaming import jobs as J
    per = J.files_per_arrival(spark, 3)
    assert 3 * per >= session.parallelism(spark) and 3 * (per - 1) < session.parallelism(spark)


def test_changes_take_one_file_per_bucket(spark, tmp_path):
    from riskmart.plans import incremental as I
    rows = spark.range(0, 4000, 1, 8).select("id", (F.col("id") % 4).alias("bucket"))
    I._write(rows, str(tmp_path / "t"), 0, ["bucket"])
    assert all(len(list(p.rglob("*.parquet"))) == 1 for p in (tmp_path / "t").glob("bucket=*"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4000


def test_wide_stages_leave_whole_stage_code(spark):
    assert int(session.configure(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
