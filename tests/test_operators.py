"""Order-dependent operators against brute force; aggregates on golden data."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskmart.operators import aggregates as A
from riskmart.operators import profile as P
from riskmart.operators.sequence import (dense_row_id, first_per_key, first_per_key_window,
                                         next_in_order)
from riskmart.plans.q_core import risk_by_age_gender
from tests.fixtures import golden as GD


def skewed_rows(n=3000, seed=7):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        # one key holds about a third of all rows
        key = 0 if rnd.random() < 0.34 else rnd.randint(1, 60)
        ts = base + dt.timedelta(hours=rnd.randint(0, 24 * 90))
        rows.append((key, ts, i, float(rnd.randint(0, 100))))
    return rows


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(skewed_rows(), "k long, ts timestamp, id long, v double")


def test_first_per_key_equals_window(spark, events):
    a = first_per_key(events, "k", ["ts", "id"]).orderBy("k").collect()
    b = first_per_key_window(events, "k", ["ts", "id"]).orderBy("k").collect()
    assert a == b
    last = first_per_key(events, "k", ["ts", "id"], descending=True).orderBy("k").collect()
    pdf = pd.DataFrame(skewed_rows(), columns=["k", "ts", "id", "v"]).sort_values(["ts", "id"])
    expect = pdf.groupby("k").tail(1).sort_values("k")
    assert [r["id"] for r in last] == expect["id"].tolist()


@pytest.mark.parametrize("method,block", [("ranged", "day"), ("blocks", "day"),
                                          ("blocks", "month"), ("blocks", "hour")])
def test_next_in_order_equals_lead(spark, events, method, block):
    got = next_in_order(events, "k", "ts", "id", "id", "nxt", block, method,
                        partitions=7).select("id", "nxt")
    w = Window.partitionBy("k").orderBy("ts", "id")
    ref = events.select("id", F.lead("id").over(w).alias("nxt"))
    assert sorted(got.collect()) == sorted(ref.collect())


def test_dense_row_id(spark, events):
    out = dense_row_id(events, ["ts", "id"], "rid", partitions=5).toPandas()
    out = out.sort_values("rid")
    assert out["rid"].tolist() == list(range(1, len(out) + 1))
    ordered = out.sort_values(["ts", "id"])["rid"].tolist()
    assert ordered == list(range(1, len(out) + 1))


def test_golden_demographic_totals(spark):
    rows = []
    pid = 0
    for grp, gender, avg, n, high in GD.RISK_BY_DEMOGRAPHICS:
        for j in range(n):
            pid += 1
            rows.append((pid, grp, gender, avg, "High" if j < high else "Low"))
    df = spark.createDataFrame(rows, "patient_id long, age_group string, gender string, "
                                     "risk_score double, risk_level string")
    out = {(r["age_group"], r["gender"]): r for r in risk_by_age_gender(df).collect()}
    assert len(out) == 11
    for grp, gender, avg, n, high in GD.RISK_BY_DEMOGRAPHICS:
        r = out[(grp, gender)]
        assert (r["patient_count"], r["high_risk_count"]) == (n, high)
        assert r["avg_risk"] == pytest.approx(avg, rel=1e-12)
    assert sum(r["patient_count"] for r in out.values()) == GD.TOTAL_PATIENTS
    assert sum(r["high_risk_count"] for r in out.values()) == GD.TOTAL_HIGH_RISK


def test_golden_monthly_rate(spark):
    rows = []
    for month, total, readm, _ in GD.READMISSION_TRENDS:
        d = dt.datetime.fromisoformat(month) + dt.timedelta(days=3)
        rows += [(d, j < readm) for j in range(total)]
    df = spark.createDataFrame(rows, "ts timestamp, flag boolean")
    got = {r["month"].isoformat(): r for r in A.monthly_rate(df, "ts", F.col("flag")).collect()}
    for month, total, readm, rate in GD.READMISSION_TRENDS:
        r = got[month]
        assert (r["total_patients"], r["readmissions"], r["readmission_rate"]) == (total, readm, rate)


def test_median_mode_fill(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, "b"), (4.0, None), (None, "a")],
                               "x double, s string")
    out = A.median_mode_fill(df, ["x"], ["s"]).collect()
    # median of 1, 3, 4 is 3; mode tie a/b -> smallest "a"
    assert [tuple(r) for r in out] == [(1.0, "a"), (3.0, "b"), (3.0, "b"), (4.0, "a"), (3.0, "a")]


def test_all_null_mode_is_unknown(spark):
    df = spark.createDataFrame([(None,), (None,)], "s string")
    assert A.modes(df, ["s"]).first()[0] == "Unknown"


def test_zero_filled_levels(spark):
    df = spark.createDataFrame([("Low",), ("Low",), ("High",)], "risk_level string")
    out = {r[0]: (r[1], r[2]) for r in A.zero_filled_levels(df, ["Low", "Medium", "High"]).collect()}
    assert out == {"Low": (2, 66.7), "Medium": (0, 0.0), "High": (1, 33.3)}


def test_box_and_hist(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 100]], "x double")
    b = P.box_stats(df, "x").first()
    assert (b["q1"], b["median"], b["q3"], b["n_outliers"]) == (2.0, 3.0, 4.0, 1)
    h = {r["bin"]: r["count"] for r in P.histogram(df, "x", 4).collect()}
    assert h == {1: 4, 4: 1}


def test_null_profile(spark):
    df = spark.createDataFrame([(1, None), (None, "a"), (3, None)], "a int, b string")
    out = {r[0]: (r[1], r[2]) for r in P.null_profile(df).collect()}
    assert out == {"a": (1, 33.33), "b": (2, 66.67)}


def test_hash_split_class_shares(spark):
    from riskmart.operators.topk import hash_split
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = hash_split(labels, "doc_id", 800, 42)
    shares = {r["quality"]: r["train"] / r["n"] for r in out.groupBy("quality").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("split") == "train", 1)).alias("train")).collect()}
    assert set(shares) == {0, 1}
    for q, share in shares.items():
        assert 0.7 <= share <= 0.9, (q, share)
