"""Sources, sinks, streaming and ML behaviour on small fixtures."""

import os
import re

import pytest
from pyspark.sql import functions as F

from riskmart import catalog as C
from riskmart.operators import ml as ML
from riskmart.session import scratch_path
from riskmart.sources import readers as R
from riskmart.sources import sinks as SK
from riskmart.streaming import jobs as J
from riskmart.streaming.jobs import read_gold

# FIXED VALUES: layout of a stacked code-table file (CRLF, quoted commas, NULL
# text label, leading blanks, an id out of order, "," separator lines)
CODE_TABLE = (
    "admission_type_id,description\r\n1,Emergency\r\n2,Urgent\r\n6,NULL\r\n,\r\n"
    "discharge_disposition_id,description\r\n1,Discharged to home\r\n"
    '19,"Expired at home. Medicaid only, hospice."\r\n30,Discharged to another facility\r\n'
    "25,Not Mapped\r\n,\r\n"
    "admission_source_id,description\r\n1, Physician Referral\r\n2,Clinic Referral\r\n"
)



def test_code_sections(spark, tmp_path):
    p = tmp_path / "IDs_mapping.csv"
    p.write_bytes(CODE_TABLE.encode())
    rows = sorted(tuple(r) for r in R.code_sections(spark, str(p)).collect())
    assert rows == sorted([
        ("admission_type_id", 1, "Emergency"), ("admission_type_id", 2, "Urgent"),
        ("admission_type_id", 6, "NULL"),
        ("discharge_disposition_id", 1, "Discharged to home"),
        ("discharge_disposition_id", 19, "Expired at home. Medicaid only, hospice."),
        ("discharge_disposition_id", 30, "Discharged to another facility"),
        ("discharge_disposition_id", 25, "Not Mapped"),
        ("admission_source_id", 1, "Physician Referral"),
        ("admission_source_id", 2, "Clinic Referral"),
    ])


def test_csv_null_tokens(spark, tmp_path):
    p = tmp_path / "raw.csv"
    p.write_text("a,b,c\n1,?,None\n2,x,NA\n")
    df = R.read_csv(spark, str(p), schema="a int, b string, c string",
                    tokens=["?", "None", "NA"])
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, None, None), (2, "x", None)]


def test_insert_or_ignore_and_replay(spark):
    path = scratch_path(spark, "t-ins")
    a = spark.createDataFrame([(1, "a"), (2, "b"), (1, "z")], "k long, v string")
    SK.insert_or_ignore(a, path, ["k"], ["v"])
    b = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    SK.insert_or_ignore(b, path, ["k"], ["v"])
    SK.insert_or_ignore(b, path, ["k"], ["v"])
    got = sorted(tuple(r) for r in spark.read.parquet(path).collect())
    assert got == [(1, "a"), (2, "b"), (3, "d")]


def test_batch_partition_replay(spark):
    path = scratch_path(spark, "t-part")
    SK.write_batch_partition(spark.range(3), path, 0)
    SK.write_batch_partition(spark.range(4), path, 1)
    SK.write_batch_partition(spark.range(3), path, 0)   # replay
    df = spark.read.parquet(path)
    assert df.count() == 7
    assert df.where("batch_id = 0").count() == 3


def test_ensure_table(spark):
    path = scratch_path(spark, "t-tab")
    t = SK.ensure_table(spark, path, C.PATIENTS)
    assert t.count() == 0 and t.columns == [f.name for f in C.PATIENTS.fields]
    assert SK.ensure_table(spark, path, C.PATIENTS).count() == 0


def test_stream_equals_batch(spark):
    root = scratch_path(spark, "t-stream")
    rows = [(i, ["a", "b", "c"][i % 3], float(i), i % 7) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, lvl string, v double, u long")
    J.land_files(df, f"{root}/in", 6, ["id"])
    s = R.stream_source(spark, f"{root}/in", df.schema, "parquet", max_files=1)
    J.complete_to_table(J.band_counts(s, "lvl", "v"), f"{root}/out", f"{root}/ck")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{root}/out").collect())
    want = sorted(tuple(r) for r in df.groupBy(F.col("lvl").alias("level"))
                  .agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("avg_value")).collect())
    assert got == want
    s2 = R.stream_source(spark, f"{root}/in", df.schema, "parquet", max_files=2)
    J.complete_to_table(J.distinct_per_level(s2, "u", "lvl"), f"{root}/out2", f"{root}/ck2")
    got2 = sorted(tuple(r) for r in spark.read.parquet(f"{root}/out2").collect())
    assert got2 == [("a", 7), ("b", 7), ("c", 7)]


def test_model_auc_and_reload(spark):
    rows = [(float(i % 10), float((i * 7) % 13), 1.0 if i % 10 >= 5 else 0.0) for i in range(400)]
    df = spark.createDataFrame(rows, "x1 double, x2 double, label double")
    df = ML.class_weights(df)
    model = ML.fit(df, ["x1", "x2"], ML.estimators("label", "weight", forest={"numTrees": 8, "maxDepth": 5})["random_forest"])
    pred = ML.positive_probability(model.transform(df), "score")
    m = ML.evaluate(pred, "label").first()
    assert m["auc"] > 0.9 and m["accuracy"] > 0.9
    path = scratch_path(spark, "t-model")
    SK.save_model(model, path)
    again = SK.load_model(path)
    a = [r[0] for r in ML.positive_probability(model.transform(df), "s").select("s").collect()]
    b = [r[0] for r in ML.positive_probability(again.transform(df), "s").select("s").collect()]
    assert a == pytest.approx(b)


def test_roc_matches_bruteforce(spark):
    rows = [(round((i * 37 % 100) / 100.0, 2), 1 if (i * 37 % 100) > 40 + (i % 5) * 5 else 0)
            for i in range(200)]
    df = spark.createDataFrame(rows, "score double, label int")
    roc = {r["threshold"]: (r["fpr"], r["tpr"]) for r in ML.roc_points(df).collect()}
    P = sum(l for _, l in rows)
    N = len(rows) - P
    for t in sorted(set(s for s, _ in rows)):
        tp = sum(1 for s, l in rows if s >= t and l == 1)
        fp = sum(1 for s, l in rows if s >= t and l == 0)
        assert roc[t] == pytest.approx((fp / N, tp / P))


def test_label_encoder_nan_class(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "c string")
    model = ML.label_encoder(["c"]).fit(ML.nan_text(df, ["c"]))
    out = [r[0] for r in model.transform(ML.nan_text(df, ["c"])).select("c_idx").collect()]
    assert out == [1.0, 2.0, 0.0, 1.0]      # a < b < nan


def test_checkpoint_dir_from_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(root)
    assert os.path.isdir(root)


def test_live_pipeline_periodic_trigger(spark):
    from riskmart import tables as T
    root = scratch_path(spark, "t-live")
    enc = T.encounters(spark, "/root/testdata/sf0.001")
    J.land_files(enc, f"{root}/in", 3, ["admitted_at", "encounter_id"])
    q = J.live_pipeline(spark, f"{root}/in", f"{root}/wh", f"{root}/ck", max_files=1,
                        trigger_seconds=1)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    fact = spark.read.parquet(f"{root}/wh/fact")
    assert fact.count() == enc.count()
    assert fact.select("batch_id").distinct().count() >= 3
    dist = {r["risk_level"]: r["patient_count"]
            for r in read_gold(spark, f"{root}/wh", "gold_risk_distribution").collect()}
    assert sum(dist.values()) >= enc.select("patient_nbr").distinct().count()


def test_bucketed_insert_or_ignore(spark):
    path = scratch_path(spark, "t-bucket")
    a = spark.createDataFrame([(k, f"v{k}") for k in range(200)], "k long, v string")
    SK.insert_or_ignore(a, path, ["k"], ["v"], batch_id=0, buckets=8)
    b = spark.createDataFrame([(5, "new"), (500, "x"), (501, "y")], "k long, v string")
    SK.insert_or_ignore(b, path, ["k"], ["v"], batch_id=1, buckets=8)
    assert sorted(r["k"] for r in spark.read.parquet(path).where("batch_id = 1")
                  .collect()) == [500, 501]
    SK.insert_or_ignore(b, path, ["k"], ["v"], batch_id=1, buckets=8)   # replay
    stored = spark.read.parquet(path)
    assert stored.count() == 202
    assert stored.where("k = 5").first()["v"] == "v5"
    assert stored.where("batch_id = 1").count() == 2
    assert "batch_id" in stored.columns and "bucket" in stored.columns
    # a bucket filter is a partition filter: only that bucket's directory is read
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        stored.where("bucket = 3").explain()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", buf.getvalue())


def test_stores_rebuild_when_missing(spark):
    from riskmart import tables as T
    from riskmart.session import app_id
    d = "/root/testdata/sf0.001"
    key = (app_id(spark), d)
    n = T.encounters(spark, d).count()
    T._RAW[key] = scratch_path(spark, "never-written")
    assert T.encounters(spark, d).count() == n
    kpis = T.mart(spark, d)["gold_hospital_kpis"].collect()
    T._STORED[key] = {k: scratch_path(spark, "never-written") for k in T._STORED[key]}
    assert T.mart(spark, d)["gold_hospital_kpis"].collect() == kpis


def test_ingest_bronze_modes(spark):
    from riskmart.plans.operational import ingest_bronze
    from riskmart.functions import constants as K
    path = scratch_path(spark, "t-bronze")
    raw = spark.createDataFrame([("1", "10", "Male"), ("2", "11", "Female")],
                                "encounter_id string, patient_nbr string, gender string")
    ingest_bronze(raw, path, "overwrite")
    ingest_bronze(raw, path, "append")
    b = spark.read.parquet(path)
    assert b.count() == 4
    assert b.columns[:len(K.RAW_COLUMNS)] == K.RAW_COLUMNS and "ingested_at" in b.columns
    assert {r["weight"] for r in b.collect()} == {"?"}
    assert {r["metformin"] for r in b.collect()} == {"No"}
    ingest_bronze(raw, path, "overwrite")
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError):
        ingest_bronze(raw, path, "merge")


def test_replay_of_earlier_batches_keeps_gold(spark):
    from riskmart import tables as T
    root = scratch_path(spark, "t-replay")
    enc = T.encounters(spark, "/root/testdata/sf0.001")
    J.land_files(enc, f"{root}/in", 3, ["admitted_at", "encounter_id"])
    J.live_pipeline(spark, f"{root}/in", f"{root}/wh", f"{root}/ck", max_files=1)

    def gold():
        d = sorted(tuple(r) for r in read_gold(spark, f"{root}/wh", "gold_risk_distribution")
                   .collect())
        k = tuple(read_gold(spark, f"{root}/wh", "gold_hospital_kpis").first())
        return d, k

    before = gold()
    fact = spark.read.parquet(f"{root}/wh/fact")
    assert fact.select("batch_id").distinct().count() == 3
    for b in (0, 1):   # replay earlier batches after later ones ran
        ids = fact.where(F.col("batch_id") == b).select(
            F.col("visit_id").cast("string").alias("encounter_id"))
        J.live_batch(f"{root}/wh")(spark.read.parquet(f"{root}/in")
                                   .join(ids, "encounter_id", "left_semi"), b)
    assert gold() == before
    assert spark.read.parquet(f"{root}/wh/fact").count() == enc.count()
