"""Scoring on the stream by published models."""

from pyspark.ml import PipelineModel
from pyspark.sql import Row
from pyspark.sql import functions as F

from riskmart.functions import constants as K
from riskmart.operators import ml as ML
from riskmart.operators.linear import LinearModel
from riskmart.session import materialize, scratch_path
from riskmart.streaming import jobs as J
from riskmart.streaming import models as M

SCHEMA = ("encounter_id string, patient_nbr string, race string, gender string, age string, time_in_hospital string, "
          "num_lab_procedures string, num_medications string, number_inpatient string, number_outpatient string, "
          "number_emergency string, diag_1 string, insulin string, change string, readmitted string, admitted_at timestamp")
FEATURES = ["age_numeric", "number_inpatient", "total_visits", "high_lab_procedures", "no_such_column"]


def records(spark, first, n, **changes):
    rows = []
    for i in range(first, first + n):
        r = dict(encounter_id=str(i), patient_nbr=str(i % 20), race=None, gender="Male", age=["[50-60)", "[80-90)", None][i % 3],
                 time_in_hospital="3", num_lab_procedures=str(i % 60), num_medications="7", number_inpatient=str(i % 5),
                 number_outpatient="1", number_emergency=None, diag_1="250.1", insulin="No", change="Ch", readmitted="NO",
                 admitted_at=None)
        rows.append(tuple((r | changes).values()))
    return materialize(spark.createDataFrame(rows, SCHEMA), "t-live")


def model(shift=0.0):
    return LinearModel(tuple(FEATURES), (0.01, 0.3, 0.1, 0.5, 9.0), -2.0 + shift, 0, 0.0)


def wanted(i, shift=0.0, cut=30):
    import math
    age = {0: 55.0, 1: 85.0, 2: 55.0}[i % 3]
    m = 0.01 * age + 0.3 * (i % 5) + 0.1 * (i % 5 + 1) + 0.5 * (i % 60 > cut) - 2.0 + shift
    return round(1 / (1 + math.exp(-m)), 4)


def predictions(spark, root):
    return {r["prediction_id"]: r for r in spark.read.parquet(f"{root}/model_predictions").collect()}


def test_swap_between_batches_and_replay(spark):
    root = scratch_path(spark, "t-swap")
    registry = f"{root}/registry"
    a, b = records(spark, 0, 40), records(spark, 40, 40)
    M.publish(spark, registry, "one", model(), FEATURES, 30.0)
    J.live_batch(f"{root}/wh", registry=registry)(a, 0)
    M.publish(spark, registry, "two", model(1.0), FEATURES, 10.0)
    run = J.live_batch(f"{root}/wh", registry=registry)
    run(b, 1)
    run(a, 0)                                   # a replay keeps the version of its batch
    got = predictions(spark, f"{root}/wh")
    assert len(got) == 80
    for i, r in got.items():
        late = i >= 40
        assert r["model_version"] == ("two" if late else "one")
        assert abs(r["risk_score"] - wanted(i, 1.0 if late else 0.0, 10 if late else 30)) < 1.01e-4
    versions = M.versions(spark, registry)
    assert sorted((r["seq"], r["version"]) for r in versions.collect()) == [(0, "one"), (1, "two")]
    # back to the first model: its row is named again, nothing is fitted or copied
    one = versions.where("version = 'one'").drop("seq").first()
    M.announce(spark, registry, one)
    assert M.current(spark, registry)["version"] == "one"


def test_pipeline_on_the_stream_equals_batch_scoring(spark):
    root = scratch_path(spark, "t-forest")
    rows = records(spark, 0, 200)
    feats = M.live_features(rows, FEATURES, 30.0).withColumn("label", (F.col("number_inpatient") > 2).cast("double")) \
        .withColumn("weight", F.lit(1.0))
    forest = ML.fit(feats, FEATURES, ML.estimators("label", "weight", forest={"numTrees": 8, "maxDepth": 3})["random_forest"])
    assert isinstance(forest, PipelineModel)
    M.publish(spark, f"{root}/registry", "forest", forest, FEATURES, 30.0)
    J.land_files(rows, f"{root}/in", 3, ["encounter_id"])
    J.live_pipeline(spark, f"{root}/in", f"{root}/wh", f"{root}/ckpt", max_files=1, registry=f"{root}/registry")
    want = {int(r["__raw"]["encounter_id"]): (r["risk_score"], r["risk_level"], r["risk_percentage"])
            for r in ML.score_batch(forest, feats).collect()}
    got = {i: (r["risk_score"], r["risk_level"], r["risk_percentage"]) for i, r in predictions(spark, f"{root}/wh").items()}
    assert got == want
    kpis = J.read_gold(spark, f"{root}/wh", "gold_hospital_kpis").first()
    assert kpis["total_patients"] == 20


def test_no_model_broken_model_and_unreadable_records(spark):
    root = scratch_path(spark, "t-broken")
    registry = f"{root}/registry"
    fallback = (K.FALLBACK_SCORE, K.FALLBACK_LEVEL, M.NO_MODEL)
    J.live_batch(f"{root}/wh", registry=registry)(records(spark, 0, 5), 0)            # nothing published
    M.announce(spark, registry, Row(version="bad", kind="pipeline", path=f"{root}/nowhere", features=FEATURES, lab_threshold=None))
    run = J.live_batch(f"{root}/wh", registry=registry)
    run(records(spark, 5, 5), 1)                                                       # files are missing
    M.publish(spark, registry, "good", model(), FEATURES, 30.0)
    run(records(spark, 10, 5, number_inpatient="many"), 2)
    run(records(spark, 15, 5), 3)
    run(records(spark, 20, 0), 4)                                                      # an empty batch
    got = {i: (r["risk_score"], r["risk_level"], r["model_version"]) for i, r in predictions(spark, f"{root}/wh").items()}
    assert len(got) == 20
    assert all(got[i] == fallback for i in range(10))
    assert all(got[i] == (K.FALLBACK_SCORE, K.FALLBACK_LEVEL, "good") for i in range(10, 15))
    assert all(abs(got[i][0] - wanted(i)) < 1.01e-4 and got[i][2] == "good" for i in range(15, 20))
