"""Block moments, iteratively reweighted least squares and trees as SQL."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskmart.functions import constants as K
from riskmart.operators import gram as GR
from riskmart.operators import linear as LI
from riskmart.operators import ml as ML
from riskmart.operators import trees as TR
from riskmart.plans import q_ml
from riskmart.plans import sqlgen as G
from riskmart.session import scratch_path
from tests.conftest import SF_SMALL


def with_gaps(n, k, offset=0.0, seed=1):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, k)) @ rnd.normal(size=(k, k)) + offset
    x[rnd.random(x.shape) < 0.2] = np.nan
    return x


def frame(spark, x):
    k = x.shape[1]
    rows = [tuple(None if math.isnan(v) else float(v) for v in r) for r in x]
    return spark.createDataFrame(rows, ", ".join(f"x{i} double" for i in range(k))), [f"x{i}" for i in range(k)]


@pytest.mark.parametrize("offset", [0.0, 1e8])
def test_moments_against_pairwise_numpy(spark, offset):
    x = with_gaps(3000, 5, offset)
    df, names = frame(spark, x)
    got = {(r["a"], r["b"]): r for r in GR.moments(df.repartition(13), names).collect()}
    assert len(got) == 25
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            u, v = x[both, i], x[both, j]
            r = got[a, b]
            assert r["n"] == both.sum()
            assert r["mean_a"] == pytest.approx(u.mean(), rel=1e-12, abs=1e-9)
            assert r["var_a"] == pytest.approx(u.var(), rel=1e-6)
            assert r["cov"] == pytest.approx(((u - u.mean()) * (v - v.mean())).mean(), rel=1e-5, abs=1e-7)
            assert r["corr"] == pytest.approx(np.corrcoef(u, v)[0, 1], rel=1e-6, abs=1e-8)


def test_moments_of_edge_tables(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (2.0, None, 5.0), (None, 3.0, 5.0)], "a double, b double, c double")
    got = {(r["a"], r["b"]): (r["n"], r["corr"]) for r in GR.moments(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == (0, None) and got["a", "c"] == (2, None) and got["b", "b"] == (1, None)
    assert got["a", "a"] == (2, 1.0) and got["c", "c"] == (3, None)
    assert GR.moments(df.where("false"), ["a", "b"]).count() == 0


def test_merging_does_not_depend_on_the_split():
    x = with_gaps(500, 4, 1e6)
    whole = GR.add_moments(None, x)
    parts = None
    for lo in range(0, 500, 37):
        parts = GR.add_moments(parts, x[lo:lo + 37])
    assert np.allclose(whole, parts, rtol=1e-9, atol=1e-6)
    empty = GR._moments(np.full((3, 4), np.nan))
    assert np.allclose(GR.merge_moments(empty.ravel(), whole.ravel()), whole)


def newton(x, y, w, c):
    z = np.column_stack((np.nan_to_num(x), np.ones(len(x))))
    b, pen = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], 1 / c), 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(pen), z.T @ (w * (p - y)) + pen * b)
    return b


@pytest.mark.parametrize("c", [1.0, 0.01, 100.0])
def test_weights_are_the_minimum(spark, c):
    rnd = np.random.default_rng(7)
    x = with_gaps(800, 4) * np.array([1.0, 100.0, 0.01, 5.0]) + np.array([0, 1000.0, 3, 0])
    y = (np.nan_to_num(x)[:, 0] + rnd.normal(size=800) > 0).astype(float)
    w = rnd.random(800) + 0.5
    df, names = frame(spark, np.column_stack((x, y, w)))
    model = LI.fit_logistic(df.repartition(5), names[:4], "x4", "x5", inverse_penalty=c)
    want = newton(x, y, w, c)
    assert np.allclose([*model.weights, model.bias], want, rtol=1e-7, atol=1e-9)
    assert 2 <= model.rounds < 30


def test_separable_constant_and_empty_input(spark):
    rows = [(float(i), 7.0, None, float(i > 50), 1.0) for i in range(100)] + [(1.0, 7.0, None, None, 1.0), (2.0, 7.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, label double, weight double")
    m = LI.fit_logistic(df, ["a", "b", "c"])
    assert all(math.isfinite(v) for v in (*m.weights, m.bias)) and m.weights[0] > 0
    scored = ML.predicted(m, df.where("label IS NOT NULL AND weight IS NOT NULL"), "score")
    assert scored.where("prediction = label").count() >= 98
    none = LI.fit_logistic(df.where("false"), ["a", "b", "c"])
    assert none.weights == (0.0, 0.0, 0.0) and none.rounds == 0
    one_class = LI.fit_logistic(df.where("label = 1"), ["a"], rounds=40)
    assert all(math.isfinite(v) for v in (*one_class.weights, one_class.bias))


SETTINGS = {"forest": ("random_forest", {}), "boosted": ("gradient_boosting", {"boosted": {**ML.BOOSTED, "maxIter": 60}})}


@pytest.mark.parametrize("kind", sorted(SETTINGS))
def test_fitted_ensembles_score_alike_in_duckdb(spark, kind):
    """The 200-tree forest and boosted trees: probability, level, percent and advice of
    every row, from the compiled expression in DuckDB against the model itself."""
    name, settings = SETTINGS[kind]
    data = q_ml.model_data(spark, SF_SMALL)
    model = ML.fit(data.where("split = 'train'"), q_ml.FEATURES, ML.estimators("label", "weight", **settings)[name])
    nodes = TR.node_table(model, scratch_path(spark, "nodes")).collect()
    assert TR.kind_of(model) == kind
    if kind == "forest":
        assert len({n["tree"] for n in nodes}) == ML.FOREST["numTrees"]
    raw = {r["row_id"]: r["score"] for r in ML.predicted(model, data).collect()}
    want = {r["row_id"]: r for r in ML.score_batch(model, data).collect()}
    path = scratch_path(spark, "rows")
    data.coalesce(1).write.parquet(path)
    con = duckdb.connect()
    sql = TR.ensemble_sql(nodes, q_ml.FEATURES, kind, "duckdb")
    rows = con.execute(f"""
        SELECT row_id, p, s, {G.rnd_even("s * 100.0", 1)}, level, {G.lookup("level", K.RECOMMENDATIONS)}
        FROM (SELECT *, {G.risk_level("s", "left")} AS level
              FROM (SELECT *, {G.rnd_even("p", 4)} AS s
                    FROM (SELECT row_id, {sql} AS p FROM read_parquet('{path}/*.parquet'))))""").fetchall()
    assert len(rows) == len(want)
    for i, p, s, pct, level, advice in rows:
        assert p == pytest.approx(raw[i], abs=1e-12)
        r = want[i]
        assert (s, pct, level, advice) == (r["risk_score"], r["risk_percentage"], r["risk_level"], r["recommendation"])


def test_spark_reads_the_expression_alike(spark):
    rnd = random.Random(3)
    rows = [tuple(rnd.choice([None, float(rnd.randrange(-5, 40))]) for _ in q_ml.FEATURES) for _ in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in q_ml.FEATURES))

    def walk(row, tree):
        nodes = {n["node"]: n for n in q_ml.FIXED_NODES if n["tree"] == tree}
        n = nodes[0]
        while n["feature"] >= 0:
            x = row[n["feature"]]
            n = nodes[n["left_node"] if x is not None and x <= n["threshold"] else n["right_node"]]
        return n["value"]
    got = df.select(TR.ensemble_column(q_ml.FIXED_NODES, q_ml.FEATURES, TR.FOREST).alias("p")).collect()
    for row, g in zip(df.collect(), got):
        assert g["p"] == pytest.approx(sum(walk(row, t) for t in range(6)) / 6)
    with pytest.raises(ValueError):
        TR.tree_sql(q_ml.FIXED_NODES, ["a b"] * 11)


def test_linear_model_exports_and_importance(spark):
    model = LI.LinearModel(("num_medications", "a"), (0.5, -2.0), 0.1, 3, 0.0)
    top = ML.top_features(ML.feature_importance(model, model.features, spark), 1).collect()
    assert top[0]["feature"] == "a" and top[0]["importance"] == 2.0
    df = spark.createDataFrame([(1, 2.0, None)], "id int, num_medications double, a double")
    assert ML.predicted(model, df).first()["score"] == pytest.approx(1 / (1 + math.exp(-1.1)))
    c = ML.linear_contributions(model, df.fillna(0.0), list(model.features), "id").first()
    assert c["num_medications"] == 0.0 and c["base"] == pytest.approx(1.1)
    assert LI.weights_table(model, spark).where(F.col("term") == "(bias)").first()["weight"] == 0.1


def test_comparison_of_the_three_candidates(spark):
    rows, models, _ = q_ml.train_and_evaluate(spark, SF_SMALL, forest={"numTrees": 5, "maxDepth": 3}, boosted={"maxIter": 3})
    got = {r["model"]: r for r in rows.collect()}
    assert set(got) == set(models) == {"logistic_regression", "random_forest", "gradient_boosting"}
    assert all(0 <= r["auc"] <= 1 and r["tp"] + r["fp"] + r["fn"] + r["tn"] > 0 for r in got.values())
    assert ML.best_model(rows).first()["best_model"] in models
