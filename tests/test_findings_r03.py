"""Findings of the third round: rows of the tests' own, small enough to check by hand."""

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from riskmart.operators import ml as ML
from riskmart.plans import q_ml


def _rows(spark, n=400):
    """Rows with the model's columns, a label that follows two of them, and a split."""
    cols = [((F.col("id") * (7 + 2 * i)) % (5 + i)).cast("double").alias(c) for i, c in enumerate(q_ml.FEATURES)]
    return (spark.range(n).select(F.col("id").alias("row_id"), *cols)
            .withColumn("label", ((F.col("age_numeric") + F.col("number_inpatient")) > 4).cast("double"))
            .withColumn("weight", F.lit(1.0)).withColumn("split", F.when(F.col("row_id") % 5 == 0, "test").otherwise("train")))


def test_forest_keeps_each_rows_node(spark):
    """passes read a row's node instead of walking every tree; the forest is the same."""
    df = _rows(spark).coalesce(2).cache()
    rf = ML.estimators(forest={"numTrees": 6, "maxDepth": 6, "minInstancesPerNode": 2})["random_forest"]
    assert rf.getCacheNodeIds()
    kept, walked = ML.fit(df, q_ml.FEATURES, rf), ML.fit(df, q_ml.FEATURES, rf.copy().setCacheNodeIds(False))
    assert kept.stages[-1].toDebugString.split("\n", 1)[1] == walked.stages[-1].toDebugString.split("\n", 1)[1]


def test_candidates_are_fitted_together_and_scored_once(spark, monkeypatch):
    """the boosted trees' fit starts before the forest's has ended, and no metric or
    export scores the rows again."""
    import threading
    both = threading.Barrier(2, timeout=60)
    inside, scored = Pipeline.fit, []

    def fit(self, df, params=None):
        both.wait()
        return inside(self, df, params)
    predicted = ML.predicted
    monkeypatch.setattr(q_ml, "model_data", lambda s, d, features=None: _rows(s))
    monkeypatch.setattr(ML, "Pipeline", type("P", (Pipeline,), {"fit": fit}))
    monkeypatch.setattr(ML, "predicted", lambda *a: scored.append(a[2]) or predicted(*a))
    rows, models, _ = q_ml.train_and_evaluate(spark, "", forest={"numTrees": 3, "maxDepth": 3}, boosted={"maxIter": 2})
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert {r["model"] for r in rows.collect()} == set(models) and len(scored) == 3
    assert "UDF" not in plan and "1.0 / (1.0 + " not in plan


def test_blocks_follow_what_the_grids_prune():
    """op2: evenly spread vectors are met once, not once for each of four blocks."""
    import numpy as np

    from riskmart.llm import vector_join as V
    rnd = np.random.default_rng(3)
    even = rnd.normal(size=(3000, 64))
    assert len(V._frame([x.tobytes() for x in even], 64, 0.9, "f8")["budget"]) == 1
    steep = rnd.normal(size=(3000, 64)) * 0.02
    steep[:, :4] += rnd.normal(size=(3000, 4))
    frame = V._frame([x.tobytes() for x in steep], 64, 0.9, "f8")
    for f in (frame, V._frame([], 5, 0.9, "f4")):
        assert abs(f["budget"].sum() - 0.2) < 1e-9
        assert np.allclose(sum(r @ r.T for r in f["rotation"]), np.eye(len(f["rotation"][0])))


def test_links_equal_brute_force_at_the_threshold(spark, monkeypatch):
    """op2: pairs found with one and with four blocks are those of all pairs, each counted once."""
    import numpy as np

    from riskmart.llm import vector_join as V
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(60, 64))
    x = np.concatenate([base] + [base + rnd.normal(size=base.shape) * s for s in (0.1, 0.3, 0.45, 0.5, 0.55)])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for test in (20, -10 ** 9):       # a negative cost makes most blocks the choice
        monkeypatch.setattr(V, "TEST", test)
        got = {r["vec_id"]: r["n_links"] for r in V.vector_components(df).collect()}
        assert [got[i] for i in range(len(u))] == link.sum(axis=1).tolist()


def test_components_joined_by_later_links(spark):
    """op1: components joined by further links are those of a search over all links."""
    from riskmart.llm.components import component_edges, connected_components, merged
    first = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (20, 21), (30, 31)], "a long, b long")
    more = spark.createDataFrame([(3, 11), (21, 40), (50, 51), (51, 40), (2, 1)], "a long, b long")
    comp = connected_components(first)
    got = merged(comp, connected_components(component_edges(more, comp), "ca", "cb"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, connected_components(first.union(more)).collect()))
