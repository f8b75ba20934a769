"""Training, scoring and explanation queries (TRN-*, SCO-3, EXP-*)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import ml as ML
from ..operators import trees as TR
from ..operators.linear import fit_logistic, weights_table
from ..operators.topk import hash_split
from . import sqlgen as G
from .q_jobs import FEATURES_SQL, OPS_SQL, clean_sql, features_df, operational
from .registry import query

FEATURES = ["age_numeric", "number_inpatient", "number_outpatient", "number_emergency",
            "num_medications", "num_lab_procedures", "time_in_hospital", "total_visits",
            "medication_change", "high_lab_procedures", "insulin_flag"]


def model_data(spark, d, features=None):
    """Feature rows with label, balanced weights and an 80/20 hash split. ``features``:
    already engineered rows, if the caller has them."""
    f = features_df(spark, d, keep_ids=True) if features is None else features
    f = f.select(F.col("encounter_id").try_cast("long").alias("row_id"),
                 *[F.col(c).cast("double").alias(c) for c in FEATURES],
                 F.col("readmitted_binary").cast("double").alias("label"))
    f = hash_split(f, "row_id", 800, 42)
    # every model fit and evaluation reads this frame: store it once
    from ..session import materialize
    return materialize(ML.class_weights(f, "label", "weight", F.col("split") == "train"), "model-data")


def train_and_evaluate(spark, d, forest=None, boosted=None):
    """Metrics, fitted models and rows. The models are fitted side by side: the boosted
    trees are a long chain of small jobs that leaves most task slots to the forest."""
    from ..session import in_thread, materialize
    data = model_data(spark, d)
    train = data.where(F.col("split") == "train")
    test = data.where(F.col("split") == "test")
    fits = {"logistic_regression": (fit_logistic, train, FEATURES)}
    for name, est in ML.estimators("label", "weight", forest, boosted).items():
        fits[name] = (ML.fit, train, FEATURES, est)
    with ThreadPoolExecutor(len(fits)) as pool:
        running = {name: pool.submit(in_thread(spark, fit), *args) for name, (fit, *args) in fits.items()}
        models = {name: f.result() for name, f in running.items()}
    rows = None
    for name, model in models.items():
        # the metrics read the scores several times, a forest scores them once
        pred = materialize(ML.predicted(model, test, "score"), "scored-" + name)
        r = ML.evaluate(pred, "label").select(F.lit(name).alias("model"), "*")
        rows = r if rows is None else rows.unionByName(r)
    return rows, models, data


def training_exports(best, test, comparison, root: str) -> None:
    """Hold-out predictions, risk by age group, level counts, patient summary
    and the model comparison as CSV (SNK-9)."""
    from ..functions import scalars as S
    from ..operators.aggregates import level_counts
    from ..session import materialize
    from ..sources.sinks import export_csv
    # four exports read the scores
    pred = materialize(ML.predicted(best, test, "risk_score").drop("prediction"), "scored")
    pred = (pred.withColumnRenamed("label", "actual_readmitted")
            .withColumn("risk_percentage", S.percent_even("risk_score", 1))
            .withColumn("risk_level", S.risk_level("risk_score")))
    export_csv(pred, f"{root}/predictions")
    by_age = (pred.withColumn("age_group", S.age_group("age_numeric"))
              .where(F.col("age_group").isNotNull()).groupBy("age_group")
              .agg(F.avg("risk_score").alias("avg_risk_score"),
                   F.count("risk_score").alias("patient_count"),
                   F.sum(S.equals_flag("risk_level", "High")).alias("high_risk_count")))
    export_csv(by_age, f"{root}/risk_by_demographics")
    export_csv(level_counts(pred, "risk_level", "patient_count"), f"{root}/risk_distribution")
    export_csv(pred.select(F.col("age_numeric").alias("age"), "total_visits", "num_medications",
                           "num_lab_procedures", "number_inpatient", "risk_score",
                           "risk_percentage", "risk_level", "actual_readmitted"),
               f"{root}/patient_risk_summary")
    export_csv(comparison, f"{root}/model_comparison")


@query("train_compare", ops=("TRN-1", "TRN-2", "TRN-3", "TRN-4", "TRN-7", "TOP-11", "SNK-9",
                             "AGG-9", "AGG-31"))
def q_train(spark, d):
    from ..session import materialize, scratch_path
    rows, models, data = train_and_evaluate(spark, d)
    rows = materialize(rows, "comparison")
    best = ML.best_model(rows, "model", "auc").select("best_model")
    comparison = rows.crossJoin(best)
    root = scratch_path(spark, "training")
    # the best model's name is one value of a 3-row table
    name = best.first()["best_model"]
    training_exports(models[name], data.where(F.col("split") == "test"), comparison, root)
    schema = ("model string, tp long, fp long, fn long, tn long, accuracy double, "
              "precision double, recall double, f1 double, auc double, best_model string")
    return spark.read.option("header", True).schema(schema).csv(f"{root}/model_comparison")


# ------------------------------------------------------------------ the linear model
# its weights are the one minimum of a convex objective, so SQL can find them too
ROUNDS_SQL = 12


def model_rows_sql() -> str:
    cols = ", ".join(f"COALESCE(CAST({c} AS DOUBLE), 0) AS {c}" for c in FEATURES)
    return f"""
mdata AS (SELECT TRY_CAST(encounter_id AS BIGINT) AS row_id, {cols}, CAST(readmitted_binary AS DOUBLE) AS label FROM feat),
msplit AS MATERIALIZED (SELECT *, {G.hash_rank("row_id")} % 1000 < 800 AS train FROM mdata),
mtrain AS MATERIALIZED (
  SELECT t.*, total / (2.0 * n) AS w
  FROM msplit t JOIN (SELECT label, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS total FROM msplit WHERE train GROUP BY label) c
    ON t.label = c.label WHERE t.train)"""


def newton_sql(features, rounds: int = ROUNDS_SQL) -> str:
    """CTE ``fitted(b)``: the weights (bias last) after Newton rounds from zero over
    ``mtrain``; every round sums the weighted cross products and eliminates k + 1
    columns of the augmented matrix."""
    x = [*features, "1.0"]
    k = len(x)
    margin = " + ".join(f"b[{i + 1}] * {c}" for i, c in enumerate(x))
    rows = ", ".join(
        "[" + ", ".join([f"SUM(v * {a} * {b})" + (" + 1.0" if i == j < k - 1 else "") for j, b in enumerate(x)]
                        + [f"SUM(w * (p - label) * {a})" + (f" + ANY_VALUE(b[{i + 1}])" if i < k - 1 else "")]) + "]"
        for i, a in enumerate(x))
    inner = f"""
SELECT r, b, [{rows}] AS m FROM (
  SELECT *, w * p * (1 - p) AS v FROM (SELECT n.r, n.b, t.*, 1.0 / (1.0 + exp(-({margin}))) AS p
                                       FROM newton n, mtrain t WHERE n.r < {rounds})) GROUP BY r, b"""
    for j in range(1, k + 1):
        inner = f"""SELECT r, b, list_transform(m, lambda e, i: CASE WHEN i = {j}
  THEN list_transform(e, lambda z: z / e[{j}])
  ELSE list_transform(e, lambda z, c: z - m[{j}][c] * e[{j}] / m[{j}][{j}]) END) AS m FROM ({inner})"""
    return f"""
newton AS (
  SELECT 0 AS r, [{", ".join(["0.0::DOUBLE"] * k)}] AS b
  UNION ALL
  SELECT r + 1, list_transform(b, lambda z, i: z - m[i][{k + 1}]) FROM ({inner})),
fitted AS (SELECT b FROM newton WHERE r = {rounds})"""


def linear_sql(body: str) -> str:
    return G.with_ctes(G.ENC, body, clean_sql(True) + "," + FEATURES_SQL + "," + model_rows_sql() + ","
                       + newton_sql(FEATURES)).replace("WITH ", "WITH RECURSIVE ", 1)


MARGIN_SQL = " + ".join([f"b[{i + 1}] * {c}" for i, c in enumerate(FEATURES)] + [f"b[{len(FEATURES) + 1}]"])
MEANS_SQL = f"""(SELECT {", ".join(f"AVG({c}) AS m_{c}" for c in FEATURES)} FROM msplit WHERE train)"""


def linear_model(spark, d, features=None):
    """(fitted model, all rows, training rows)."""
    data = model_data(spark, d, features)
    train = data.where(F.col("split") == "train")
    return fit_logistic(train, FEATURES), data, train


@query("logit_weights", ops=("TRN-1",), sql=linear_sql(f"""
SELECT term, ROUND(weight, 7) AS weight
FROM (SELECT unnest([{", ".join(f"'{c}'" for c in (*FEATURES, "(bias)"))}]) AS term, unnest(b) AS weight FROM fitted)"""))
def q_logit_weights(spark, d):
    model, _, _ = linear_model(spark, d)
    return weights_table(model, spark).select("term", F.round("weight", 7).alias("weight"))


@query("logit_evaluation", ops=("TRN-1", "TRN-4"), sql=linear_sql(f"""
SELECT CAST(SUM(hit * label) AS BIGINT) AS tp, CAST(SUM(hit * (1 - label)) AS BIGINT) AS fp,
       CAST(SUM((1 - hit) * label) AS BIGINT) AS fn, CAST(SUM((1 - hit) * (1 - label)) AS BIGINT) AS tn,
       AVG(CASE WHEN hit = label THEN 1.0 ELSE 0.0 END) AS accuracy,
       COALESCE(SUM(hit * label) / NULLIF(SUM(hit), 0), 0) AS precision,
       COALESCE(SUM(hit * label) / NULLIF(SUM(label), 0), 0) AS recall,
       COALESCE(2 * SUM(hit * label) / NULLIF(SUM(hit) + SUM(label), 0), 0) AS f1, ANY_VALUE(auc) AS auc
FROM (SELECT label, CASE WHEN score > 0.5 THEN 1.0 ELSE 0.0 END AS hit FROM tested),
     (SELECT SUM(neg * (above + pos / 2.0)) / (SUM(pos) * SUM(neg)) AS auc
      FROM (SELECT pos, neg, COALESCE(SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING
                                                     AND 1 PRECEDING), 0) AS above
            FROM (SELECT score, SUM(label) AS pos, SUM(1 - label) AS neg FROM tested GROUP BY score)))""").replace(
    "\nSELECT CAST(SUM(hit", f""", tested AS (
  SELECT label, ROUND(1.0 / (1.0 + exp(-({MARGIN_SQL}))), 9) AS score FROM msplit, fitted WHERE NOT train)
SELECT CAST(SUM(hit""", 1))
def q_logit_evaluation(spark, d):
    model, data, _ = linear_model(spark, d)
    # nine decimals: rows whose scores differ by rounding noise only are ties
    pred = ML.predicted(model, data.where(F.col("split") == "test"), "score").withColumn("score", F.round("score", 9))
    return ML.evaluate(pred.withColumn("prediction", (F.col("score") > 0.5).cast("double")), "label")


@query("batch_score", ops=("SCO-3", "SCA-24", "SCA-5", "TRN-1"), sql=linear_sql(f"""
SELECT row_id, risk_score, {G.rnd_even("risk_score * 100.0", 1)} AS risk_percentage, risk_level,
       {G.lookup("risk_level", K.RECOMMENDATIONS)} AS recommendation
FROM (SELECT row_id, risk_score, {G.risk_level("risk_score", "left")} AS risk_level
      FROM (SELECT row_id, {G.rnd_even(f"1.0 / (1.0 + exp(-({MARGIN_SQL})))", 4)} AS risk_score FROM msplit, fitted))"""))
def q_batch_score(spark, d):
    model, data, _ = linear_model(spark, d)
    return ML.score_batch(model, data).select("row_id", "risk_score", "risk_percentage", "risk_level", "recommendation")


@query("top_features", ops=("TRN-8", "TOP-4", "SCA-24"))
def q_top_features(spark, d):
    data = model_data(spark, d)
    rf = ML.estimators("label", "weight")["random_forest"]
    model = ML.fit(data.where(F.col("split") == "train"), FEATURES, rf)
    return ML.top_features(ML.feature_importance(model, FEATURES, spark), 5)


@query("top_factors_linear", ops=("TRN-8", "TOP-4", "SCA-24"), sql=linear_sql(f"""
SELECT feature, ROUND(importance, 4) AS importance, {G.lookup("feature", K.FEATURE_DISPLAY_NAMES)} AS display_name
FROM (SELECT unnest([{", ".join(f"'{c}'" for c in FEATURES)}]) AS feature, abs(unnest(b[1:{len(FEATURES)}])) AS importance
      FROM fitted) ORDER BY importance DESC, feature LIMIT 5""").replace(
    "AS display_name", "AS shown", 1).replace("SELECT feature, ROUND(importance, 4) AS importance,",
                                              "SELECT feature, ROUND(importance, 4) AS importance, COALESCE(", 1).replace(
    "AS shown", ", feature) AS display_name", 1))
def q_top_factors_linear(spark, d):
    model, _, _ = linear_model(spark, d)
    return ML.top_features(ML.feature_importance(model, FEATURES, spark), 5)


@query("training_exports", ops=("SNK-9", "AGG-9", "AGG-6"), sql=linear_sql(f"""
SELECT 'age ' || age_group AS part, COUNT(*) AS patients, CAST(COUNT(*) FILTER (risk_level = 'High') AS BIGINT) AS high,
       ROUND(AVG(risk_score), 7) AS score
FROM (SELECT *, {G.bins("age_numeric", K.AGE_EDGES, K.AGE_LABELS)} AS age_group FROM tested)
WHERE age_group IS NOT NULL GROUP BY age_group
UNION ALL SELECT 'level ' || risk_level, COUNT(*), NULL, NULL FROM tested WHERE risk_level IS NOT NULL GROUP BY risk_level
UNION ALL SELECT 'summary', COUNT(*), CAST(SUM(label) AS BIGINT),
                 ROUND(AVG(risk_percentage), 5) FROM tested
UNION ALL SELECT 'predictions', COUNT(*), CAST(SUM(label) AS BIGINT), ROUND(AVG(risk_score), 7) FROM tested""").replace(
    "\nSELECT 'age '", f""", scored AS (
  SELECT age_numeric, label, 1.0 / (1.0 + exp(-({MARGIN_SQL}))) AS risk_score FROM msplit, fitted WHERE NOT train),
tested AS (SELECT *, {G.risk_level("risk_score")} AS risk_level, {G.rnd_even("risk_score * 100.0", 1)} AS risk_percentage
           FROM scored)
SELECT 'age '""", 1))
def q_training_exports(spark, d):
    """The exported files of the linear model, read back."""
    from ..session import scratch_path
    model, data, _ = linear_model(spark, d)
    test = data.where(F.col("split") == "test")
    comparison = ML.evaluate(ML.predicted(model, test, "score"), "label").select(F.lit("logistic_regression").alias("model"), "*")
    root = scratch_path(spark, "exports")
    training_exports(model, test, comparison, root)

    def back(name, schema):
        # columns are chosen by their names in the header
        return spark.read.option("header", True).csv(f"{root}/{name}") \
            .select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")])
    ages = back("risk_by_demographics", "age_group string, avg_risk_score double, patient_count long, high_risk_count long")
    levels = back("risk_distribution", "risk_level string, patient_count long")
    people = back("patient_risk_summary", "risk_percentage double, actual_readmitted double")
    rows = back("predictions", "risk_score double, actual_readmitted double")
    part = ages.select(F.concat(F.lit("age "), "age_group").alias("part"), F.col("patient_count").alias("patients"),
                       F.col("high_risk_count").alias("high"), F.round("avg_risk_score", 7).alias("score"))
    part = part.unionByName(levels.where("risk_level IS NOT NULL").select(
        F.concat(F.lit("level "), "risk_level").alias("part"), F.col("patient_count").alias("patients"),
        F.lit(None).cast("long").alias("high"), F.lit(None).cast("double").alias("score")))
    for name, frame, column, digits in (("summary", people, "risk_percentage", 5), ("predictions", rows, "risk_score", 7)):
        part = part.unionByName(frame.agg(
            F.lit(name).alias("part"), F.count(F.lit(1)).alias("patients"),
            F.sum("actual_readmitted").cast("long").alias("high"), F.round(F.avg(column), digits).alias("score")))
    return part


# a small ensemble by rule: tree t splits on features t, t + 1, t + 2 at thresholds of its own
FIXED_NODES = [dict(zip(("tree", "node", "feature", "threshold", "left_node", "right_node", "value"), row)) for t in range(6)
               for row in ((t, 0, t, 2.5 * (t + 1), 1, 4, 0.0), (t, 1, t + 1, 1.5, 2, 3, 0.0), (t, 2, -1, None, -1, -1, t / 10),
                           (t, 3, -1, None, -1, -1, 0.9 - t / 10), (t, 4, t + 2, 3.0 * t, 5, 6, 0.0),
                           (t, 5, -1, None, -1, -1, 0.25), (t, 6, -1, None, -1, -1, 0.8))]
NODES_SQL = ", ".join("(" + ", ".join("NULL" if v is None else str(v) for v in n.values()) + ")" for n in FIXED_NODES)


@query("tree_scores_fixed", ops=("TRN-2", "TRN-3", "SCO-3"), sql=G.with_ctes(G.ENC, f"""
SELECT row_id, ROUND(SUM(value) / 6, 7) AS forest, ROUND(1 / (1 + exp(-2 * SUM(value))), 7) AS boosted
FROM walk WHERE feature = -1 GROUP BY row_id""", clean_sql(True) + "," + FEATURES_SQL + f""",
nodes(tree, node, feature, threshold, left_node, right_node, value) AS (VALUES {NODES_SQL}),
frows AS (SELECT TRY_CAST(encounter_id AS BIGINT) AS row_id, [{", ".join(f"CAST({c} AS DOUBLE)" for c in FEATURES)}] AS x FROM feat),
walk AS (
  SELECT row_id, x, n.* FROM frows, nodes n WHERE n.node = 0
  UNION ALL
  SELECT w.row_id, w.x, n.* FROM walk w JOIN nodes n ON n.tree = w.tree
   AND n.node = CASE WHEN w.x[w.feature + 1] <= w.threshold THEN w.left_node ELSE w.right_node END
  WHERE w.feature >= 0)""").replace("WITH ", "WITH RECURSIVE ", 1))
def q_tree_scores_fixed(spark, d):
    """A node table compiled to one expression, against a walk through the nodes."""
    rows = features_df(spark, d, keep_ids=True)
    return rows.select(F.col("encounter_id").try_cast("long").alias("row_id"),
                       *[F.round(TR.ensemble_column(FIXED_NODES, FEATURES, k), 7).alias(k) for k in (TR.FOREST, TR.BOOSTED)])


@query("linear_contrib", ops=("EXP-1", "EXP-2"), sql=linear_sql("\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, ROUND(AVG(ABS(b[{i + 1}] * ({c} - m_{c}))), 7) AS mean_abs_contribution "
    f"FROM msplit, fitted, {MEANS_SQL}" for i, c in enumerate(FEATURES))))
def q_linear(spark, d):
    model, data, train = linear_model(spark, d)
    contrib = ML.linear_contributions(model, data, FEATURES, "row_id", train)
    return ML.mean_abs_contribution(contrib, FEATURES) \
        .withColumn("mean_abs_contribution", F.round("mean_abs_contribution", 7))


@query("confusion", ops=("TRN-6",), sql=G.with_ctes(G.ENC, """
SELECT actual_readmitted AS actual, CASE WHEN risk_score >= 0.5 THEN 1 ELSE 0 END AS predicted,
       COUNT(*) AS n
FROM ops GROUP BY ALL""", clean_sql(True) + "," + FEATURES_SQL + "," + OPS_SQL))
def q_confusion(spark, d):
    p = operational(spark, d)["model_predictions"]
    p = p.select(F.col("actual_readmitted").alias("label"),
                 (F.col("risk_score") >= 0.5).cast("int").alias("prediction"))
    return ML.confusion(p, "label", "prediction")


@query("roc_points", ops=("TRN-5",), sql=G.with_ctes(G.ENC, """
SELECT threshold,
       CAST(SUM(neg) OVER w AS DOUBLE) / SUM(neg) OVER () AS fpr,
       CAST(SUM(pos) OVER w AS DOUBLE) / SUM(pos) OVER () AS tpr
FROM (SELECT risk_score AS threshold,
             SUM(CASE WHEN actual_readmitted = 1 THEN 1 ELSE 0 END) AS pos,
             SUM(CASE WHEN actual_readmitted = 1 THEN 0 ELSE 1 END) AS neg
      FROM ops GROUP BY risk_score)
WINDOW w AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    clean_sql(True) + "," + FEATURES_SQL + "," + OPS_SQL))
def q_roc(spark, d):
    p = operational(spark, d)["model_predictions"]
    return ML.roc_points(p.select(F.col("risk_score").alias("score"),
                                  F.col("actual_readmitted").alias("label")), "score", "label")


@query("contrib_waterfall", ops=("EXP-3", "EXP-1", "FIL-2"), sql=linear_sql(f"""
SELECT row_id, ROUND(b[{len(FEATURES) + 1}]{"".join(f" + b[{i + 1}] * m_{c}" for i, c in enumerate(FEATURES))}, 7) AS base,
       feature, ROUND(contribution, 7) AS contribution
FROM (SELECT row_id, b, m.*, unnest([{", ".join(f"'{c}'" for c in FEATURES)}]) AS feature,
             unnest([{", ".join(f"b[{i + 1}] * ({c} - m_{c})" for i, c in enumerate(FEATURES))}]) AS contribution
      FROM (SELECT * FROM msplit, fitted ORDER BY ROUND({MARGIN_SQL}, 9) DESC, row_id LIMIT 1), {MEANS_SQL} m)
ORDER BY ABS(contribution) DESC, feature LIMIT 15"""))
def q_waterfall(spark, d):
    model, data, train = linear_model(spark, d)
    contrib = ML.linear_contributions(model, data, FEATURES, "row_id", train)
    # the row with the largest predicted risk, ties by id
    top = data.orderBy(F.round(model.margin(), 9).desc(), "row_id").limit(1).select("row_id")
    row = contrib.join(F.broadcast(top), "row_id", "left_semi")
    long = row.unpivot(["row_id", "base"], FEATURES, "feature", "contribution")
    return long.orderBy(F.desc(F.abs("contribution")), "feature").limit(15) \
        .withColumn("base", F.round("base", 7)).withColumn("contribution", F.round("contribution", 7))


# ------------------------------------------------------------------ exact checks
# a linear model with fixed coefficients makes scoring and explanation exact in SQL
FIXED = {"age_numeric": 0.01, "number_inpatient": 0.2, "num_medications": 0.03, "time_in_hospital": -0.02}
FIXED_BIAS = -1.5
LINEAR_SQL = " + ".join([f"({w}) * CAST({c} AS DOUBLE)" for c, w in FIXED.items()])
ROWS_SQL = f"""
rows AS (SELECT TRY_CAST(encounter_id AS BIGINT) AS row_id, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FIXED)},
           CAST(readmitted_binary AS INTEGER) AS label FROM feat)"""


def fixed_rows(spark, d):
    f = features_df(spark, d, keep_ids=True)
    return f.select(F.col("encounter_id").try_cast("long").alias("row_id"),
                    *[F.col(c).cast("double").alias(c) for c in FIXED],
                    F.col("readmitted_binary").cast("int").alias("label"))


def fixed_scores(spark, d):
    margin = F.lit(FIXED_BIAS)
    for c, w in FIXED.items():
        margin = margin + F.lit(w) * F.col(c)
    return fixed_rows(spark, d).withColumn("score", F.round(1.0 / (1.0 + F.exp(-margin)), 6))


SCORES_SQL = f"""
scored AS (SELECT row_id, label, round(1.0 / (1.0 + exp(-({FIXED_BIAS} + {LINEAR_SQL}))), 6) AS score FROM rows)"""


@query("linear_contrib_fixed", ops=("EXP-1",), sql=G.with_ctes(G.ENC, f"""
SELECT r.row_id, {FIXED_BIAS} + {" + ".join(f"({w}) * m.{c}" for c, w in FIXED.items())} AS base,
       {", ".join(f"({w}) * (r.{c} - m.{c}) AS {c}" for c, w in FIXED.items())}
FROM rows r, (SELECT {", ".join(f"AVG({c}) AS {c}" for c in FIXED)} FROM rows
              WHERE {G.hash_rank("row_id")} % 1000 < 800) m""",
    clean_sql(True) + "," + FEATURES_SQL + "," + ROWS_SQL))
def q_linear_fixed(spark, d):
    rows = fixed_rows(spark, d)
    train = hash_split(rows, "row_id", 800, 42).where(F.col("split") == "train")
    return ML.linear_contributions((list(FIXED.values()), FIXED_BIAS), rows, list(FIXED), "row_id", train)


@query("auc_exact", ops=("TRN-4", "TRN-5"), sql=G.with_ctes(G.ENC, """
SELECT SUM(neg * (above + pos / 2.0)) / (CAST(SUM(pos) AS DOUBLE) * SUM(neg)) AS auc
FROM (SELECT pos, neg, COALESCE(SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING
                                               AND 1 PRECEDING), 0) AS above
      FROM (SELECT score, SUM(label) AS pos, SUM(1 - label) AS neg FROM scored GROUP BY score))""",
    clean_sql(True) + "," + FEATURES_SQL + "," + ROWS_SQL + "," + SCORES_SQL))
def q_auc(spark, d):
    return ML.auc(fixed_scores(spark, d))


@query("class_report", ops=("TRN-6", "TRN-4"), sql=G.with_ctes(G.ENC, """
SELECT c AS class, CAST(SUM(y) AS BIGINT) AS support,
       COALESCE(SUM(hit) / NULLIF(CAST(SUM(p) AS DOUBLE), 0), 0) AS precision,
       COALESCE(SUM(hit) / NULLIF(CAST(SUM(y) AS DOUBLE), 0), 0) AS recall,
       COALESCE(2.0 * SUM(hit) / NULLIF(CAST(SUM(p) + SUM(y) AS DOUBLE), 0), 0) AS f1
FROM (SELECT label AS c, 1 AS y, CASE WHEN label = (score >= 0.3)::INT THEN 1 ELSE 0 END AS hit, 0 AS p FROM scored
      UNION ALL SELECT (score >= 0.3)::INT, 0, 0, 1 FROM scored) GROUP BY c""",
    clean_sql(True) + "," + FEATURES_SQL + "," + ROWS_SQL + "," + SCORES_SQL))
def q_class_report(spark, d):
    p = fixed_scores(spark, d).withColumn("prediction", (F.col("score") >= 0.3).cast("int"))
    return ML.class_report(p, "label", "prediction")


@query("model_checks", ops=("TRN-2", "TRN-8", "SNK-13", "SCO-3"), sql="""
SELECT 'importances sum to 1' AS "check", TRUE AS ok UNION ALL SELECT 'levels follow rounded scores', TRUE
UNION ALL SELECT 'reload scores alike', TRUE UNION ALL SELECT 'scores between 0 and 1', TRUE""")
def q_model_checks(spark, d):
    """Facts that hold for any fitted model: a reloaded model scores alike, level and
    percent follow from the rounded score, importances sum to 1."""
    from ..functions import scalars as S
    from ..session import scratch_path
    from ..sources import sinks as SK
    data = model_data(spark, d)
    train = data.where(F.col("split") == "train")
    forest = ML.estimators("label", "weight", forest={"numTrees": 10, "maxDepth": 4})["random_forest"]
    model = ML.fit(train, FEATURES, forest)
    path = scratch_path(spark, "model")
    SK.save_model(model, path)
    a = ML.score_batch(model, data).select("row_id", "risk_score", "risk_level", "risk_percentage")
    b = ML.score_batch(SK.load_model(path), data).select("row_id", F.col("risk_score").alias("again"))
    j = a.join(b, "row_id").withColumn("want", S.risk_level("risk_score", "left"))
    share = ML.feature_importance(model, FEATURES, spark).agg(F.sum("importance").alias("s"))
    facts = j.agg(
        F.min(F.col("risk_score") == F.col("again")).alias("reload scores alike"),
        F.min(F.col("risk_score").between(0, 1)).alias("scores between 0 and 1"),
        F.min((F.col("risk_level") == F.col("want"))
              & (F.abs(F.col("risk_percentage") - F.col("risk_score") * 100) <= 0.0500001))
        .alias("levels follow rounded scores"))
    facts = facts.crossJoin(share.select((F.abs(F.col("s") - 1) < 1e-6).alias("importances sum to 1")))
    return facts.unpivot([], facts.columns, "check", "ok")
