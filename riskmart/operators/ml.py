"""Encoding, training, evaluation, scoring and explanation (ENC-*, TRN-*, SCO-3, EXP-*).

Models are Spark ML estimators, so training reads the data in parallel and the
fitted pipeline scores a DataFrame of any size in one ``transform``. Metrics
are conditional sums; curves and AUC come from counts per distinct score whose
running totals are taken over range partitions, so no task sorts all scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .linear import LinearModel
from .sequence import running_total

# FIXED VALUES: model settings of the reference training run
FOREST = {"numTrees": 200, "maxDepth": 15, "minInstancesPerNode": 5}
BOOSTED = {"maxIter": 300, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8}
SEED = 42


# ------------------------------------------------------------------ encoding
def nan_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text form of the columns with null as the class ``nan`` (ENC-1)."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) if c in cols
                       else F.col(c) for c in df.columns])


def label_encoder(cols: Sequence[str], suffix: str = "_idx") -> Pipeline:
    """Sorted-class label encoding (ENC-1); unseen classes get index n (ENC-2)."""
    idx = StringIndexer(inputCols=list(cols), outputCols=[c + suffix for c in cols],
                        stringOrderType="alphabetAsc", handleInvalid="keep")
    return Pipeline(stages=[idx])


def unknown_to_zero(df: DataFrame, model: PipelineModel, cols: Sequence[str],
                    suffix: str = "_idx") -> DataFrame:
    """Map the ``keep`` bucket (index n = number of labels) to 0 (ENC-2 parity)."""
    labels = model.stages[0].labelsArray
    out = df
    for c, lab in zip(cols, labels):
        n = float(len(lab))
        out = out.withColumn(c + suffix, F.when(F.col(c + suffix) == n, F.lit(0.0))
                             .otherwise(F.col(c + suffix)))
    return out


def drop_text_columns(df: DataFrame) -> DataFrame:
    from .shape import drop_text
    return drop_text(df)


# ------------------------------------------------------------------ training
def class_weights(df: DataFrame, label: str = "label", out: str = "weight",
                  fitted_on: Column | None = None) -> DataFrame:
    """Balanced weights ``n / (2 * n_class)`` as a column, from the rows for which
    ``fitted_on`` holds (the training split); the class counts are a two-row
    aggregate joined back with a broadcast."""
    base = df if fitted_on is None else df.where(fitted_on)
    counts = base.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = base.agg(F.count(F.lit(1)).alias("__total"))
    w = counts.crossJoin(total).select(
        label, (F.col("__total") / (F.lit(2.0) * F.col("__n"))).alias(out))
    return df.join(F.broadcast(w), label, "left")


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def estimators(label: str = "label", weight: str | None = "weight",
               forest: dict | None = None, boosted: dict | None = None) -> dict:
    """The two tree ensembles (TRN-2, TRN-3) with the reference settings; the third
    candidate is ``linear.fit_logistic`` (TRN-1).

    The forest keeps each row's node per tree beside the row: the fitted trees are the
    same, but no pass ships the trees grown so far to the tasks or walks them from the root.
    """
    common = {"labelCol": label, "featuresCol": "features"}
    rf = RandomForestClassifier(**common, seed=SEED, cacheNodeIds=True, **(forest or FOREST))
    gb = GBTClassifier(**common, seed=SEED, **(boosted or BOOSTED))
    if weight:
        for m in (rf, gb):
            m.setWeightCol(weight)
    return {"random_forest": rf, "gradient_boosting": gb}


def fit(df: DataFrame, features: Sequence[str], estimator) -> PipelineModel:
    return Pipeline(stages=[assembler(features), estimator]).fit(df)


def predicted(model, df: DataFrame, out: str = "score") -> DataFrame:
    """``df`` with the positive class's probability ``out`` and ``prediction`` (1 above
    one half) of a fitted pipeline or a ``LinearModel``."""
    if isinstance(model, LinearModel):
        return df.withColumn(out, model.probability()) \
            .withColumn("prediction", (F.col(out) > 0.5).cast("double"))
    return positive_probability(model.transform(df), out).drop("features", "rawPrediction", "probability")


def positive_probability(pred: DataFrame, out: str = "score") -> DataFrame:
    return pred.withColumn(out, vector_to_array("probability")[1])


# ------------------------------------------------------------------ metrics
def classification_metrics(df: DataFrame, label: str = "label",
                           predicted: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall, F1 from one aggregate pass (TRN-4)."""
    y, p = F.col(label), F.col(predicted)
    tp = F.sum(F.when((y == 1) & (p == 1), 1).otherwise(0))
    fp = F.sum(F.when((y == 0) & (p == 1), 1).otherwise(0))
    fn = F.sum(F.when((y == 1) & (p == 0), 1).otherwise(0))
    tn = F.sum(F.when((y == 0) & (p == 0), 1).otherwise(0))
    c = df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    prec = S.safe_ratio("tp", F.col("tp") + F.col("fp"))
    rec = S.safe_ratio("tp", F.col("tp") + F.col("fn"))
    return c.select(
        "tp", "fp", "fn", "tn",
        S.safe_ratio(F.col("tp") + F.col("tn"),
                     F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"),
        F.coalesce(prec, F.lit(0.0)).alias("precision"),
        F.coalesce(rec, F.lit(0.0)).alias("recall"),
        F.coalesce(S.safe_ratio(F.lit(2.0) * prec * rec, prec + rec), F.lit(0.0)).alias("f1"))


def confusion(df: DataFrame, label: str = "label", predicted: str = "prediction") -> DataFrame:
    """Counts per (actual, predicted) (TRN-6)."""
    return df.groupBy(F.col(label).cast("int").alias("actual"),
                      F.col(predicted).cast("int").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, label: str = "label", predicted: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support of each class (TRN-6), one row per class."""
    per = (df.select(F.explode(F.array(F.struct(F.col(label).cast("int").alias("c"), F.lit(1).alias("y"),
                                                (F.col(label) == F.col(predicted)).cast("int").alias("hit"),
                                                F.lit(0).alias("p")),
                                       F.struct(F.col(predicted).cast("int").alias("c"), F.lit(0).alias("y"),
                                                F.lit(0).alias("hit"), F.lit(1).alias("p")))).alias("r"))
           .groupBy(F.col("r.c").alias("class"))
           .agg(F.sum("r.y").alias("support"), F.sum("r.hit").alias("hits"), F.sum("r.p").alias("named")))
    prec = F.coalesce(S.safe_ratio("hits", "named"), F.lit(0.0))
    rec = F.coalesce(S.safe_ratio("hits", "support"), F.lit(0.0))
    return per.select("class", "support", prec.alias("precision"), rec.alias("recall"),
                      F.coalesce(S.safe_ratio(F.lit(2.0) * prec * rec, prec + rec), F.lit(0.0)).alias("f1"))


def score_ranks(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row per distinct score with its positives and negatives and their running
    totals from the highest score down, over range partitions."""
    per = df.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))
    return running_total(per.withColumn("__down", -F.col("threshold")), "__down", ["pos", "neg"]).drop("__down")


def roc_points(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """ROC curve (TRN-5): one exact point per distinct score."""
    ranks = score_ranks(df, score, label)
    tot = ranks.agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    return ranks.crossJoin(F.broadcast(tot)).select(
        "threshold", S.safe_ratio("cum_neg", "__n").alias("fpr"), S.safe_ratio("cum_pos", "__p").alias("tpr"))


def auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Exact area under the ROC curve as a rank sum: the share of (positive,
    negative) pairs in the right order, ties counting half."""
    above = F.col("cum_pos") - F.col("pos")
    t = score_ranks(df, score, label).agg(
        F.sum(F.col("neg") * (above + F.col("pos") / F.lit(2.0))).alias("right"),
        F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return t.select(S.safe_ratio("right", F.col("p").cast("double") * F.col("n")).alias("auc"))


def evaluate(pred: DataFrame, label: str = "label") -> DataFrame:
    """All hold-out metrics of one model as one row (TRN-4)."""
    return classification_metrics(pred, label).crossJoin(auc(pred, "score", label))


def best_model(results: DataFrame, name: str = "model", by: str = "auc") -> DataFrame:
    """Name of the model with the largest ``by`` (TRN-7), the first name if several."""
    return results.agg(F.min_by(name, F.struct(-F.col(by), F.col(name))).alias("best_model"), F.max(by).alias(by))


def feature_importance(model, features: Sequence[str], spark) -> DataFrame:
    """Global importance per feature (TRN-8): tree importances or |coefficient|.
    The table has one row per feature."""
    if isinstance(model, LinearModel):
        vals = [abs(w) for w in model.weights]
    else:
        vals = model.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame([(f, float(v)) for f, v in zip(features, vals)],
                               "feature string, importance double")
    return df.withColumn("display_name", S.display_name("feature"))


def top_features(importance: DataFrame, n: int = 5) -> DataFrame:
    """TOP-4: ``n`` most important features, rounded as reported."""
    return (importance.orderBy(F.desc("importance"), "feature").limit(n)
            .withColumn("importance", F.bround("importance", 4)))


# ------------------------------------------------------------------ scoring
def score_batch(model, df: DataFrame, closed: str = "left") -> DataFrame:
    """Vectorised batch scoring (SCO-3): probability, level, percent, advice.

    The scorer uses the threshold rule (``>= .6`` High, ``>= .3`` Medium).
    """
    # the score is rounded first; level, percent and advice follow from it
    p = predicted(model, df, "risk_score").withColumn("risk_score", F.bround("risk_score", 4))
    lvl = S.risk_level("risk_score", closed)
    return (p.drop("prediction")
            .withColumn("risk_percentage", S.percent_even("risk_score", 1))
            .withColumn("risk_level", lvl)
            .withColumn("recommendation", S.recommendation(lvl)))


# ------------------------------------------------------------------ explanation
def linear_contributions(model, df: DataFrame, features: Sequence[str], key: str,
                         background: DataFrame | None = None) -> DataFrame:
    """Per-row additive contributions ``w_j (x_j - mean_j)`` of a logistic
    model in log-odds, plus ``base = w·mean + b`` (EXP-1). Means are those of
    ``background`` (the training rows), one aggregate row broadcast to every row.
    ``model`` is a ``LinearModel`` or a pair (coefficients, intercept)."""
    if isinstance(model, LinearModel):
        w, b = list(model.weights), model.bias
    else:
        w, b = list(model[0]), float(model[1])
    means = (df if background is None else background).agg(*[F.avg(c).alias(f"__m_{i}") for i, c in enumerate(features)])
    j = df.select(key, *features).crossJoin(F.broadcast(means))
    contrib = [(F.lit(w[i]) * (F.col(c) - F.col(f"__m_{i}"))).alias(c)
               for i, c in enumerate(features)]
    base = sum((F.lit(w[i]) * F.col(f"__m_{i}") for i in range(len(features))), F.lit(b))
    return j.select(key, base.alias("base"), *contrib)


def mean_abs_contribution(contrib: DataFrame, features: Sequence[str]) -> DataFrame:
    """Average |contribution| per feature, long form (EXP-2)."""
    wide = contrib.agg(*[F.avg(F.abs(c)).alias(c) for c in features])
    return wide.unpivot([], list(features), "feature", "mean_abs_contribution")


def waterfall(contrib: DataFrame, features: Sequence[str], key: str, key_value,
              n: int = 15) -> DataFrame:
    """One row's largest contributions (EXP-3)."""
    row = contrib.where(F.col(key) == F.lit(key_value))
    long = row.unpivot([key, "base"], list(features), "feature", "contribution")
    return long.orderBy(F.desc(F.abs("contribution")), "feature").limit(n)

