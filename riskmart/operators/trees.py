"""Fitted tree ensembles as tables and as SQL (TRN-2, TRN-3, SCO-3).

A fitted forest or boosted ensemble becomes a node table (one row per node, read from the
files Spark ML saves), and from it one scalar expression in SQL that Spark, DuckDB and
other engines read alike, so a model can be scored in a view, a report or a stream without
the ML library. The expression is built from a table of the model's own size, which the
training settings bound (trees x 2^depth); no data row passes the driver.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOREST, BOOSTED = "forest", "boosted"
NODES = "tree int, node int, feature int, threshold double, left_node int, right_node int, value double"


def kind_of(model: PipelineModel) -> str:
    name = type(model.stages[-1]).__name__
    if name.startswith("RandomForest"):
        return FOREST
    if name.startswith("GBT"):
        return BOOSTED
    raise ValueError(f"not a tree ensemble: {name}")


def node_table(model: PipelineModel, path: str) -> DataFrame:
    """tree, node, feature, threshold, left_node, right_node, value of every node; the
    model is saved at ``path`` and its own node files are read.

    ``feature`` and the children are -1 at leaves. A row goes left if its feature is at
    most the threshold, else right; so do nulls. ``value`` is the share of the positive
    class (forest) or the tree's weighted prediction (boosted). Categorical splits, which
    the training here does not make, are refused.
    """
    last = model.stages[-1]
    last.write().overwrite().save(path)
    spark = SparkSession.active()
    data = spark.read.parquet(f"{path}/data")
    weights = spark.read.parquet(f"{path}/treesMetadata").select(F.col("_1").alias("treeID"), F.col("_3").alias("weight"))
    n = F.col("nodeData")
    leaf = n["leftChild"] < 0
    if data.where(~leaf & (n["split"]["numCategories"] >= 0)).limit(1).count():
        raise ValueError("categorical splits have no threshold")
    stats = n["impurityStats"]
    value = F.try_divide(stats[1], F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)) \
        if kind_of(model) == FOREST else n["prediction"] * F.col("weight")
    return data.join(F.broadcast(weights), "treeID").select(       # one row per tree
        F.col("treeID").alias("tree"), n["id"].alias("node"),
        F.when(leaf, F.lit(-1)).otherwise(n["split"]["featureIndex"]).alias("feature"),
        F.when(~leaf, n["split"]["leftCategoriesOrThreshold"][0]).alias("threshold"),
        n["leftChild"].alias("left_node"), n["rightChild"].alias("right_node"), value.alias("value"))


def tree_sql(nodes: Sequence, features: Sequence[str]) -> list[str]:
    """One CASE expression per tree of a collected node table, in tree order."""
    for f in features:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", f):
            raise ValueError(f"not a plain column name: {f}")
    by_tree: dict[int, dict[int, tuple]] = {}
    for r in nodes:
        by_tree.setdefault(r["tree"], {})[r["node"]] = r

    def walk(tree: dict, node: int) -> str:
        r = tree[node]
        if r["feature"] < 0:
            return f"{float(r['value'])!r}D"
        left, right = walk(tree, r["left_node"]), walk(tree, r["right_node"])
        if left == right:
            return left
        return f"CASE WHEN {features[r['feature']]} <= {float(r['threshold'])!r}D THEN {left} ELSE {right} END"

    return [walk(by_tree[t], 0) for t in sorted(by_tree)]


def ensemble_sql(nodes: Sequence, features: Sequence[str], kind: str, dialect: str = "spark") -> str:
    """Probability of the positive class as one SQL expression over ``features``."""
    trees = tree_sql(nodes, features)
    total = " + ".join(f"({t})" for t in trees)
    out = f"({total}) / {float(len(trees))!r}D" if kind == FOREST else f"1.0D / (1.0D + exp(-2.0D * ({total})))"
    # a literal marked D is a double in Spark; elsewhere the plain number is cast
    return out if dialect == "spark" else re.sub(r"(-?\d[\d.]*(?:e[+-]?\d+)?)D\b", r"\1::DOUBLE", out)


def ensemble_column(nodes: Sequence, features: Sequence[str], kind: str) -> Column:
    """``ensemble_sql`` as a Spark column."""
    return F.expr(ensemble_sql(nodes, features, kind))
