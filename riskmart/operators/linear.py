"""Logistic regression by iteratively reweighted least squares (TRN-1, EXP-2, EXP-3).

Each round folds the rows once into the weighted Gram matrix, the gradient and the
objective (a state of (k + 2) x (k + 2) numbers, see ``gram``), and the driver solves one
k x k system. The penalised objective has one minimum, so the weights are exact up to
floating-point noise and can be checked against any other solver. Rows are read as they
are stored; callers store the frame they pass.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gram import first_state, fold

register_pickle_by_value(sys.modules[__name__])

# FIXED VALUES: estimator defaults behind the reference's training settings
INVERSE_PENALTY = 1.0
MAX_ROUNDS = 1000

#: Rounds end when no weight (in units of its column) moves by more than this.
TOLERANCE = 1e-10


@dataclass(frozen=True)
class LinearModel:
    features: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float
    rounds: int
    objective: float

    def margin(self) -> Column:
        """Log-odds as a column expression; a null feature counts as 0."""
        out = F.lit(self.bias)
        for c, w in zip(self.features, self.weights):
            out = out + F.lit(w) * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        return out

    def probability(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))


def _step(v: np.ndarray, shift: np.ndarray, scale: np.ndarray):
    """Fold of one round at the scaled weights ``v`` (bias last). Columns of a block:
    features, label, row weight. State: hessian, gradient as a column, objective."""
    k = len(shift)

    def add(state, x):
        y, w = x[:, k], np.nan_to_num(x[:, k + 1])
        keep = ~np.isnan(y)
        z = np.ones((int(keep.sum()), k + 1))
        z[:, :k] = (np.nan_to_num(x[keep, :k]) - shift) / scale
        y, w = y[keep], w[keep]
        m = z @ v
        p = 1.0 / (1.0 + np.exp(-np.clip(m, -700, 700)))
        out = np.zeros((k + 2, k + 2))
        out[:k + 1, :k + 1] = (z * (w * p * (1.0 - p))[:, None]).T @ z
        out[:k + 1, k + 1] = z.T @ (w * (p - y))
        # log(1 + exp(m)) - y m without overflow
        out[k + 1, k + 1] = float(w @ (np.maximum(m, 0) + np.log1p(np.exp(-np.abs(m))) - y * m))
        return out if state is None else state + out

    return add


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b


def fit_logistic(df: DataFrame, features: Sequence[str], label: str = "label", weight: str | None = "weight",
                 inverse_penalty: float = INVERSE_PENALTY, rounds: int = MAX_ROUNDS) -> LinearModel:
    """Weights that minimise ``|w|^2 / 2 + inverse_penalty * sum(weight * log loss)``; the
    bias is not penalised.

    Null features count as 0, rows with a null label or weight say nothing. Columns are
    centred and scaled for the solver only. A step that does not lower the objective is
    halved. Without usable rows all weights are 0.
    """
    names = list(features)
    k = len(names)
    w = F.lit(1.0) if weight is None else F.col(weight)
    src = df.select(*[F.col(c).cast("double").alias(c) for c in names], F.col(label).cast("double").alias("__y"),
                    w.cast("double").alias("__w"))
    spread = src.agg(*[F.avg(F.coalesce(c, F.lit(0.0))).alias(f"m{i}") for i, c in enumerate(names)],
                     *[F.stddev_pop(F.coalesce(c, F.lit(0.0))).alias(f"s{i}") for i, c in enumerate(names)]).first()
    shift = np.array([spread[f"m{i}"] or 0.0 for i in range(k)])
    scale = np.array([spread[f"s{i}"] or 1.0 for i in range(k)])
    penalty = np.append(1.0 / (inverse_penalty * scale * scale), 0.0)

    def state(v):
        s = first_state(fold(src, [*names, "__y", "__w"], _step(v, shift, scale), _sum))
        if s is None:
            return None
        s = s.reshape(k + 2, k + 2)
        return (s[:k + 1, :k + 1] + np.diag(penalty), s[:k + 1, k + 1] + penalty * v,
                s[k + 1, k + 1] + 0.5 * float(penalty @ (v * v)))

    v, done = np.zeros(k + 1), 0
    now = state(v)
    while now is not None and done < rounds:
        hessian, gradient, objective = now
        move = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        done += 1
        if np.abs(move).max() <= TOLERANCE:
            v = v - move
            break
        size = 1.0
        while True:
            trial = state(v - size * move)
            if trial[2] <= objective + 1e-12 * abs(objective) or size < 1e-6:
                break
            size /= 2
        v, now = v - size * move, trial
    raw = v[:k] / scale
    return LinearModel(tuple(names), tuple(float(x) for x in raw), float(v[k] - raw @ shift), done,
                       0.0 if now is None else float(now[2]))


def weights_table(model: LinearModel, spark) -> DataFrame:
    """term, weight: one row per feature and the bias (a fitted model's own size)."""
    return spark.createDataFrame([*zip(model.features, model.weights), ("(bias)", model.bias)], "term string, weight double")
