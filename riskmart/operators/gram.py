"""Cross products of many columns in one pass (AGG-25, TOP-6, TRN-1).

A correlation matrix or a least-squares step over k columns needs k (k + 1) / 2 sums. As
separate aggregate expressions they outgrow generated code at a few dozen columns, so a
task folds its Arrow batches into one small state of k x k matrices with numpy and emits
it as one row. States are merged in two levels (groups of about the square root of the
task count, then one group of as many rows), so no task or driver holds more than a few
hundred states of k x k numbers, whatever the rows. Merging adds centred moments, so a
large common offset does not cancel away the variance, and goes by task order, so reruns
agree.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# functions that run in tasks are pickled by value: executors need no copy of the package
register_pickle_by_value(sys.modules[__name__])

STATE = "task long, state binary"


# ------------------------------------------------------------------ folding
def fold(df: DataFrame, columns: Sequence[str], add: Callable, merge: Callable) -> DataFrame:
    """One row (task, state) over all rows of ``df``, none for an empty table.

    ``add(state or None, matrix)`` takes a block of rows as float64 (nulls are NaN) and
    returns the new state, an array of any shape; ``merge(a, b)`` joins two states given
    flat. States travel as bytes.
    """
    src = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def partial(batches: Iterable[pa.RecordBatch]):
        from pyspark import TaskContext
        state = None
        for batch in batches:
            if batch.num_rows:
                state = add(state, np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
        if state is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([state.tobytes()], pa.binary())],
                names=["task", "state"])

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        state = None
        for s in table.column("state"):
            s = np.frombuffer(s.as_buffer(), np.float64)
            state = s if state is None else merge(state, s)
        return pa.table({"task": table.column("task").slice(0, 1), "state": pa.array([state.tobytes()], pa.binary())})

    tasks = src.mapInArrow(partial, STATE)
    groups = max(int(src.sparkSession.sparkContext.defaultParallelism ** 0.5), 32)
    return (tasks.groupBy(F.pmod("task", F.lit(groups)).alias("g")).applyInArrow(join, STATE)
            .groupBy(F.lit(0).alias("g")).applyInArrow(join, STATE))


def first_state(folded: DataFrame) -> np.ndarray | None:
    """The folded state on the driver (k x k numbers), None for an empty table."""
    row = folded.first()
    return None if row is None else np.frombuffer(row["state"], np.float64)


# ------------------------------------------------------------------ pairwise moments
# state: k x k matrices n (rows where i and j are present), m (mean of i over them),
# s (centred squares of i over them), c (centred cross products)
def _moments(x: np.ndarray) -> np.ndarray:
    seen = ~np.isnan(x)
    mask = seen.astype(np.float64)
    zero = np.where(seen, x, 0.0)
    shift = zero.sum(axis=0) / np.maximum(mask.sum(axis=0), 1.0)
    d = (zero - shift) * mask
    n = mask.T @ mask
    m = (d.T @ mask) / np.maximum(n, 1.0)
    return np.stack([n, m + shift[:, None], (d * d).T @ mask - n * m * m, d.T @ d - n * m * m.T])


def merge_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    k = int(round((a.size / 4) ** 0.5))
    (n1, m1, s1, c1), (n2, m2, s2, c2) = a.reshape(4, k, k), b.reshape(4, k, k)
    n = n1 + n2
    d, part = m2 - m1, np.divide(n2, n, out=np.zeros_like(n), where=n > 0)
    d = np.where((n1 > 0) & (n2 > 0), d, 0.0)
    m = np.where(n1 > 0, m1 + d * part, m2)
    return np.stack([n, m, s1 + s2 + d * d * n1 * part, c1 + c2 + d * d.T * n1 * part])


def add_moments(state: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    now = _moments(x)
    return now if state is None else merge_moments(state, now)


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, n, mean_a, mean_b, var_a, var_b, cov, corr for every ordered pair of
    ``columns`` (population moments) over the rows where both are not null.

    ``corr`` is null where fewer than two rows have both or a side is constant, and 1 on
    the diagonal otherwise. NaN counts as null. An empty table gives an empty result.
    """
    names = list(columns)
    k = len(names)

    def unpack(batches):
        for batch in batches:
            for state in batch.column(1):
                n, m, s, c = np.frombuffer(state.as_buffer(), np.float64).reshape(4, k, k)
                i, j = (x.ravel() for x in np.indices((k, k)))
                count = n.ravel()
                with np.errstate(all="ignore"):
                    va, vb, cov = s.ravel() / count, s.T.ravel() / count, c.ravel() / count
                    # rounding leaves a trace of variance on a constant column
                    flat = (va <= 1e-28 * m.ravel() ** 2) | (vb <= 1e-28 * m.T.ravel() ** 2)
                    corr = np.clip(cov / np.sqrt(va * vb), -1.0, 1.0)
                corr[i == j] = 1.0
                none = count < 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[x] for x in i]), pa.array([names[x] for x in j]), pa.array(count.astype(np.int64)),
                     *(pa.array(v, mask=none) for v in (m.ravel(), m.T.ravel(), va, vb, cov)),
                     pa.array(corr, mask=none | flat | (count < 2))],
                    names=["a", "b", "n", "mean_a", "mean_b", "var_a", "var_b", "cov", "corr"])

    return fold(df, names, add_moments, merge_moments).mapInArrow(
        unpack, "a string, b string, n long, mean_a double, mean_b double, var_a double, var_b double, "
                "cov double, corr double")
