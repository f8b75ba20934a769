"""Bounded-memory exact quantiles against numpy's linear rule."""

import random

import numpy as np
import pytest

from riskmart.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("kind", ["continuous", "ties", "hot_value"])
def test_exact_quantiles_bracketing(spark, kind):
    rnd = random.Random(3)
    if kind == "continuous":
        vals = [rnd.random() * 1000 for _ in range(20000)]
    elif kind == "ties":
        vals = [float(rnd.randint(0, 50)) for _ in range(20000)]
    else:   # one value holds a third of the rows
        vals = [42.0 if rnd.random() < 0.34 else rnd.gauss(40, 10) for _ in range(20000)]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
    qs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    # small candidate limit forces several narrowing passes
    got = exact_quantiles(df, "x", qs, max_candidates=500, accuracy=200)
    want = np.quantile(np.array(vals), qs, method="linear")
    assert got == pytest.approx(list(want), rel=1e-12, abs=1e-12)


def test_empty(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, "x", [0.5]) == [None]


def test_grouped_exact_quantiles_hot_group(spark):
    from riskmart.operators.quantiles import grouped_exact_quantiles
    rnd = random.Random(5)
    rows = []
    for _ in range(6000):
        g = "hot" if rnd.random() < 0.34 else f"g{rnd.randint(0, 20)}"
        rows.append((g, rnd.random() * 100 if rnd.random() < 0.7 else float(rnd.randint(0, 5))))
    rows.append(("single", 7.0))
    df = spark.createDataFrame(rows, "g string, x double")
    qs = [0.25, 0.5, 0.75]
    groups = {}
    for g, x in rows:
        groups.setdefault(g, []).append(x)
    got = {r["g"]: [r["q0"], r["q1"], r["q2"]]
           for r in grouped_exact_quantiles(df, ["g"], "x", qs, partitions=7).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g] == pytest.approx(list(np.quantile(np.array(xs), qs)), rel=1e-12, abs=1e-12), g


@pytest.mark.parametrize("ones", [0, 1, 999, 1000, 1001, 1500, 2000])
def test_two_valued_columns_end_in_the_counts(spark, ones, monkeypatch):
    """No read of candidate values for a 0/1 column, whatever its balance."""
    from riskmart.operators import quantiles as Q
    df = spark.range(2000).selectExpr(f"CAST(id < {ones} AS DOUBLE) AS x", "CAST(id % 2 AS DOUBLE) AS y")
    left = []
    monkeypatch.setattr(Q.F, "collect_list", lambda c: left.append(c))
    got = Q.column_quantiles(df, ["x", "y"], [0.25, 0.5, 0.75], max_candidates=10)
    want = [list(np.quantile([1.0] * ones + [0.0] * (2000 - ones), [0.25, 0.5, 0.75])), [0.0, 0.5, 1.0]]
    assert got == want and not left
