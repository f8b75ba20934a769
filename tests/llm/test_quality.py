"""The factorisation machine against its definition, and held-out quality."""

import math

import numpy as np
import pytest

from riskmart.llm import common
from riskmart.llm import quality as Q
from riskmart.llm.tokens import text_blocks
from tests.conftest import SF_CHECK

from .test_text_operators import prose

SCHEMA = "doc_id long, text string, n_chars long, lang string, source string, i int, x int, score string, __text string"


def inputs(text, n_chars=-1, bits=16):
    import pyarrow as pa
    for _, _, buf, off in text_blocks(pa.array([text], pa.string())):
        first, i, x = Q.features(buf, off, np.array([n_chars]), bits)
        assert list(first) == [0, len(i)]
        return i, x


def test_pairs_in_linear_time_equal_all_pairs():
    rnd = np.random.default_rng(3)
    w, v = rnd.normal(size=50), rnd.normal(size=(50, 4))
    rows = [(rnd.choice(50, n, replace=False), rnd.normal(size=n)) for n in (1, 2, 7, 30)]
    first = np.concatenate(([0], np.cumsum([len(i) for i, _ in rows])))
    got, _ = Q.margins(0.3, w, v, first, np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]))
    for (i, x), m in zip(rows, got):
        want = 0.3 + sum(w[a] * p for a, p in zip(i, x)) + sum(
            float(v[i[a]] @ v[i[b]]) * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert m == pytest.approx(want, rel=1e-9)


def test_gradient_step_matches_finite_differences():
    bits, factors = 4, 3
    state = Q.start(bits, factors)
    i, x = inputs("Some words, some MORE words!! 123", bits=bits)
    n = len(state["p"])

    def loss(p, w0):
        m, _ = Q.margins(w0, p[:, 0], p[:, 1:], np.array([0, len(i)]), i, x)
        return math.log1p(math.exp(-m[0]))
    new = Q.shard_pass(state, [(i, x, 1.0)])
    for c in set(i.tolist()):
        for f in range(factors + 1):
            up, down = state["p"].copy(), state["p"].copy()
            up[c, f] += 1e-5
            down[c, f] -= 1e-5
            g = (loss(up, 0.0) - loss(down, 0.0)) / 2e-5 + Q.DECAY * state["p"][c, f]
            assert new["a"][c, f] - Q.BEFORE == pytest.approx(g * g, rel=1e-3, abs=1e-10)
    untouched = np.setdiff1d(np.arange(n), i)
    assert (new["p"][untouched] == state["p"][untouched]).all()


def test_statistics_of_empty_and_long_texts():
    for text in ("", None, " \n", "w" * 3_000_000, "é" * 100_000, "a b\n" * 200_000):
        i, x = inputs(text, 5)
        assert len(i) >= Q.STATS and np.isfinite(x).all() and (i[:Q.STATS] // Q.BUCKETS == np.arange(Q.STATS)).all()


def corpus():
    rows, labels = [], []
    for k in range(600):
        words = prose(k, 80)
        junk = k % 5 == 0
        text = " ".join(w.upper() + "!!" for w in words) if junk else " ".join(words) + "."
        rows.append((k, text, len(text)))
        labels.append((k, int(not junk), 0))
    rows += [(1000, None, None), (1001, "", 0), (None, rows[0][1], None), (3, rows[3][1], len(rows[3][1]))]
    labels += [(None, 1, 0), (4, None, 0), (9999, 1, 0), (5, 1, 0), (5, 0, 0)]
    return rows, labels


def test_quality(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, "en", "s", 1, 2, "y", "z") for r in rows], SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = Q.quality(docs, marks).collect()
    assert len(got) == len(rows) and all(0.0 <= r["score"] <= 1.0 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100 and all(r["predicted"] == int(r["doc_id"] % 5 != 0) for r in held if r["doc_id"] < 600)
    same = [r["score"] for r in got if r["doc_id"] == 3]
    assert len(same) == 2 and same[0] == same[1]
    again = Q.quality(docs.repartition(7), marks.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    bare = Q.quality(docs.select("doc_id", "text"), marks).collect()
    assert len(bare) == len(rows)


def test_without_labels_and_without_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, "en", "s", 1, 2, "y", "z") for r in rows], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(0.45 < r["score"] < 0.55 for r in Q.quality(docs, none).collect())
    assert Q.quality(docs.where("false"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_held_out_accuracy(spark):
    docs, labels = common.table(spark, SF_CHECK, "documents"), common.table(spark, SF_CHECK, "labels")
    rows = Q.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)
