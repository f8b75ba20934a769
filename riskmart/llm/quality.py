"""Operator 13: quality by a factorisation machine.

Inputs of a text are its distinct hashed words and punctuation runs (each block scaled to
length 1), structure statistics in buckets of value 1 (sizes, shares of capitals, digits,
punctuation, other scripts and blanks, word lengths, distinct words and lines) and, where
the table has it, the ``n_chars`` it states. The score is the logistic function of

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

whose pairwise part is taken in linear time as half the sum over factors of
(sum_i v_if x_i)^2 - sum_i (v_if x_i)^2.

Training is AdaGrad in rounds on a bounded sample of labelled rows: each shard goes
through its rows in small batches from the common state, and every coordinate becomes the
mean over the shards that changed it. Changes travel as ranges of coordinates and are
joined on executors. The fitted state has a fixed size (2 ** bits words and
``factors`` + 1 numbers each, 2.4 MB by default) and is broadcast to score all rows in one
pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, id_hash, prepare, store
from .tokens import ALNUM, NOT_SPACE, byte_table, mix, odd, text_blocks, words

STATS, BUCKETS = 13, 32
RESERVED = STATS * BUCKETS
PUNCTUATION = NOT_SPACE & ~ALNUM
LINES = byte_table(set(range(256)) - {10})
KINDS = {"upper": byte_table(range(0x41, 0x5B)), "lower": byte_table(range(0x61, 0x7B)),
         "digit": byte_table(range(0x30, 0x3A)), "mark": PUNCTUATION, "other": byte_table(range(0x80, 0x100)),
         "blank": ~NOT_SPACE, "line": byte_table([10])}
RANGE = 1 << 12               # coordinates that travel as one row
RATE, INIT, DECAY = 0.15, 0.05, 1e-5
BEFORE = 1e-3                 # squared gradients before the first: rare words move little
BATCH = 32


def _distinct(doc: np.ndarray, key: np.ndarray, bits: int, salt: int):
    """Distinct (text, coordinate) pairs of hashed items, sorted."""
    at = (mix(key ^ odd(salt)) >> np.uint64(64 - bits)).astype(np.int64)
    return np.unique(doc.astype(np.int64) << bits | at)


def _log2(x: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(x, 0) + 1.0))


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bucket of a share, finer near zero."""
    return np.floor(np.sqrt(a / np.maximum(b, 1)) * (BUCKETS - 1))


def features(buf: np.ndarray, off: np.ndarray, n_chars: np.ndarray, bits: int):
    """(first place per text, coordinates, values) of a block of texts; ``n_chars`` is
    negative where none is stated."""
    n = len(off) - 1
    size = np.diff(off).astype(np.float64)
    count = {}
    for kind, table in KINDS.items():
        run = np.concatenate(([0], np.cumsum(table[buf], dtype=np.int64)))
        count[kind] = np.diff(run[off]).astype(np.float64)
    h, s, e, first = words(buf, off, ALNUM)
    doc = np.repeat(np.arange(n), np.diff(first))
    found = np.diff(first).astype(np.float64)
    length = (e - s).astype(np.float64)
    spread = np.bincount(doc, length, n)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    word = _distinct(doc, h, bits, 1)
    p, _, _, pf = words(buf, off, PUNCTUATION)
    runs = np.diff(pf).astype(np.float64)
    mark = _distinct(np.repeat(np.arange(n), np.diff(pf)), p, bits, 2)
    ln, _, _, lf = words(buf, off, LINES)
    lines = np.diff(lf).astype(np.float64)
    line_doc = np.repeat(np.arange(n), np.diff(lf))
    own = np.bincount(_distinct(line_doc, ln, 40, 3) >> 40, minlength=n).astype(np.float64)
    distinct = np.bincount(word >> bits, minlength=n).astype(np.float64)
    marks = np.bincount(mark >> bits, minlength=n).astype(np.float64)
    letters = count["upper"] + count["lower"]
    stats = np.stack([
        _log2(size), _log2(found), _share(count["upper"], letters), _share(count["digit"], size),
        _share(count["mark"], size), _share(count["other"], size), _share(count["blank"], size),
        _share(count["line"], found), np.minimum(spread / np.maximum(found, 1), BUCKETS - 1), _log2(longest),
        _share(distinct, found), _share(own, lines),
        np.where(n_chars < 0, BUCKETS - 1, np.minimum(_log2(n_chars), BUCKETS - 2))], axis=1)
    stats = np.clip(stats, 0, BUCKETS - 1).astype(np.int64) + np.arange(STATS) * BUCKETS
    mask = (1 << bits) - 1
    d = np.concatenate((np.repeat(np.arange(n), STATS), word >> bits, mark >> bits))
    i = np.concatenate((stats.ravel(), RESERVED + (word & mask), RESERVED + (mark & mask)))
    x = np.concatenate((np.ones(n * STATS), distinct[word >> bits] ** -0.5, marks[mark >> bits] ** -0.5))
    order = np.argsort(d, kind="stable")
    return np.searchsorted(d[order], np.arange(n + 1)), i[order], x[order]


def margins(w0: float, w: np.ndarray, v: np.ndarray, first: np.ndarray, i: np.ndarray, x: np.ndarray):
    """(margin, factor sums) per text; every text has inputs, as its statistics always are."""
    at = first[:-1]
    vx = v[i] * x[:, None]
    s = np.add.reduceat(vx, at, axis=0)
    pairs = 0.5 * (s * s - np.add.reduceat(vx * vx, at, axis=0)).sum(axis=1)
    return w0 + np.add.reduceat(w[i] * x, at) + pairs, s


def start(bits: int, factors: int) -> dict:
    """State of the first round: no weights, small fixed factors, small accumulators."""
    n = RESERVED + (1 << bits)
    v = np.random.default_rng(13).normal(0.0, INIT, (n, factors))
    p = np.concatenate((np.zeros((n, 1)), v), axis=1)
    return {"bits": bits, "w0": 0.0, "a0": 0.0, "p": p, "a": np.full_like(p, BEFORE)}


def shard_pass(state: dict, rows: list, batch: int = BATCH) -> dict:
    """One pass over (coordinates, values, label) rows; returns the new state."""
    p, a, w0, a0 = state["p"].copy(), state["a"].copy(), state["w0"], state["a0"]
    for k in range(0, len(rows), batch):
        part = rows[k:k + batch]
        first = np.concatenate(([0], np.cumsum([len(r[0]) for r in part])))
        i, x = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
        y = np.array([r[2] for r in part])
        m, s = margins(w0, p[:, 0], p[:, 1:], first, i, x)
        g = 1.0 / (1.0 + np.exp(-np.clip(m, -35, 35))) - y
        doc = np.repeat(np.arange(len(part)), np.diff(first))
        gx = g[doc] * x
        grad = np.concatenate((gx[:, None], gx[:, None] * (s[doc] - p[i, 1:] * x[:, None])), axis=1)
        hit, place = np.unique(i, return_inverse=True)
        total = np.zeros((len(hit), p.shape[1]))
        np.add.at(total, place, grad)
        total = total / len(part) + DECAY * p[hit]
        a[hit] += total * total
        p[hit] -= RATE * total / (np.sqrt(a[hit]) + 1e-8)
        g0 = float(g.mean())
        a0 += g0 * g0
        w0 -= RATE * g0 / (a0 ** 0.5 + 1e-8)
    return {"bits": state["bits"], "w0": w0, "a0": a0, "p": p, "a": a}


def _changes(shard: int, old: dict, new: dict) -> pa.Table:
    """Changed coordinates per range; range -1 holds the intercept."""
    hit = np.flatnonzero(((old["p"] != new["p"]) | (old["a"] != new["a"])).any(axis=1))
    cut = np.split(hit, np.flatnonzero(np.diff(hit // RANGE)) + 1) if len(hit) else []
    r, i, v = [-1], [b""], [np.array([new["w0"] - old["w0"], new["a0"] - old["a0"]]).tobytes()]
    for at in cut:
        r.append(int(at[0]) // RANGE)
        i.append((at % RANGE).astype(np.int32).tobytes())
        v.append(np.concatenate((new["p"][at] - old["p"][at], new["a"][at] - old["a"][at]), axis=1).tobytes())
    return pa.table({"shard": pa.array([shard] * len(r), pa.int32()), "r": pa.array(r, pa.int32()),
                     "i": pa.array(i, pa.binary()), "v": pa.array(v, pa.binary())})


def _mean(width: int):
    """The shards' changes of a range: per coordinate the mean over those that changed it."""
    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("shard").to_pylist()
        if rows[0]["r"] < 0:
            out = np.mean([np.frombuffer(x["v"]) for x in rows], axis=0)
            hit = np.empty(0, np.int32)
        else:
            total, times = np.zeros((RANGE, width)), np.zeros(RANGE)
            for x in rows:
                i = np.frombuffer(x["i"], np.int32)
                total[i] += np.frombuffer(x["v"]).reshape(-1, width)
                times[i] += 1
            hit = np.flatnonzero(times).astype(np.int32)
            out = total[hit] / times[hit][:, None]
        return pa.table({"shard": pa.array([0], pa.int32()), "r": pa.array([rows[0]["r"]], pa.int32()),
                         "i": pa.array([hit.tobytes()], pa.binary()), "v": pa.array([out.tobytes()], pa.binary())})
    return run


def _csr(batch_columns, bits: int):
    text, stated = batch_columns
    stated = stated.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    for lo, hi, buf, off in text_blocks(text):
        yield lo, hi, features(buf, off, stated[lo:hi], bits)


def _featurise(bits: int):
    def run(batches):
        for batch in batches:
            for lo, hi, (first, i, x) in _csr(batch.columns[:2], bits):
                at = pa.array(first, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(at, pa.array(i, pa.int32())), pa.ListArray.from_arrays(at, pa.array(x)),
                     batch.column(2).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo)], names=["i", "x", "y", "o"])
    return run


def _inputs(docs: DataFrame) -> list:
    stated = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return [F.col("text").cast("string").alias("__text"), stated.alias("__n")]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bits: int = 16, factors: int = 8,
          max_rows: int = 16_384, shards: int = 8, rounds: int = 6) -> dict:
    """Fit on labelled documents with crc32(doc_id) mod 3 != 1.

    At most ``max_rows`` labelled ids are used, those with the smallest hash, so the
    fitted state does not depend on partitioning. A document labelled several times
    counts as 1 if at least half of its labels are; null ids and labels say nothing.
    """
    spark = docs.sparkSession
    prepare(spark)
    y = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
         .where("doc_id IS NOT NULL AND y IS NOT NULL").where(F.pmod(id_hash(F.col("doc_id")), F.lit(3)) != 1)
         .groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
         .withColumn("o", F.xxhash64("doc_id")).orderBy("o", "doc_id").limit(max_rows))
    y = store(y, "op13-sample")
    # at most max_rows ids and labels: small enough to broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_inputs(docs)).join(F.broadcast(y), "doc_id")
    rows = store(rows.select("__text", "__n", "y", "o")
                 .mapInArrow(_featurise(bits), "i array<int>, x array<double>, y double, o long")
                 .withColumn("shard", F.pmod("o", F.lit(shards)).cast("int")), "op13-features")
    drop_stored(y)
    state, kinds = start(bits, factors), "shard int, r int, i binary, v binary"
    width = 2 * (factors + 1)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(state)

        def fit(group: pa.Table) -> pa.Table:
            old = shared.value
            t = group.sort_by([("o", "ascending"), ("y", "ascending")])
            i, x = t.column("i").combine_chunks(), t.column("x").combine_chunks()
            off, y_ = np.asarray(i.offsets), t.column("y").to_pylist()
            flat, val = np.asarray(i.values), np.asarray(x.values)
            new = shard_pass(old, [(flat[off[k]:off[k + 1]], val[off[k]:off[k + 1]], y_[k]) for k in range(len(y_))])
            return _changes(t.column("shard")[0].as_py(), old, new)

        step = store(rows.groupBy("shard").applyInArrow(fit, kinds).groupBy("r").applyInArrow(_mean(width), kinds),
                     "op13-round")
        state = {**state, "p": state["p"].copy(), "a": state["a"].copy()}
        for x in step.toArrow().to_pylist():           # one row per range of coordinates
            v = np.frombuffer(x["v"])
            if x["r"] < 0:
                state["w0"], state["a0"] = state["w0"] + float(v[0]), state["a0"] + float(v[1])
                continue
            at = np.frombuffer(x["i"], np.int32) + x["r"] * RANGE
            v = v.reshape(-1, width)
            state["p"][at] += v[:, :factors + 1]
            state["a"][at] += v[:, factors + 1:]
        drop_stored(step)
        shared.destroy()
    drop_stored(rows)
    return {"bits": bits, "w0": state["w0"], "w": state["p"][:, 0].astype(np.float32),
            "v": state["p"][:, 1:].astype(np.float32)}


def _scorer(model):
    def run(batches):
        m = model.value
        for batch in batches:
            for lo, hi, (first, i, x) in _csr(batch.columns[:2], m["bits"]):
                z, _ = margins(m["w0"], m["w"], m["v"], first, i, x)
                yield pa.RecordBatch.from_arrays(
                    [c.slice(lo, hi - lo) for c in batch.columns[2:]]
                    + [pa.array(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))],
                    names=[*batch.schema.names[2:], "score"])
    return run


def score(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``score`` (0 to 1, higher: label 1 likelier) of every row.
    Null and empty texts have the statistics of an empty text and get a score too."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*_inputs(docs), *keep)
    fields = ", ".join(f"`{c}` {t}" for c, t in src.dtypes[2:])
    return src.mapInArrow(_scorer(shared), f"{fields}, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Rows with a null id are scored, never trained on and not held out. Repeated rows get
    equal scores. Without any usable label every score is 0.5 but for the fixed first
    factors (0.49 to 0.51). A missing or null ``n_chars`` has a bucket of its own. Other
    columns of either table are not read. An empty table gives an empty result.
    """
    model = train(docs, labels, **fit)
    out = score(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model, ["doc_id"])
    held = F.coalesce(F.pmod(id_hash(F.col("doc_id")), F.lit(3)) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
