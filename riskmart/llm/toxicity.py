"""Operator 7: toxicity by FTRL-proximal logistic regression on hashed word
n-grams and skip-grams.

Words (runs of letters and digits, lower-cased) give unigrams, bigrams and
skip-grams over one word, hashed into ``2 ** bits`` coordinates; a document holds
each of its coordinates once. Training runs in rounds: every shard of the labelled
sample passes over its rows with per-coordinate learning rates, starting from the
common state, and the shards' states are averaged per coordinate; only what changed
travels, packed by ranges of coordinates. Every coordinate of the sample is learned. The
L1 term leaves few non-zero weights, which are broadcast (at most ``2 ** bits`` of them)
to score every row in one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, id_hash, prepare, store
from .tokens import ALNUM, mix, odd, text_blocks, words

ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 1.0
CHUNK = 14            # coordinates of a range: 2 ** CHUNK, told by 16 bits
POSITIVE = 3.0        # weight of a toxic row: they are the rarer class


def coordinates(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Coordinates of unigrams, bigrams and skip-grams by the place of their first
    word. Coordinate 0 is the intercept."""
    shift = np.uint64(64 - bits)
    out = [mix(h) >> shift]
    for gap in (1, 2):
        if len(h) > gap:
            out.append(mix(h[:-gap] * odd(gap) + mix(h[gap:] ^ odd(gap + 2))) >> shift)
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return [np.maximum(x.astype(np.int64), 1) for x in out]


def document_features(h: np.ndarray, first: np.ndarray, bits: int):
    """Per text its sorted distinct coordinates."""
    per = coordinates(h, bits)
    for d in range(len(first) - 1):
        a, b = int(first[d]), int(first[d + 1])
        yield np.unique(np.concatenate([x[a:max(a, b - g)] for g, x in enumerate(per)]))


def ftrl_pass(rows, z: np.ndarray, n: np.ndarray) -> None:
    """One pass of FTRL-proximal over (coordinates, label) rows, in place."""
    for idx, y in rows:
        idx = np.concatenate(([0], idx))
        zi, ni = z[idx], n[idx]
        root = np.sqrt(ni)
        w = -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2)
        w[np.abs(zi) <= L1] = 0.0
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        if g == 0.0:
            continue
        if y > 0.5:
            g *= POSITIVE
        sigma = (np.sqrt(ni + g * g) - root) / ALPHA
        z[idx] = zi + g - sigma * w
        n[idx] = ni + g * g


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    w[np.abs(z) <= L1] = 0.0
    return w


def _featurise(bits: int):
    def run(batches):
        for batch in batches:
            y, order = batch.column(1), batch.column(2)
            for lo, hi, buf, off in text_blocks(batch.column(0)):
                h, _, _, first = words(buf, off, ALNUM)
                feats = list(document_features(h, first, bits))
                count = np.concatenate(([0], np.cumsum([len(f) for f in feats])))
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(count, pa.int32()),
                                              pa.array(np.concatenate(feats).astype(np.int32))),
                     y.slice(lo, hi - lo), order.slice(lo, hi - lo)], names=["f", "y", "o"])
    return run


def packed(key: str, value: int, hit: np.ndarray, dz: np.ndarray, dn: np.ndarray) -> pa.Table:
    """The changes of the sorted coordinates ``hit``, one row per range that has any."""
    cut = np.flatnonzero(np.diff(hit >> CHUNK)) + 1
    at = [(x, y, z) for x, y, z in zip(*(np.split(v, cut) for v in (hit, dz, dn))) if len(x)]
    low = (1 << CHUNK) - 1
    return pa.table({
        key: pa.array([value] * len(at), pa.int32()), "p": pa.array([int(x[0]) >> CHUNK for x, _, _ in at], pa.int32()),
        "i": pa.array([(x & low).astype(np.uint16).tobytes() for x, _, _ in at], pa.binary()),
        "dz": pa.array([y.tobytes() for _, y, _ in at], pa.binary()),
        "dn": pa.array([y.tobytes() for _, _, y in at], pa.binary())})


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the range and their changes."""
    return (np.frombuffer(row["i"], np.uint16).astype(np.int64), np.frombuffer(row["dz"], np.float64),
            np.frombuffer(row["dn"], np.float64))


def total(group: pa.Table) -> pa.Table:
    """The shards' changes of one range, added up in the order of the shards."""
    dz, dn = np.zeros(1 << CHUNK), np.zeros(1 << CHUNK)
    rows = group.sort_by("s").to_pylist()
    for r in rows:
        i, x, y = unpacked(r)
        dz[i] += x
        dn[i] += y
    hit = np.flatnonzero((dz != 0) | (dn != 0))
    out = packed("s", 0, hit, dz[hit], dn[hit])
    return out.set_column(1, "p", pa.array([rows[0]["p"]] * len(out), pa.int32()))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bits: int = 20,
          max_rows: int = 16_384, shards: int = 4, rounds: int = 8) -> dict:
    """Fit on labelled documents with crc32(doc_id) mod 3 != 1.

    At most ``max_rows`` of them are used, those with the smallest hash of their
    id, so the fitted weights do not depend on partitioning. A document labelled
    several times counts as positive if at least half of its labels are.
    """
    spark = docs.sparkSession
    y = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
         .where("doc_id IS NOT NULL AND y IS NOT NULL").where(F.pmod(id_hash(F.col("doc_id")), F.lit(3)) != 1)
         .groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
         .withColumn("o", F.xxhash64("doc_id")).orderBy("o", "doc_id").limit(max_rows))
    # at most max_rows ids: small enough to broadcast
    y = store(y, "op7-sample")
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(y), "doc_id").select("text", "y", "o"))
    features = store(rows.mapInArrow(_featurise(bits), "f array<int>, y double, o long")
                     .withColumn("shard", F.pmod("o", F.lit(shards)).cast("int")), "op7-features")
    sc = spark.sparkContext
    size = 1 << bits
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(rounds):
        state = sc.broadcast((z, n))

        def fit(group: pa.Table) -> pa.Table:
            z0, n0 = state.value
            z1, n1 = z0.copy(), n0.copy()
            t = group.sort_by([("o", "ascending"), ("y", "ascending")])
            f, ys = t.column("f").combine_chunks(), t.column("y").to_pylist()
            off, flat = np.asarray(f.offsets), np.asarray(f.values)
            ftrl_pass(((flat[off[i]:off[i + 1]], ys[i]) for i in range(len(ys))), z1, n1)
            hit = np.flatnonzero((z1 != z0) | (n1 != n0))
            return packed("s", t.column("shard")[0].as_py(), hit, z1[hit] - z0[hit], n1[hit] - n0[hit])

        kinds = "s int, p int, i binary, dz binary, dn binary"
        step = store(features.groupBy("shard").applyInArrow(fit, kinds).groupBy("p").applyInArrow(total, kinds),
                     "op7-round")
        z, n = z.copy(), n.copy()
        for r in step.toArrow().to_pylist():            # one row per range of coordinates
            i, dz, dn = unpacked(r)
            i += r["p"] << CHUNK
            z[i] += dz / shards
            n[i] += dn / shards
        drop_stored(step)
        state.destroy()
    drop_stored(y, features)
    w = weights(z, n)
    keep = np.flatnonzero(w)
    return {"bits": bits, "index": keep.astype(np.int32), "weight": w[keep]}


def _scorer(model, text_at: int):
    def run(batches):
        m = model.value
        bits = m["bits"]
        w = np.zeros(1 << bits)
        w[m["index"]] = m["weight"]
        for batch in batches:
            for lo, hi, buf, off in text_blocks(batch.column(text_at)):
                h, _, _, first = words(buf, off, ALNUM)
                place = np.arange(len(h))
                doc = np.searchsorted(first[1:], place, side="right")
                d_all, i_all = [], []
                for gap, idx in enumerate(coordinates(h, bits)):
                    ok = w[idx] != 0.0
                    at = np.flatnonzero(ok)
                    at = at[doc[at] == doc[at + gap]] if gap else at
                    d_all.append(doc[at])
                    i_all.append(idx[at])
                pairs = np.unique(np.concatenate(d_all).astype(np.int64) << bits
                                  | np.concatenate(i_all))
                margin = np.full(hi - lo, w[0])
                np.add.at(margin, pairs >> bits, w[pairs & ((1 << bits) - 1)])
                yield pa.RecordBatch.from_arrays(
                    [c.slice(lo, hi - lo) for c in batch.columns]
                    + [pa.array(1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500))))],
                    names=[*batch.schema.names, "score"])
    return run


def score(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and ``score`` (0 to 1, higher: more likely toxic) of every
    row. Null or empty text has the score of the intercept alone; words of any
    number and length are read in bounded blocks."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in keep if c != text_col]
    src = docs.select(F.col(text_col).cast("string").alias(text_col), *kept)
    fields = ", ".join(f"`{c}` {t}" for c, t in src.dtypes)
    out = src.mapInArrow(_scorer(shared, 0), f"{fields}, score double")
    return out.select(*keep, "score")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Rows with a null id are scored, never trained on, and not held out. Repeated
    rows get equal scores. Without any usable label every score is 0.5. Other
    columns of either table are not read.
    """
    model = train(docs, labels, **fit)
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, ["doc_id"])
    held = F.coalesce(F.pmod(id_hash(F.col("doc_id")), F.lit(3)) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
