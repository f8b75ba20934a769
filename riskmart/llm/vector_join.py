"""Operator 2: embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine at least ``cosine`` have squared distance at most
2 - 2 cosine. Vectors are rotated to principal axes (of a bounded sample) and
split into blocks of few axes; each block gets a share of the squared distance in
proportion to its variance. A qualifying pair stays within that share in at least
one block, so the union over the blocks of range joins with those radii holds every
pair; each candidate is then verified by its cosine in double precision. Axes are
dealt out so that every block leads with a strong one, and a block's range join
meets only grid cells of that axis next to one another. How many blocks there are is
chosen by the work they leave on the sample: where the grids prune little, every pair
is met once per block, and fewer blocks are cheaper.

Equal vectors form one class. Cells are cut into pieces of about ``PIECE`` classes
that are compared piece by piece inside tasks, which return link counts and a
spanning set of links only: at most a few rows per class and piece, also when a
third of all vectors link with one another. A pair that several blocks find is
counted by the first. Inside a tile one product in single precision, with a margin
above its rounding, finds the pairs worth a test in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, prepare, store
from .components import connected_components

AXES = 16             # axes per block, at least
PIECE = 8192
TILE = 1024
SAMPLE = 8192
SLACK = 1e-12
TEST = 20             # cost of looking at a pair, in multiplications


def _clean(kind: str):
    def run(batches):
        for batch in batches:
            yield _clean_batch(batch, kind)
    return run


def unit(raw: bytes, kind: str) -> np.ndarray:
    """Rows of unit vectors in double precision from stored components."""
    x = np.frombuffer(raw, dtype=kind).astype(np.float64)
    return x / np.sqrt((x * x).sum())


def units(raw: bytes, kind: str, dim: int) -> np.ndarray:
    x = np.frombuffer(raw, dtype=kind).astype(np.float64).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _clean_batch(batch, kind):
    ids = batch.column(0)
    dim, key, raw = [], [], []
    for v in batch.column(1).to_pylist():
        x = np.array(v, dtype=np.float64) if v and None not in v else np.empty(0)
        ok = len(x) > 0 and np.isfinite(x).all()
        norm = float(np.sqrt((x * x).sum())) if ok else 0.0
        if ok and kind == "f8" and (norm < 1e-100 or not norm < 1e100):
            # scaled by a power of two, so squares neither under- nor overflow
            x = x / 2.0 ** np.floor(np.log2(np.abs(x).max())) if x.any() else x
            norm = float(np.sqrt((x * x).sum()))
        if ok and norm > 0.0:
            b = (x + 0.0).astype(kind).tobytes()            # -0.0 is 0.0
            k = xxhash.xxh3_128_intdigest(b)
            dim.append(len(x))
            key.append((np.uint64(k >> 64).view(np.int64), np.uint64(k & (1 << 64) - 1).view(np.int64)))
            raw.append(b)
        else:
            dim.append(0)
            key.append((0, 0))
            raw.append(None)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(dim, pa.int32()), pa.array([k[0] for k in key], pa.int64()),
         pa.array([k[1] for k in key], pa.int64()), pa.array(raw, pa.binary())],
        names=["vec_id", "dim", "k1", "k2", "u"])


def _frame(sample: list[bytes], dim: int, cosine: float, kind: str) -> dict:
    """Rotation, blocks, squared budgets and cell widths for vectors of one length."""
    x = np.array([unit(b, kind) for b in sample]) if sample else np.zeros((1, dim))
    cov = x.T @ x / len(x)
    value, axis = np.linalg.eigh(cov)
    order = np.argsort(-value)
    best, least = None, np.inf
    for blocks in range(1, max(1, dim // AXES) + 1):
        of = [order[b::blocks] for b in range(blocks)]
        var = np.array([max(value[o].sum(), 1e-9) for o in of])
        budget = (2.0 - 2.0 * cosine) * var / var.sum() + SLACK
        frame = {"rotation": [np.ascontiguousarray(axis[:, o]) for o in of], "budget": budget,
                 "width": np.sqrt(budget) * (1 + 1e-9), "kind": kind}
        work = sum(_met(np.floor(x @ rot[:, 0] / width)) * (rot.shape[1] + TEST)
                   for rot, width in zip(frame["rotation"], frame["width"]))
        if work < least:
            best, least = frame, work
    return best


def _met(cell: np.ndarray) -> float:
    """Pairs in the same cell or in neighbouring ones."""
    at, n = np.unique(cell, return_counts=True)
    n = n.astype(float)
    return float((n * n).sum() / 2 + (n[:-1] * n[1:])[np.diff(at) == 1].sum())


def _single(x: np.ndarray, sq: np.ndarray, left: bool) -> np.ndarray:
    """Single-precision rows whose products are squared distances."""
    one = np.ones(len(x))
    cols = (-2.0 * x, sq[:, None], one[:, None]) if left else (x, one[:, None], sq[:, None])
    return np.hstack(cols).astype(np.float32)


def _cells(frames):
    def run(batches):
        f = frames.value
        for batch in batches:
            rep, n, dim, u = (batch.column(i).to_pylist() for i in range(4))
            out = [[], [], [], [], [], []]
            for d in sorted(set(dim)):
                at = [i for i, x in enumerate(dim) if x == d]
                x = np.array([unit(u[i], f[d]["kind"]) for i in at])
                for b, (rot, width) in enumerate(zip(f[d]["rotation"], f[d]["width"])):
                    cell = np.floor(x @ rot[:, 0] / width).astype(np.int64)
                    for k, i in enumerate(at):
                        for col, v in zip(out, (d, b, int(cell[k]), rep[i], n[i], u[i])):
                            col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()),
                 pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.binary())],
                names=["dim", "block", "cell", "rep", "n", "u"])
    return run


def _pack(group: pa.Table) -> pa.Table:
    group = group.sort_by("rep")
    first = {c: group.column(c)[0].as_py() for c in ("dim", "block", "cell", "piece")}
    return pa.table({**{c: [v] for c, v in first.items()},
                     "ids": [np.asarray(group.column("rep"), dtype=np.int64).tobytes()],
                     "ns": [np.asarray(group.column("n"), dtype=np.int64).tobytes()],
                     "us": [b"".join(group.column("u").to_pylist())]},
                    schema=pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("cell", pa.int64()),
                                      ("piece", pa.int64()), ("ids", pa.binary()), ("ns", pa.binary()),
                                      ("us", pa.binary())]))


def _settle(i, j, la, lb):
    """Smallest label along the links (i, j), until nothing changes."""
    while True:
        a, b = la.copy(), lb.copy()
        np.minimum.at(la, i, lb[j])
        np.minimum.at(lb, j, la[i])
        if (a == la).all() and (b == lb).all():
            return


def _meet(frames, cosine: float):
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["side"])
        a, b2 = rows[0], rows[-1]
        f, b, d = frames.value[a["dim"]], a["block"], a["dim"]
        same = len(rows) == 1
        ia, na = np.frombuffer(a["ids"], np.int64), np.frombuffer(a["ns"], np.int64).astype(float)
        ib, nb = np.frombuffer(b2["ids"], np.int64), np.frombuffer(b2["ns"], np.int64).astype(float)
        ua = units(a["us"], f["kind"], d)
        ub = ua if same else units(b2["us"], f["kind"], d)
        ra = [ua @ f["rotation"][e] for e in range(b + 1)]
        rb = [ub @ f["rotation"][e] for e in range(b + 1)]
        sq = [(x * x).sum(axis=1) for x in rb]
        left, right = _single(ra[b], (ra[b] * ra[b]).sum(axis=1), True), _single(rb[b], sq[b], False)
        # terms of a product sum to 4 at most; twice the rounding of as many terms
        limit = np.float32(f["budget"][b] + 8 * (left.shape[1] + 4) * 2.0 ** -24)
        ca, cb = np.zeros(len(ia)), np.zeros(len(ib))
        # labels are node ids; a piece met with itself has one label table
        la, lb = ia.copy(), ib.copy()
        if same:
            lb = la
        for s in range(0, len(ia), TILE):
            e = min(s + TILE, len(ia))

            def near(k):
                x = ra[k][s:e]
                return (x * x).sum(axis=1)[:, None] + sq[k][None, :] - 2.0 * (x @ rb[k].T) <= f["budget"][k]

            hit = left[s:e] @ right.T <= limit
            if same:
                hit &= np.arange(len(ib))[None, :] > np.arange(s, e)[:, None]
            if np.count_nonzero(hit) > 0.02 * hit.size:
                hit &= near(b)
                hit &= ua[s:e] @ ub.T >= cosine
                for k in range(b):
                    hit &= ~near(k)
                i, j = np.nonzero(hit)
            else:
                i, j = np.nonzero(hit)
                ok = (ua[s + i] * ub[j]).sum(axis=1) >= cosine
                i, j = i[ok], j[ok]
                for k in range(b + 1):
                    gap = ra[k][s + i] - rb[k][j]
                    ok = ((gap * gap).sum(axis=1) <= f["budget"][k]) == (k == b)
                    i, j = i[ok], j[ok]
            if len(i):
                np.add.at(ca, s + i, nb[j])
                np.add.at(cb, j, na[s + i])
                _settle(s + i, j, la, lb)
        ids, links, peer = [], [], []
        for node, count, label in ((ia, ca, la), (ib, cb, lb)):
            at = np.flatnonzero(count)
            ids.append(node[at])
            links.append(count[at].astype(np.int64))
            peer.append(label[at])
        return pa.table({"rep": np.concatenate(ids), "links": np.concatenate(links), "peer": np.concatenate(peer)})
    return run


def vector_components(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id",
                      vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row.

    Vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing; so do rows without an id (their component is null). Vectors of
    different lengths are never linked. Equal vectors, repeated rows among them, are
    links of one another. Other columns are not read; an empty table gives none.
    """
    spark = vectors.sparkSession
    prepare(spark)
    # components travel in their own precision; all arithmetic is in double
    kind = "f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "f8"
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                         F.col(vector_col).cast("array<double>").alias("v"))
    rows = store(src.mapInArrow(_clean(kind), "vec_id long, dim int, k1 long, k2 long, u binary"), "op2-rows")
    key = ["dim", "k1", "k2"]
    good = rows.where("dim > 0 AND vec_id IS NOT NULL")
    classes = store(good.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"),
                                           F.min("u").alias("u")), "op2-classes")
    dims = [r["dim"] for r in classes.select("dim").distinct().collect()]
    frames = {}
    for d in dims:
        part = classes.where(F.col("dim") == d).select("k1", "u").orderBy("k1").limit(SAMPLE)
        frames[d] = _frame([r["u"] for r in part.collect()], d, cosine, kind)
    shared = spark.sparkContext.broadcast(frames)
    cells = store(classes.select("rep", "n", "dim", "u").mapInArrow(
        _cells(shared), "dim int, block int, cell long, rep long, n long, u binary"), "op2-cells")
    place = ["dim", "block", "cell"]
    size = store(cells.groupBy(*place).agg(F.count("*").alias("rows")), "op2-sizes")
    pieces = store(cells.join(size, place)
                   .withColumn("piece", F.pmod(F.xxhash64("rep"), F.ceil(F.col("rows") / PIECE)))
                   .drop("rows").groupBy(*place, "piece").applyInArrow(
                       _pack, "dim int, block int, cell long, piece long, ids binary, ns binary, us binary"),
                   "op2-pieces")
    spot = [*place, "piece"]
    name = pieces.select(*spot)
    a, b = name.alias("a"), name.alias("b")
    meet = a.join(b, (F.col("a.dim") == F.col("b.dim")) & (F.col("a.block") == F.col("b.block"))
                  & ((F.col("a.cell") == F.col("b.cell")) | (F.col("a.cell") + 1 == F.col("b.cell")))
                  & ((F.col("a.cell") < F.col("b.cell")) | (F.col("a.piece") <= F.col("b.piece"))))
    meet = store(meet.select("a.dim", "a.block", "a.cell", "a.piece", F.col("b.cell").alias("cell2"),
                             F.col("b.piece").alias("piece2")), "op2-meet")
    # each piece goes once to every meeting it takes part in
    pair = ["dim", "block", "ca", "pa", "cb", "pb"]
    named = meet.select("dim", "block", F.col("cell").alias("ca"), F.col("piece").alias("pa"),
                        F.col("cell2").alias("cb"), F.col("piece2").alias("pb"))
    same = (F.col("ca") == F.col("cb")) & (F.col("pa") == F.col("pb"))
    sides = named.select(*pair, F.col("ca").alias("cell"), F.col("pa").alias("piece"), F.lit(0).alias("side")) \
        .union(named.where(~same).select(*pair, F.col("cb").alias("cell"), F.col("pb").alias("piece"),
                                         F.lit(1).alias("side")))
    found = store(pieces.join(sides, spot).groupBy(*pair).applyInArrow(
        _meet(shared, cosine), "rep long, links long, peer long"), "op2-found")
    comp = connected_components(found, "rep", "peer")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    drop_stored(cells, size, pieces, meet)
    out = (rows.where("dim > 0 AND vec_id IS NOT NULL").select("vec_id", *key)
           .join(classes.select(*key, "rep", "n"), key).join(links, "rep", "left")
           .join(comp.withColumnRenamed("node", "rep"), "rep", "left")
           .select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"),
                   F.coalesce("component", "rep").alias("component_id")))
    alone = rows.where("dim = 0 OR vec_id IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
