"""Operator 1: n-gram Jaccard self-join with PartEnum signatures.

Two sets of sizes a <= b with Jaccard at least ``percent``/100 differ in at most
k elements, and both sizes fall into one size band (bands overlap so that every
qualifying pair shares one). For a band the hashed feature domain is partitioned
into groups of cells. By the pigeonhole principle some group differs in few
elements, so the two sets agree on all but that many of its cells: every subset
of the group's cells that leaves those out gives one signature, and a qualifying
pair shares a signature.

One group more than needed is used: a pair then agrees in at least
``spare + 1`` groups, so a set may leave out signatures over fewer than ``WEAK``
elements unless more than ``spare`` of its groups have such; a pair that agrees on
weak signatures only has equally many of them on both sides. Without them,
documents that merely share a common passage do not meet.

Documents with equal sets form one class. Within a signature every class is
verified against the smallest one (the hub), which keeps the pairs linear in the
signatures however many near copies there are. Before a text travels, a pair must pass
two tests that no qualifying pair fails: of sizes, and of cell sums. A class carries one
byte per cell of its hash domain, the sum of its hashes there; a qualifying pair differs
in at most k elements, so in at most k cells, while documents that share a passage differ
in most of them. Only where a signature's classes
are still in different components after that, the remaining pairs between those
components that a prefix and position filter leaves are verified too, so no link
that could join components is left out.
"""

from __future__ import annotations

from collections import OrderedDict
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, prepare, store
from .components import component_edges, connected_components, merged
from .prefix_filter import open_pairs
from .tokens import NOT_SPACE, mix, shingle_sets, text_blocks, words

WEAK = 3
HELD = 4_000_000      # shingles a verifying task keeps (32 MB)
PASSES = 3            # shares in which signatures are dealt, so that shuffles hold one share
SMALL_K = 32          # up to this distance: three cells a group, subsets of two


class Bands:
    """Size bands and their partition of the hash domain."""

    def __init__(self, percent: int):
        self.percent = percent
        self.bands: list[tuple] = []
        self._low = 1

    def _grow(self, n: int) -> None:
        p = self.percent
        # every band that holds n, not only the first: which signatures a set has must
        # not depend on the sets met before it
        while self._low <= n:
            lo = self._low
            hi = max(lo, lo * 3 // 2)
            # |x ^ y| <= (100 - p) (a + b) / (100 + p), and a + b <= 2 hi
            k = (100 - p) * 2 * hi // (100 + p)
            if k == 0:
                groups, cells, spare = 1, 1, 0
            elif k < SMALL_K:
                spare = 1
                groups, cells = -(-(k + 1) // 2) + spare, 3
            else:
                spare = max(1, (k + 1) // 10)
                groups, cells = k + 1 + spare, 1
            total = groups * cells
            edges = np.array([(j << 64) // total for j in range(1, total)], dtype=np.uint64)
            salt = mix(np.arange(3 * groups, dtype=np.uint64)
                       + np.uint64(len(self.bands) << 32) + np.uint64(1))
            self.bands.append((lo, hi, groups, cells, spare, edges, salt))
            self._low = max(lo + 1, -(-p * (hi + 1) // 100))

    def of(self, n: int):
        self._grow(n)
        for b in reversed(self.bands):
            if b[0] <= n <= b[1]:
                yield b
            elif b[1] < n:
                break

    def cells(self, u: np.ndarray) -> bytes:
        """Sum of the mixed hashes, modulo 256, in each cell of the domain: a power of
        two of cells, above twice the distance a set of this size may have."""
        spread = 2 * ((100 - self.percent) * 2 * len(u) // (100 + self.percent)) + 16
        bits = int(spread - 1).bit_length()
        at = (u >> np.uint64(64 - bits)).astype(np.int64)
        sums = np.zeros(1 << bits, dtype=np.uint8)
        np.add.at(sums, at, (mix(u) & np.uint64(0xFF)).astype(np.uint8))
        return sums.tobytes()

    def signatures(self, u: np.ndarray) -> np.ndarray:
        """Signatures of a sorted set of uniform 64-bit hashes."""
        n = len(u)
        if n == 0:
            return np.empty(0, dtype=np.uint64)
        run = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix(u + np.uint64(0x5851F42D4C957F2D)), out=run[1:])
        out = []
        for _, _, groups, cells, spare, edges, salt in self.of(n):
            at = np.concatenate(([0], np.searchsorted(u, edges), [n]))
            size, total = np.diff(at), np.diff(run[at])
            if cells == 3:
                size, total = size.reshape(-1, 3), mix(total.reshape(-1, 3))
                pair = ((0, 1), (0, 2), (1, 2))
                m = np.stack([size[:, i] + size[:, j] for i, j in pair], axis=1)
                s = np.stack([total[:, i] + total[:, j] * np.uint64(3) for i, j in pair], axis=1)
                s = mix(s + salt.reshape(-1, 3))
            else:
                m = size.reshape(-1, 1)
                s = mix(total + salt[:groups]).reshape(-1, 1)
            weak = m < WEAK
            if spare and weak.any(axis=1).sum() <= spare:
                s = s[~weak]
            out.append(s.ravel())
        return np.concatenate(out)


def _heads(percent: int, k: int):
    def run(batches):
        bands = Bands(percent)
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, off in text_blocks(batch.column(1)):
                h, _, _, first = words(buf, off, NOT_SPACE)
                n, key, sig, cell, count = [], [], [], [], [0]
                for _, u in shingle_sets(h, first, k):
                    n.append(len(u))
                    cell.append(bands.cells(u))
                    key.append(xxhash.xxh3_128_intdigest(u.tobytes()))
                    s = bands.signatures(u)
                    sig.append(s)
                    count.append(count[-1] + len(s))
                flat = np.concatenate(sig) if sig else np.empty(0, np.uint64)
                m = (1 << 64) - 1
                k1 = np.array([x >> 64 for x in key], dtype=np.uint64).view(np.int64)
                k2 = np.array([x & m for x in key], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(k1), pa.array(k2),
                     pa.array(cell, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(count, pa.int32()),
                                              pa.array(flat.view(np.int64)))],
                    names=["doc_id", "n", "k1", "k2", "cells", "sigs"])
    return run


def cell_distance(x: bytes, y: bytes) -> int:
    """Cells in which two sets' sums differ; the finer partition is folded first."""
    u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(u) < len(v):
        u, v = v, u
    if len(u) > len(v):
        u = u.reshape(len(v), -1).sum(axis=1, dtype=np.uint8)
    return int(np.count_nonzero(u != v))


def _close(percent: int):
    """Pairs (a, b, na, nb, ca, cb) whose cells differ in no more than a qualifying pair may."""
    def run(batches):
        for batch in batches:
            size = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            ca, cb = batch.column(4), batch.column(5)
            keep = np.array([(100 + percent) * cell_distance(ca[i].as_py(), cb[i].as_py()) <= (100 - percent) * int(size[i])
                             for i in range(batch.num_rows)], dtype=bool)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])
    return run


def _verify(percent: int, k: int):
    def run(batches):
        kept: OrderedDict = OrderedDict()
        held = 0

        def sets(key, text):
            nonlocal held
            if key in kept:
                kept.move_to_end(key)
                return kept[key]
            buf = np.frombuffer(text.as_buffer() or b"", dtype=np.uint8)
            h, _, _, first = words(buf, np.array([0, len(buf)]), NOT_SPACE)
            u = next(shingle_sets(h, first, k))[1]
            kept[key] = u
            held += len(u)
            while held > HELD and len(kept) > 1:
                held -= len(kept.popitem(last=False)[1])
            return u

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = batch.column(2), batch.column(3)
            keep = np.zeros(len(a), dtype=bool)
            for i, (x, y) in enumerate(zip(a, b)):
                u, v = sets((x, len(ta[i].as_buffer() or b"")), ta[i]), \
                    sets((y, len(tb[i].as_buffer() or b"")), tb[i])
                small, large = min(len(u), len(v)), max(len(u), len(v))
                if small == 0 or 100 * small < percent * large:
                    continue
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep[i] = 100 * both >= percent * (small + large - both)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))],
                names=["a", "b"])
    return run


def _elements(k: int):
    def run(batches):
        for batch in batches:
            rep, out, count = batch.column(0), [], [0]
            for _, _, buf, off in text_blocks(batch.column(1)):
                h, _, _, first = words(buf, off, NOT_SPACE)
                for _, u in shingle_sets(h, first, k):
                    out.append(u)
                    count.append(count[-1] + len(u))
            flat = np.concatenate(out) if out else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [rep, pa.ListArray.from_arrays(pa.array(count, pa.int32()), pa.array(flat.view(np.int64)))],
                names=["node", "elems"])
    return run


def _open_pairs(open_rows: DataFrame, src: DataFrame, heads: DataFrame, percent: int, k: int) -> DataFrame:
    members = store(open_rows.groupBy(F.col("rep").alias("node"))
                    .agg(F.first("c").alias("c"), F.collect_set("sig").alias("keys")), "op1-members")
    # their texts are read twice, so they are fetched once
    texts = store(src.join(members.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), "op1-open-texts")
    rows = texts
    many = store(heads.groupBy("doc_id").count().where("count > 1").select("doc_id"), "op1-repeated")
    if not many.isEmpty():      # only rows whose id occurs again are compared with each other
        rows = rows.join(many, "doc_id", "left_anti") \
            .unionByName(rows.join(many, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    sets = (rows.select(F.col("doc_id").alias("node"), "text").mapInArrow(_elements(k), "node long, elems array<long>"))
    out = open_pairs(members, sets, percent)
    drop_stored(members, texts, many)
    return out


def ngram_components(docs: DataFrame, k: int = 3, percent: int = 90,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose sets of distinct ``k``-word shingles have
    Jaccard similarity of at least ``percent`` / 100.

    Returns doc_id, n_shingles, component_id, one row per input row. Words are runs
    of non-blank characters, A-Z lower-cased; fewer than ``k`` words give one
    shingle. Null or blank text: n_shingles 0 and its own component. A row with a
    null id links with nothing and has a null component. Repeated rows get the same
    answer each; rows that repeat an id with another text are judged by their own
    text. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.col(text_col).cast("string").alias("text"))
    first = store(src.mapInArrow(_heads(percent, k), "doc_id long, n long, k1 long, k2 long, cells binary, sigs array<long>"),
                  "op1-first")
    key = ["n", "k1", "k2"]
    classes = store(first.where("n > 0 AND doc_id IS NOT NULL").groupBy(*key)
                    .agg(F.min("doc_id").alias("rep")), "op1-classes")
    # one row per class from here on; the documents keep their class's key only
    name = classes.select(*key, F.col("rep").alias("doc_id"))

    def share(col: str, i: int):
        return F.pmod(F.col(col), F.lit(PASSES)) == i
    reps_parts = [store(first.where("n > 0").where(share("k1", i))
                        .join(name.where(share("k1", i)), [*key, "doc_id"], "left_semi")
                        .select(F.col("doc_id").alias("rep"), "n", "cells", "sigs"), "op1-reps") for i in range(PASSES)]
    reps = reduce(DataFrame.unionByName, reps_parts)
    heads = store(first.select("doc_id", *key), "op1-heads")
    drop_stored(first)
    shared_parts = []
    for i in range(PASSES):
        rows = reps.select("rep", F.explode("sigs").alias("sig")).where(share("sig", i))
        hubs = store(rows.groupBy("sig").agg(F.min("rep").alias("hub"), F.max("rep").alias("top"))
                     .where("hub < top").select("sig", "hub"), "op1-hubs")
        shared_parts.append(store(rows.join(hubs, "sig").where("rep != hub"), "op1-shared"))
        drop_stored(hubs)
    shared = reduce(DataFrame.unionByName, shared_parts)
    cells = store(reps.select("rep", "n", "cells"), "op1-cells")
    drop_stored(*reps_parts)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Links among the pairs (a, b): sizes and cells first, then texts."""
        def side(x: str) -> DataFrame:
            return cells.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("cells").alias(f"c{x}"))
        fit = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
        near = store(pairs.join(side("a"), "a").join(side("b"), "b").where(fit)
                     .select("a", "b", "na", "nb", "ca", "cb").mapInArrow(_close(percent), "a long, b long")
                     .distinct(), "op1-near")
        need = near.select(F.col("a").alias("doc_id")).union(near.select(F.col("b").alias("doc_id"))).distinct()
        texts = store(src.join(need, "doc_id", "left_semi").distinct(), "op1-texts")
        a = texts.select(F.col("doc_id").alias("a"), F.col("text").cast("binary").alias("ta"))
        b = texts.select(F.col("doc_id").alias("b"), F.col("text").cast("binary").alias("tb"))
        joined = near.join(a, "a").join(b, "b").select("a", "b", "ta", "tb")
        out = store(joined.mapInArrow(_verify(percent, k), "a long, b long"), name)
        drop_stored(near, texts)
        return out

    links = verified(shared.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "op1-links")
    comp = connected_components(links)
    label = (shared.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
             .select("sig", "rep", F.coalesce("component", "rep").alias("c")))
    label = store(label, "op1-labels")
    drop_stored(*shared_parts)
    mixed = store(label.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
                  .where("lo < hi").select("sig"), "op1-mixed")
    rest = _open_pairs(label.join(mixed, "sig"), src, heads, percent, k)
    drop_stored(label, mixed)
    more = verified(rest, "op1-more")
    if not more.isEmpty():
        comp = merged(comp, connected_components(component_edges(more, comp), "ca", "cb"))
    drop_stored(cells, rest)
    return (heads.join(classes, key, "left")
            .join(comp.withColumnRenamed("node", "rep"), "rep", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(),
                           F.coalesce("component", "rep", "doc_id")).alias("component_id")))
