"""Operator 5: fuzzy line de-duplication by MinHash.

A line is compared by its shingles if it has at least ``min_words`` words or
``min_chars`` characters (a line of a script without blanks is one word). Shorter ones,
of which a few characters decide, are compared as exact copies only: all of them with
``short_docs`` 1, as the registered query and the pipeline take it. A line's character shingles (of the trimmed line, A-Z
lower-cased) give one-permutation MinHash values, cut into bands. Equal lines are
one node. Lines that share a band value with at most ``PAIRED`` - 1 others are compared with
all of them by exact Jaccard similarity of their shingle sets, after a parity sketch has
dropped pairs that differ in too many shingles. In a band of more lines they are compared
with its smallest node, those still apart in ``HUB_ROUNDS`` more rounds with a node of the
band's largest component, and what is apart then with every line that a filter leaves; links
become components by a distributed union-find, and the first line (by document id, then
place) of every component is kept.

Nodes are 64-bit hashes of the line, so two unlike lines could only be taken for
one another by a hash collision.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, prepare, store
from .components import component_edges, connected_components, merged
from .prefix_filter import PARITY, WORDS, open_pairs
from .tokens import LOWER, mix, odd, text_blocks

SHINGLE = 8
BANDS, ROWS = 10, 4
PAIRED = 32                   # lines of a band up to which all its pairs are listed
HUB_ROUNDS = 2
BAND = 4096                   # lines of a band up to which one task tries its pairs
BLOCK = 64                    # of which so many at a time, 2 MB
JACCARD = 0.8
MIN_WORDS, MIN_CHARS = 5, 25
SHORT_DOCS = 10
ASCII_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def characters(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block and the texts' offsets in them."""
    raw = LOWER[buf].tobytes()
    try:
        cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    except UnicodeError:            # not UTF-8: one character per byte
        return LOWER[buf].astype(np.uint32), off
    lead = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    return cp, lead[off]


def _blank(cp: np.ndarray) -> np.ndarray:
    return (cp == 32) | ((cp >= 9) & (cp <= 13))


def word_lines(cp: np.ndarray, off: np.ndarray, min_words: int, min_chars: int):
    """(text, line number, first, end character, is it short) of every line that is
    not blank, trimmed of blanks."""
    n = len(cp)
    begin = np.zeros(n + 1, dtype=bool)
    begin[off[:-1]] = True
    begin[np.flatnonzero(cp == 10) + 1] = True
    starts = np.flatnonzero(begin[:n]) if n else np.empty(0, np.int64)
    word = ~_blank(cp)
    first = word & ~np.concatenate(([False], word[:-1])) | word & begin[:n]
    last = word & (~np.concatenate((word[1:], [False])) | begin[1:])
    ws, we = np.flatnonzero(first), np.flatnonzero(last) + 1
    k = np.searchsorted(ws, np.append(starts, n))
    some = np.flatnonzero(np.diff(k) > 0)
    text = np.searchsorted(off[1:], starts[some], side="right")
    breaks = np.concatenate(([0], np.cumsum(cp == 10)))
    number = breaks[starts[some]] - breaks[off[text]]
    s, e = ws[k[some]], we[k[some + 1] - 1]
    return text, number, s, e, (np.diff(k)[some] < min_words) & (e - s < min_chars)


def shingle_hashes(cp: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k characters, by doubling: pairs, fours, eights."""
    n = max(len(cp) - k + 1, 0)
    part, size, out, done = cp.astype(np.uint64), 1, np.zeros(n, dtype=np.uint64), 0
    while done < k:
        if (k - done) & size:
            out = out * odd(size) + part[done:done + n]
            done += size
        if done < k:
            part = part[:-size] * odd(size + 2) + part[size:]
            size *= 2
    return mix(out)


def band_values(cp: np.ndarray, s: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """Band hashes (lines x BANDS). A line shorter than a shingle has one, itself."""
    bins = BANDS * ROWS
    h = shingle_hashes(np.concatenate((cp, np.zeros(k, np.uint32))), k)
    count = np.maximum(e - s - k + 1, 1)
    head = np.concatenate(([0], np.cumsum(count)[:-1]))
    line = np.repeat(np.arange(len(s)), count)
    x = h[np.repeat(s - head, count) + np.arange(count.sum())]
    sig = np.full(len(s) * bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    place = ((x >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(sig, line * bins + place, x >> np.uint64(1))
    sig = sig.reshape(-1, bins)
    empty = sig == np.iinfo(np.uint64).max
    for _ in range(2):              # an empty bin borrows from the next filled one
        for j in range(bins - 1, -1, -1):
            nxt = (j + 1) % bins
            take = empty[:, j] & ~empty[:, nxt]
            sig[take, j] = sig[take, nxt] + odd(4)
            empty[take, j] = False
    sig = sig.reshape(-1, BANDS, ROWS)
    out = np.zeros(sig.shape[:2], dtype=np.uint64)
    for r in range(ROWS):
        out = mix(out * odd(5) + sig[:, :, r])
    return mix(out + np.arange(BANDS, dtype=np.uint64) * odd(2))


def _lines(min_words: int, min_chars: int, k: int):
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, off in text_blocks(batch.column(1), 1 << 19):
                cp, chars = characters(buf, off)
                text, number, s, e, short = word_lines(cp, chars, min_words, min_chars)
                if not len(text):
                    continue
                raw = cp.tobytes()
                key = [xxhash.xxh3_64_intdigest(raw[4 * a:4 * b]) for a, b in zip(s.tolist(), e.tolist())]
                if len(seen) > 1_000_000:
                    seen.clear()
                new = []
                for i, x in enumerate(key):
                    if not short[i] and x not in seen:
                        seen.add(x)
                        new.append(i)
                bands = band_values(cp, s[new], e[new], k) if new else np.empty((0, BANDS), np.uint64)
                count = np.zeros(len(text) + 1, dtype=np.int32)
                count[np.array(new, dtype=np.int64) + 1] = BANDS
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).take(pa.array(text)), pa.array(number.astype(np.int32)),
                     pa.array(np.array(key, dtype=np.uint64).view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.cumsum(count), pa.int32()),
                                              pa.array(bands.ravel().view(np.int64))),
                     pa.array(short)],
                    names=["doc_id", "line_no", "h", "bands", "short"])
    return run


def _band_pairs(paired: int):
    """From rows (band, h) sorted by band, the pairs (a, b) of different lines of a band: all of
    them, with ``band`` null, if it has at most ``paired`` lines, else those with one, its hub."""
    def run(batches):
        band = h = np.empty(0, dtype=np.int64)      # the last band, which may go on
        hub = None                                  # its hub, if it is known to be a long one
        for batch in chain(batches, [None]):
            if batch is not None:
                band = np.concatenate((band, batch.column(0).to_numpy()))
                h = np.concatenate((h, batch.column(1).to_numpy()))
            if not len(band):
                continue
            last, open_hub = band[-1], hub
            twice = band[1:] == band[:-1]
            some = np.append(twice, False) | np.append(False, twice)
            if batch is not None or open_hub is not None:
                some |= band == (last if batch is not None else band[0])
            x, of = h[some], band[some]
            order = np.lexsort((x, of))
            x, of = x[order], of[order]
            fresh = np.ones(len(x), dtype=bool)
            fresh[1:] = (of[1:] != of[:-1]) | (x[1:] != x[:-1])
            x, of = x[fresh], of[fresh]
            yield from _pairs_of(x, of, paired, open_hub, band[0], last if batch is not None else None)
            if batch is None:
                break
            goes_on = x[of == last]
            if open_hub is not None and band[0] == last:
                hub = open_hub
            else:
                hub = goes_on[0] if len(goes_on) > paired else None
            h = goes_on if hub is None else np.array([hub])
            band = np.full(len(h), last)
    return run


def _pairs_of(x, of, paired: int, open_hub, first, last):
    """``_band_pairs`` of the lines ``x`` of the bands ``of``, both sorted; the band ``last``
    goes on, and the band ``first`` began before with ``open_hub`` if that is given."""
    start = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(x) else np.empty(0, np.int64)
    size = np.diff(np.append(start, len(x)))
    hubs = x[start]
    large = size > paired
    if open_hub is not None:
        began = of[start] == first
        large |= began
        hubs[began] = open_hub
    done = (size > 1) & ~large
    if last is not None:
        done &= of[start] != last
    nth = np.repeat(np.arange(len(size)), size)
    small, at = x[done[nth]], nth[done[nth]]
    pairs = [(small[:0], small[:0])]
    for d in range(1, int(size[done].max(initial=1))):
        same = at[d:] == at[:-d]
        pairs.append((small[:-d][same], small[d:][same]))
    a, b = (np.concatenate(c) for c in zip(*pairs))
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())],
                                         names=["a", "b", "band"])
    rest = large[nth] & (x != hubs[nth])
    if rest.any():
        yield pa.RecordBatch.from_arrays([pa.array(hubs[nth[rest]]), pa.array(x[rest]), pa.array(of[rest])],
                                         names=["a", "b", "band"])


def line_sets(cp: np.ndarray, off: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows of every line, sorted distinct keys): a key has a shingle's hash in its lower
    ``bits`` bits and the line's index above. A line shorter than a shingle has one, itself."""
    s, length = off[:-1], np.diff(off)
    x = shingle_hashes(np.concatenate((cp, np.zeros(k, np.uint32))), k)
    count = np.maximum(length - k + 1, 1)
    head = np.concatenate(([0], np.cumsum(count)[:-1]))
    x = x[np.repeat(s - head, count) + np.arange(count.sum())]
    for i in np.flatnonzero(length < k):
        own = np.concatenate((cp[off[i]:off[i + 1]], np.zeros(k - length[i], np.uint32)))
        x[head[i]] = shingle_hashes(own, k)[0]
    x = x >> np.uint64(64 - bits) | np.repeat(np.arange(len(s), dtype=np.uint64) << np.uint64(bits), count)
    x.sort()
    return count, x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def parity_sketches(cp: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, sketch) of every line: every shingle flips one of ``PARITY`` bits, so two
    sketches differ in at most as many bits as the sets differ in shingles. Shingles count as
    40 bits of their hash, which can only lessen that; windows are at least the shingles."""
    count, x = line_sets(cp, off, k, 40)
    at = (x >> np.uint64(40)) * np.uint64(PARITY) + x % np.uint64(PARITY)
    ones = np.bincount(at.astype(np.int64), minlength=len(count) * PARITY) & 1
    return count, np.packbits(ones.astype(np.uint8)).view(np.int64).reshape(len(count), -1)


def _line_texts(k: int):
    """Text, windows and parity sketch of the wanted lines: doc rows with ``wanted`` line
    numbers and hashes. Of rows that share their id, only the one that holds the line gives it."""
    def run(batches):
        for batch in batches:
            h, out = [], []
            for row in pa.table(batch).to_pylist():
                lines = (row["text"] or "").split("\n")
                for w in row["wanted"]:
                    if w["line_no"] < len(lines):
                        x = lines[w["line_no"]].strip(" \t\n\v\f\r").translate(ASCII_LOWER)
                        if np.uint64(xxhash.xxh3_64_intdigest(x.encode("utf-32-le"))).view(np.int64) == w["h"]:
                            h.append(w["h"])
                            out.append(x)
            line = pa.array(out, pa.string())
            for lo, hi, buf, off in text_blocks(line, 1 << 19):
                cp, at = characters(buf, off)
                windows, sketch = parity_sketches(cp, at, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[lo:hi], pa.int64()), line.slice(lo, hi - lo), pa.array(windows, pa.int64()),
                     *(pa.array(np.ascontiguousarray(c)) for c in sketch.T)], names=["h", "line", "windows", *WORDS])
    return run


def similar(ta, tb, k: int, jaccard: float) -> np.ndarray:
    """Whether the shingle sets of each two texts are similar enough. Shingles count as 56
    bits of their hash."""
    keep = np.zeros(len(ta), dtype=bool)
    for lo, hi, buf, off in text_blocks(ta, 1 << 17):
        for i in range(lo, hi, 256):
            n = min(hi - i, 256)
            at = off[i - lo:i - lo + n + 1]
            cp, at = characters(buf[at[0]:at[-1]], at - at[0])
            sets = [line_sets(cp, at, k, 56)[1]]
            for lo2, _, buf2, off2 in text_blocks(tb.slice(i, n), 1 << 30):
                cp, at = characters(buf2, off2)
                sets.append(line_sets(cp, at, k, 56)[1] + (np.uint64(lo2) << np.uint64(56)))
            x = np.concatenate(sets)
            x.sort()
            line = (x >> np.uint64(56)).astype(np.int64)
            both = np.bincount(line[1:][x[1:] == x[:-1]], minlength=n)
            keep[i:i + n] = both >= jaccard * (np.bincount(line, minlength=n) - both)
    return keep


def _verify(k: int, jaccard: float):
    """The pairs (a, b, text of a, text of b) whose shingle sets are similar enough."""
    def run(batches):
        for batch in batches:
            mask = pa.array(similar(batch.column(2), batch.column(3), k, jaccard))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)],
                                             names=["a", "b"])
    return run


def _elements(k: int):
    def run(batches):
        for batch in batches:
            out = [_set(x.as_buffer(), k) for x in batch.column(1)]
            count = np.concatenate(([0], np.cumsum([len(u) for u in out])))
            flat = np.concatenate(out) if out else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(count, pa.int32()),
                                                           pa.array(flat.view(np.int64)))],
                names=["node", "elems"])
    return run


def _set(text: pa.Buffer, k: int) -> np.ndarray:
    buf = np.frombuffer(text, dtype=np.uint8) if text is not None else np.empty(0, np.uint8)
    cp, _ = characters(buf, np.array([0, len(buf)]))
    if len(cp) < k:
        cp = np.concatenate((cp, np.zeros(k - len(cp), np.uint32)))
    return np.unique(shingle_hashes(cp, k))


def _next_hubs(label: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the bands whose lines are apart, pairs of their lines with a line of the
    band's largest component): one pair per row, so linear in the bands."""
    parts = store(label.groupBy("band", "c").agg(F.count("*").alias("n"), F.min_by("h", F.xxhash64("h", F.lit(turn))).alias("hub")),
                  "op5-parts")
    top = (parts.groupBy("band").agg(F.max_by(F.struct("c", "hub"), F.struct("n", "c")).alias("t"), F.count("*").alias("k"))
           .where("k > 1").select("band", F.col("t.c").alias("tc"), F.col("t.hub").alias("hub")))
    apart = store(label.join(top, "band"), "op5-apart")
    drop_stored(parts, label)
    pairs = apart.where("c != tc").select(F.least("h", "hub").alias("a"), F.greatest("h", "hub").alias("b")).distinct()
    return apart.select("band", "h", "c"), pairs


def _band_links(k: int, jaccard: float):
    """Of the lines of one band, links (a, b) that join its components as all links between
    its lines do. Pairs of ``BLOCK`` lines with all others are taken nearest sketches first,
    and only as long as their components are apart."""
    def run(band: pa.Table) -> pa.Table:
        h, windows = band.column("h").to_numpy(), band.column("windows").to_numpy()
        line = band.column("line").combine_chunks().cast(pa.large_string())
        root = np.unique(band.column("c").to_numpy(), return_inverse=True)[1]
        sketch = np.stack([band.column(w).to_numpy() for w in WORDS], axis=1).view(np.uint64)
        links = []
        for i in range(0, len(h), BLOCK):
            to = slice(i, i + BLOCK)
            differ = np.zeros((len(h[to]), len(h) - i), dtype=np.int64)
            for w in range(len(WORDS)):
                differ += np.bitwise_count(sketch[to, w, None] ^ sketch[None, i:, w])
            far = differ / (windows[to, None] + windows[None, i:])
            x, y = np.nonzero(((1 + jaccard) * far <= 1 - jaccard + 1e-9) & (root[to, None] != root[None, i:]))
            order = np.argsort(far[x, y], kind="stable")
            x, y = x[order] + i, y[order] + i
            for at in range(0, len(x), 1024):
                u, v = x[at:at + 1024], y[at:at + 1024]
                apart = root[u] != root[v]
                u, v = u[apart], v[apart]
                near = similar(line.take(pa.array(u)), line.take(pa.array(v)), k, jaccard)
                for p, q in zip(u[near].tolist(), v[near].tolist()):
                    if root[p] != root[q]:
                        root[root == root[q]] = root[p]
                        links.append((min(h[p], h[q]), max(h[p], h[q])))
        return pa.table({"a": pa.array([p[0] for p in links], pa.int64()), "b": pa.array([p[1] for p in links], pa.int64())})
    return run


def line_components(docs: DataFrame, min_words: int = MIN_WORDS, k: int = SHINGLE, jaccard: float = JACCARD,
                    id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                    short_docs: int | None = SHORT_DOCS) -> DataFrame:
    """doc_id, line_no (from 0), keep_doc_id, keep_line_no, kept: one row per line
    that takes part; ``keep_*`` names the line that stays for its component.

    Null or empty texts and blank lines give no rows. Exact copies of lines below both
    ``min_words`` and ``min_chars`` are one component, those that at least ``short_docs``
    documents hold: every one with 1, none with None (the others give no row).
    Rows with a null id take no part. A row repeated with its id holds the same lines
    at the same places: they are one line each. Other columns are not read. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .where("doc_id IS NOT NULL AND text IS NOT NULL")
    every = store(src.mapInArrow(_lines(min_words, min_chars, k),
                                 "doc_id long, line_no int, h long, bands array<long>, short boolean"), "op5-lines")
    lines = every.where("NOT short")
    rows = lines.where("size(bands) > 0").select(F.explode("bands").alias("band"), "h")
    found = store(rows.repartition("band").sortWithinPartitions("band")
                  .mapInArrow(_band_pairs(PAIRED), "a long, b long, band long"), "op5-bands")
    pairs = store(found.select("a", "b").distinct(), "op5-pairs")
    need = pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).distinct()
    unit = F.lit(1 << 31).cast("decimal(10,0)")
    place = (F.col("doc_id").cast("decimal(20,0)") * unit + F.col("line_no")).cast("decimal(38,0)")

    def taken_apart(k: str, doc_id: str, line_no: str) -> list[Column]:
        kd = F.floor(F.col(k) / unit)
        return [kd.cast("long").alias(doc_id), (F.col(k) - kd * unit).cast("int").alias(line_no)]

    wanted = store(lines.select("h", place.alias("k")).join(need.hint("shuffle_hash"), "h", "left_semi")
                   .groupBy("h").agg(F.min("k").alias("k"))
                   .select("h", *taken_apart("k", "doc_id", "line_no"))
                   .groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "h")).alias("wanted")), "op5-wanted")
    # rows that share their id, and only they, can hold the same line at the same place
    repeated = not docs.groupBy(F.col(id_col).cast("long").alias("doc_id")).count() \
        .where("doc_id IS NOT NULL AND count > 1").isEmpty()
    texts = src.join(wanted.hint("shuffle_hash"), "doc_id") \
        .mapInArrow(_line_texts(k), "h long, line string, windows long, " + ", ".join(f"{w} long" for w in WORDS)) \
        .repartition("h")
    texts = store(texts.dropDuplicates(["h"]) if repeated else texts, "op5-texts")
    drop_stored(wanted)

    def verified(p: DataFrame) -> DataFrame:
        def end(x: str) -> DataFrame:
            return texts.select(F.col("h").alias(x), F.struct("windows", *WORDS).alias(f"s{x}"))
        differ = sum((F.bit_count(F.col(f"sa.{w}").bitwiseXOR(F.col(f"sb.{w}"))) for w in WORDS), F.lit(0))
        near = (p.join(end("a"), "a").join(end("b"), "b")
                .where((1 + jaccard) * differ <= (1 - jaccard) * (F.col("sa.windows") + F.col("sb.windows")) + 1e-6)
                .select("a", "b"))
        a = texts.select(F.col("h").alias("a"), F.col("line").alias("ta"))
        b = texts.select(F.col("h").alias("b"), F.col("line").alias("tb"))
        return store(near.join(b, "b").join(a, "a").select("a", "b", "ta", "tb")
                     .mapInArrow(_verify(k, jaccard), "a long, b long"), "op5-links")

    links = verified(pairs)
    comp = connected_components(links)
    drop_stored(links)
    # bands of more lines, as far as those other than the hub are still apart: they meet a
    # hub of the largest component of the band, another one in every round
    label = store(found.where("band IS NOT NULL").select("band", F.col("b").alias("h")).distinct()
                  .join(comp.withColumnRenamed("node", "h"), "h", "left")
                  .select("band", "h", F.coalesce("component", "h").alias("c")), "op5-label")
    drop_stored(found)
    for turn in range(HUB_ROUNDS):
        label, more = _next_hubs(label, turn)
        if label.isEmpty():
            break
        more = store(more.join(pairs, ["a", "b"], "left_anti"), "op5-more-pairs")
        pairs = pairs.union(more)
        links = verified(more)
        if links.isEmpty():
            continue
        into = connected_components(component_edges(links, comp), "ca", "cb")
        comp = merged(comp, into)
        label = store(label.join(into.select(F.col("node").alias("c"), "component"), "c", "left")
                      .select("band", "h", F.coalesce("component", "c").alias("c")), "op5-label")
        drop_stored(links)
    # what is still apart: in bands of at most ``BAND`` lines every pair is tried there, else
    # every pair that a prefix, position and parity filter leaves
    mixed = store(label.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n"))
                  .where("lo < hi").select("band", "n"), "op5-mixed")
    few, many = mixed.where(f"n <= {BAND}"), mixed.where(f"n > {BAND}")
    if not few.isEmpty():
        links = store(label.join(few, "band").join(texts, "h").groupBy("band")
                      .applyInArrow(_band_links(k, jaccard), "a long, b long").distinct(), "op5-links")
        if not links.isEmpty():
            comp = merged(comp, connected_components(component_edges(links, comp), "ca", "cb"))
        drop_stored(links)
    if not many.isEmpty():
        members = store(label.join(many, "band").groupBy(F.col("h").alias("node"))
                        .agg(F.first("c").alias("c"), F.collect_set("band").alias("keys")), "op5-members")
        wide = store(texts.join(members.select(F.col("node").alias("h")), "h")
                     .select("h", F.col("line").cast("binary").alias("line")), "op5-open-texts")
        sets = (wide.mapInArrow(_elements(k), "node long, elems array<long>"))
        rest = store(open_pairs(members, sets, round(100 * jaccard)).join(pairs, ["a", "b"], "left_anti"), "op5-rest")
        drop_stored(members, wide)
        links = verified(rest)
        if not links.isEmpty():
            comp = merged(comp, connected_components(component_edges(links, comp), "ca", "cb"))
        drop_stored(rest, links)
    drop_stored(label, mixed, pairs, texts)
    part = (every if short_docs == 1 else lines).select("doc_id", "line_no", "h")
    if short_docs is not None and short_docs > 1:
        short = every.where("short").select("doc_id", "line_no", "h")
        common = store(short.select("h", "doc_id").distinct().groupBy("h").count()
                       .where(F.col("count") >= short_docs).select("h"), "op5-short")
        part = part.union(short.join(common, "h", "left_semi").select("doc_id", "line_no", "h"))
    # lines that stand alone are their own; the others take the first place of their component
    node = comp.select(F.col("node").alias("h"), "component") \
        .union(comp.select("component", "component").distinct())
    first = store(part.groupBy("h").agg(F.min(place).alias("k"), F.count("*").alias("n"))
                  .join(node.hint("shuffle_hash"), "h", "left")
                  .where("n > 1 OR component IS NOT NULL").select("h", F.coalesce("component", "h").alias("c"), "k"),
                  "op5-first")
    keep = store(first.select("h", "c").join(first.groupBy("c").agg(F.min("k").alias("k")), "c")
                 .select("h", "c", *taken_apart("k", "keep_doc_id", "keep_line_no")), "op5-keep")
    drop_stored(first)
    out = (part.join(keep.hint("shuffle_hash"), "h", "left")
           .select("doc_id", "line_no", F.coalesce("keep_doc_id", "doc_id").alias("keep_doc_id"),
                   F.coalesce("keep_line_no", "line_no").alias("keep_line_no"), F.coalesce("c", "h").alias("c")))
    return (out.distinct() if repeated else out).select("doc_id", "line_no", "keep_doc_id", "keep_line_no",
                      ((F.col("doc_id") == F.col("keep_doc_id")) & (F.col("line_no") == F.col("keep_line_no"))).alias("kept"))


def drop_lines(docs: DataFrame, members: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that are not kept taken out of the text. A document
    of which nothing but blanks is left by that is dropped; others stay, also those
    that were null or empty before."""
    gone = (members.where("NOT kept").groupBy(F.col("doc_id").alias("__id"))
            .agg(F.collect_list("line_no").alias("__gone")))
    split = F.split(F.col(text_col), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(left, lambda i: F.element_at("__lines", i + 1)), "\n"))
    columns = [F.col(c) if c != text_col else text.alias(c) for c in docs.columns]
    return (docs.join(gone, F.col(id_col) == F.col("__id"), "left").withColumn("__lines", split)
            .select(*columns, "__gone")
            .where(F.col("__gone").isNull() | F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).drop("__gone"))
