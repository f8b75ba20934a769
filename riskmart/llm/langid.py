"""Operator 3: language identification by unigram pieces, marginal over segmentations.

The pieces are those of a fixed public vocabulary (never trained here) plus all
single bytes, so every word can be segmented. Per language the piece
probabilities are learned by expectation-maximisation over word counts, each word
weighted over all its segmentations (forward-backward). A text's score under a
language is the sum over its words of the log of the total probability of all
segmentations, from the forward pass alone.

A word is a run of ASCII letters and non-ASCII bytes (A-Z lower-cased) with a
leading word mark, cut every ``LONGEST`` bytes. Words are scored once per task and
batch of texts, however often they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, id_hash, prepare, store
from .tokens import byte_table, mix, text_blocks, words

VOCABULARY_FILE = "/opt/tokenizers/piece_bpe_32k.model"
LETTERS = byte_table(set(range(0x41, 0x5B)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100)))
LONGEST = 64
SCALE = 24.0           # factor per byte that keeps products of probabilities near 1
SMOOTH = 0.05
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
UNKNOWN = "und"


def load_pieces(path: str = VOCABULARY_FILE) -> list[bytes]:
    """Distinct byte strings of the pieces that can occur in a word."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        raw = model.id_to_piece(i).replace("▁", " ").encode()
        body = raw[1:] if raw[:1] == b" " else raw
        if all(LETTERS[c] and not 0x41 <= c <= 0x5A for c in body) and len(raw) <= 24:
            out.add(raw)
    return sorted(out)


def _hash(raw: np.ndarray) -> np.ndarray:
    """Hash of equally long byte strings (rows)."""
    h = np.zeros(len(raw), dtype=np.uint64)
    for j in range(raw.shape[1]):
        h = h * BASE + (raw[:, j].astype(np.uint64) + np.uint64(1))
    return h


class Lattice:
    """Piece numbers of all substrings of words of one length."""

    def __init__(self, pieces: list[bytes]):
        self.n = len(pieces)
        self.longest = max(map(len, pieces))
        self.by_length = {}
        for size in sorted({len(p) for p in pieces}):
            at = [i for i, p in enumerate(pieces) if len(p) == size]
            h = mix(_hash(np.frombuffer(b"".join(pieces[i] for i in at), dtype=np.uint8).reshape(-1, size)))
            order = np.argsort(h)
            self.by_length[size] = (h[order], np.array(at, dtype=np.int64)[order])

    def arcs(self, raw: np.ndarray):
        """(start, end, piece numbers of all words) of every span; words whose span
        is no piece have the number n."""
        length = raw.shape[1]
        for size, (known, number) in self.by_length.items():
            for s in range(length - size + 1):
                h = mix(_hash(raw[:, s:s + size]))
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                if hit.any():
                    yield s, s + size, np.where(hit, number[at], self.n)


def forward(lattice: Lattice, raw: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log probability of each word under each column of ``p`` (pieces + 1 rows)."""
    length = raw.shape[1]
    ends: list[list] = [[] for _ in range(length + 1)]
    for s, e, ids in lattice.arcs(raw):
        ends[e].append((s, ids))
    alpha = [np.ones((len(raw), p.shape[1]))]
    for t in range(1, length + 1):
        a = np.zeros_like(alpha[0])
        for s, ids in ends[t]:
            a += alpha[s] * p[ids] * SCALE ** (t - s)
        alpha.append(a)
    return np.log(np.maximum(alpha[length], 1e-300)) - length * np.log(SCALE)


def expected(lattice: Lattice, raw: np.ndarray, lang: np.ndarray, n: np.ndarray, p: np.ndarray,
             out: np.ndarray) -> None:
    """Add the expected piece counts of words (with language and count) to ``out``."""
    length = raw.shape[1]
    arcs = [(s, e, ids, p[ids, lang] * SCALE ** (e - s)) for s, e, ids in lattice.arcs(raw)]
    alpha = np.zeros((length + 1, len(raw)))
    beta = np.zeros((length + 1, len(raw)))
    alpha[0], beta[length] = 1.0, 1.0
    for s, e, _, w in sorted(arcs, key=lambda a: a[1]):
        alpha[e] += alpha[s] * w
    for s, e, _, w in sorted(arcs, key=lambda a: -a[0]):
        beta[s] += beta[e] * w
    total = np.maximum(alpha[length], 1e-300)
    for s, e, ids, w in arcs:
        np.add.at(out, (ids, lang), alpha[s] * w * beta[e] / total * n)


def _by_length(raw: list[bytes]):
    size = np.array([len(x) for x in raw])
    for s in np.unique(size):
        at = np.flatnonzero(size == s)
        for k in range(0, len(at), 8192):
            part = at[k:k + 8192]
            yield part, np.frombuffer(b"".join(raw[i] for i in part), dtype=np.uint8).reshape(-1, s)


def _units(low: bytes, s: int, e: int) -> list[bytes]:
    w = b" " + low[s:e]
    return [w[i:i + LONGEST] for i in range(0, len(w), LONGEST)]


def _word_counts(langs: dict[str, int]):
    def run(batches):
        for batch in batches:
            lang = [langs[x] for x in batch.column(1).to_pylist()]
            for lo, hi, buf, off in text_blocks(batch.column(0)):
                h, s, e, first = words(buf, off, LETTERS)
                of = np.repeat(np.array(lang[lo:hi], dtype=np.uint64), np.diff(first))
                _, at, n = np.unique(mix(h + of), return_index=True, return_counts=True)
                low = buf.tobytes().lower()
                ls, ws, ns = [], [], []
                for i, c in zip(at.tolist(), n.tolist()):
                    for u in _units(low, int(s[i]), int(e[i])):
                        ls.append(int(of[i]))
                        ws.append(u)
                        ns.append(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ls, pa.int32()), pa.array(ws, pa.binary()), pa.array(ns, pa.int64())],
                    names=["g", "w", "n"])
    return run


def _expect(shared):
    def run(batches):
        pieces, p = shared.value
        lattice = Lattice(pieces)
        out = np.zeros_like(p)
        for batch in batches:
            g = batch.column(0).to_numpy().astype(np.int64)
            n = batch.column(2).to_numpy().astype(float)
            for at, raw in _by_length(batch.column(1).to_pylist()):
                expected(lattice, raw, g[at], n[at], p, out)
        i, g = np.nonzero(out[:-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(i), pa.array(g.astype(np.int32)), pa.array(out[i, g])], names=["i", "g", "c"])
    return run


def train(docs: DataFrame, max_docs: int = 5_000, rounds: int = 3, vocabulary: str = VOCABULARY_FILE) -> dict:
    """Fit on documents with a non-null lang and crc32(doc_id) mod 4 != 2.

    At most ``max_docs`` of every language are used, those with the smallest hash of
    their id, so a rare language is learned at every size of the corpus; the prior
    counts all of them. The fitted table has pieces x languages entries and is broadcast."""
    spark = docs.sparkSession
    pieces = load_pieces(vocabulary)
    lattice_rows = len(pieces) + 1
    every = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
             .where("doc_id IS NOT NULL AND lang IS NOT NULL")
             .where(F.pmod(id_hash(F.col("doc_id")), F.lit(4)) != 2))
    share = {r["lang"]: r["count"] for r in every.groupBy("lang").count().collect()}
    langs = sorted(share)
    if not langs:
        return {"pieces": pieces, "langs": [], "p": np.zeros((lattice_rows, 0)), "prior": np.zeros(0)}
    # a part of the hash range that holds more than max_docs of a language, then the exact cut
    place, wanted = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)), F.lit(False)
    for g in langs:
        part = min(1.0, (1.5 * max_docs + 500) / share[g])
        wanted = wanted | ((F.col("lang") == g) & (place < int((1 << 31) * part)))
    first = Window.partitionBy("lang").orderBy("place", "doc_id")
    ids = (every.where(wanted).distinct().withColumn("place", place).withColumn("k", F.row_number().over(first))
           .where(F.col("k") <= max_docs).select("doc_id", "lang"))
    ids = store(ids, "op3-sample")      # at most max_docs of each language: small enough to broadcast
    src = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"))
           .join(F.broadcast(ids), ["doc_id", "lang"]).where("text IS NOT NULL").select("text", "lang"))
    counts = store(src.mapInArrow(_word_counts({g: i for i, g in enumerate(langs)}), "g int, w binary, n long")
                   .groupBy("g", "w").agg(F.sum("n").alias("n")), "op3-words")
    p = np.zeros((lattice_rows, len(langs)))
    p[:-1] = 1.0 / len(pieces)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, p))
        got = (counts.mapInArrow(_expect(shared), "i long, g int, c double").groupBy("i", "g")
               .agg(F.sort_array(F.collect_list("c")).alias("c"))
               .select("i", "g", F.aggregate("c", F.lit(0.0), lambda a, x: a + x).alias("c")).toArrow())
        c = np.full_like(p, SMOOTH)
        c[got.column("i").to_numpy(), got.column("g").to_numpy()] += got.column("c").to_numpy()
        c[-1] = 0.0
        p = c / c.sum(axis=0)
        shared.destroy()
    drop_stored(ids, counts)
    prior = np.log(np.array([share[g] for g in langs], dtype=float) / sum(share.values()))
    return {"pieces": pieces, "langs": langs, "p": p, "prior": prior}


def _predict(shared):
    def run(batches):
        m = shared.value
        lattice, p, langs = Lattice(m["pieces"]), m["p"], m["langs"]
        known: dict[int, int] = {}
        table = np.zeros((0, len(langs)))
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, off in text_blocks(batch.column(1)):
                h, s, e, first = words(buf, off, LETTERS)
                u, at, back = np.unique(h, return_index=True, return_inverse=True)
                if len(known) > 400_000:
                    known, table = {}, table[:0]
                new = [i for i, x in enumerate(u.tolist()) if x not in known]
                if new and len(langs):
                    low = buf.tobytes().lower()
                    units, owner = [], []
                    for k, i in enumerate(new):
                        for w in _units(low, int(s[at[i]]), int(e[at[i]])):
                            units.append(w)
                            owner.append(k)
                    owner = np.array(owner)
                    score = np.zeros((len(new), len(langs)))
                    for part, raw in _by_length(units):
                        np.add.at(score, owner[part], forward(lattice, raw, p))
                    for k, i in enumerate(new):
                        known[int(u[i])] = len(table) + k
                    table = np.concatenate((table, score))
                label = [UNKNOWN] * (hi - lo)
                best = np.zeros(hi - lo)
                if len(langs):
                    rows = np.array([known[x] for x in u.tolist()], dtype=np.int64)[back]
                    run_ = np.zeros((len(h) + 1, len(langs)))
                    np.cumsum(table[rows], axis=0, out=run_[1:])
                    total = run_[first[1:]] - run_[first[:-1]] + m["prior"]
                    post = np.exp(total - total.max(axis=1, keepdims=True))
                    post /= post.sum(axis=1, keepdims=True)
                    pick = post.argmax(axis=1)
                    for d in np.flatnonzero(np.diff(first)).tolist():
                        text = buf[off[d]:off[d + 1]]
                        plain = text | 0x20
                        if not ((plain >= 0x61) & (plain <= 0x7A)).any() and not any(
                                c.isalpha() for c in text.tobytes().decode("utf-8", "replace")):
                            continue
                        label[d], best[d] = langs[pick[d]], post[d, pick[d]]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(label, pa.string()), pa.array(best)],
                    names=["doc_id", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, **fit) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``.

    ``score`` is the posterior of the predicted language. A null text or one without
    letters is ``und`` with score 0; so is every row if there is nothing to learn
    from. Rows with a null id are never learned from and not held out. Repeated rows
    get equal answers. Other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(train(docs, **fit))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = src.mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")
    held = F.coalesce(F.pmod(id_hash(F.col("doc_id")), F.lit(4)) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
