"""Operators on texts against brute force, with nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskmart.llm import decontaminate, langid, licences, line_dedup, mixing, ngram_join, pii, prefix_filter, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re", "sta", "vo", "zi") for b in ("n", "r", "s", "ta", "lo", "de")]
EXTRA = "doc_id long, text string, lang string, source string, sigs int, h string, n int, component string"


def prose(seed: int, n: int) -> list[str]:
    x, out = seed * 7919 + 1, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + WORDS[(x >> 16) % len(WORDS)])
    return out


def frame(spark, rows, columns="doc_id long, text string, lang string, source string"):
    """Rows (id, text[, lang, source]) with columns whose names the operators use inside."""
    full = [(*r, *["en", "s"][len(r) - 2:]) for r in rows]
    full = [(*r, 1, "x", 2, "y") for r in full]
    return spark.createDataFrame(full, EXTRA)


def documents():
    base = prose(1, 200)
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(base[:100] + ["other"] + base[101:])),
            (4, " ".join(base[:-1] + ["Zi"])), (5, " ".join(prose(2, 300))), (6, None), (7, ""), (8, " \n\t "),
            (9, "one"), (10, "One"), (11, "one two"), (12, "ONE two"), (13, "one two three"), (None, " ".join(base)),
            (14, "w" * 200_000 + " " + " ".join(prose(3, 60))), (15, " ".join(prose(4, 30_000))),
            (2, " ".join(base))]
    for k in range(40):       # a chain of near copies, and texts that share a passage
        rows.append((100 + k, " ".join(prose(9, 150)[:k] + ["x%d" % k] + prose(9, 150)[k + 1:])))
        rows.append((200 + k, " ".join(prose(50, 60) + prose(60 + k, 90))))
    return rows


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(ids, linked):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    return root


def test_cells_never_reject_a_qualifying_pair():
    rnd = np.random.default_rng(4)
    refused = 0
    for percent in (80, 90):
        bands = ngram_join.Bands(percent)
        for n in (1, 2, 9, 40, 300, 1500):
            for _ in range(60):
                base = np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
                gone = rnd.integers(0, max(1, n // 3) + 1)
                other = np.unique(np.concatenate((base[gone:], rnd.integers(0, 2**64, rnd.integers(0, n // 3 + 1), dtype=np.uint64))))
                if not len(other):
                    continue
                both = len(np.intersect1d(base, other))
                far = ngram_join.cell_distance(bands.cells(base), bands.cells(other))
                size = len(base) + len(other)
                passes = (100 + percent) * far <= (100 - percent) * size
                assert passes or 100 * both < percent * (size - both)
                refused += not passes
    assert refused > 300


def test_parity_sketch_bounds_the_difference(spark):
    rnd = np.random.default_rng(5)
    sets = {i: set(rnd.integers(-2**63, 2**63 - 1, 30 + i).tolist()) for i in range(8)}
    sets[8] = set(list(sets[0])[3:]) | {5, -7}
    df = spark.createDataFrame([(i, e) for i, s in sets.items() for e in s], "node int, e long")
    bits = {r["node"]: [r[w] & (2**64 - 1) for w in prefix_filter.WORDS]
            for r in df.groupBy("node").agg(*prefix_filter.parity_bits(F.col("e"))).collect()}
    for a in sets:
        for b in sets:
            differ = sum(bin(x ^ y).count("1") for x, y in zip(bits[a], bits[b]))
            assert differ <= len(sets[a] ^ sets[b])
    assert sum(bin(x ^ y).count("1") for x, y in zip(bits[1], bits[2])) > 30


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_ngram_components(spark, k, percent):
    rows = documents()
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    ids = sorted(sets)
    pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(ids, pairs)
    got = ngram_join.ngram_components(frame(spark, rows), k, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]]), r
    assert ngram_join.ngram_components(frame(spark, [])).count() == 0


def test_bands_share_a_signature():
    """Every pair of sets at the threshold shares a signature, at all sizes."""


    import numpy as np
    rnd = random.Random(3)
    for percent in (80, 90):
        bands = ngram_join.Bands(percent)
        for n in [*range(1, 60), 100, 143, 144, 145, 300, 301, 999, 4000]:
            x = [rnd.getrandbits(64) for _ in range(n)]
            for swap in range(n + 1):
                if 100 * (n - swap) < percent * (n + swap):
                    break
            swap = max(0, swap - 1)          # as many exchanged elements as may be
            y = x[swap:] + [rnd.getrandbits(64) for _ in range(swap)]
            drop = x[:max(1, -(-percent * n // 100))]
            s = [set(bands.signatures(np.unique(np.array(v, dtype=np.uint64))).tolist()) for v in (x, y, drop)]
            assert s[0] & s[1] and s[0] & s[2], (percent, n, swap)


def test_bands_do_not_depend_on_earlier_sets():
    """Sets on both sides of a band's end share a signature also if every set is the
    first and largest its task has met."""


    import numpy as np
    rnd = random.Random(4)
    for percent in (80, 90):
        known = ngram_join.Bands(percent)
        known.of(20_000).__next__()
        for _, hi, *_ in [b for b in known.bands if 1 < b[1] < 3000]:
            x = [rnd.getrandbits(64) for _ in range(hi + 2)]
            for n in {hi, max(1, -(-percent * (hi + 2) // 100))}:
                s = [ngram_join.Bands(percent).signatures(np.unique(np.array(x[:m], dtype=np.uint64)))
                     for m in (n, hi + 2)]
                if 100 * n >= percent * (hi + 2):
                    assert np.intersect1d(*s).size, (percent, n, hi)
                after = known.signatures(np.unique(np.array(x[:n], dtype=np.uint64)))
                assert sorted(s[0]) == sorted(after), (percent, n)


def test_decontamination(spark):
    bench = [(1, " ".join(prose(70, 40))), (2, "Few words, here"), (3, " ".join(prose(71, 12))), (4, None), (5, "..."),
             (6, " ".join(prose(70, 40))), (None, " ".join(prose(72, 11))), (7, "lolo " * 30)]
    long = prose(73, 25_000)
    docs = [(1, " ".join(prose(80, 50) + prose(70, 40)[5:25] + prose(81, 50))), (2, "FEW words here! and few words-here"),
            (3, " ".join(prose(82, 80))), (4, None), (5, ""), (6, " ".join(prose(71, 12)[:9])),
            (7, "; ".join(prose(71, 12)).upper()), (None, " ".join(prose(72, 11))), (8, " ".join(long + prose(70, 40))),
            (9, " ".join(["lolo"] * 25)), (1, " ".join(prose(80, 50) + prose(70, 40)[5:25] + prose(81, 50))),
            (3, " ".join(prose(70, 10)))]
    split = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def words(t):
        return split.findall((t or "").translate(LOWER))

    windows = defaultdict(set)
    for i, t in bench:
        w = words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1) if w else ():
            windows[tuple(w[s:s + n])].add("null" if i is None else str(i))
    want = []
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    hit.update(range(s, s + n))
                    items |= windows[tuple(w[s:s + n])]
        want.append((str(i), len(w), len(hit), len(items),
                     hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    items = spark.createDataFrame([(*b, "x") for b in bench], "item_id long, text string, term string")
    got = decontaminate.contamination(frame(spark, docs), items).collect()
    assert sorted(want) == sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"],
                                   r["contaminated"]) for r in got)
    none = items.where("false")
    assert decontaminate.contamination(frame(spark, docs), none).where("contaminated").count() == 0
    assert decontaminate.contamination(frame(spark, []), items).count() == 0


def test_decontamination_with_a_shorter_window(spark):
    """Runs of at least the window asked for are indexed, not only those of the default."""
    docs = frame(spark, [(1, " ".join(prose(90, 20) + prose(91, 30)[4:10] + prose(92, 20))), (2, " ".join(prose(93, 40)))])
    items = spark.createDataFrame([(1, " ".join(["qz"] + prose(91, 30)))], "item_id long, text string")
    got = {r["doc_id"]: r["n_hit"] for r in decontaminate.contamination(docs, items, window=5).collect()}
    assert got[1] >= 6 and got[2] == 0


def test_proximity(spark):
    docs = frame(spark, [(1, "alpha x beta"), (2, "beta y y y alpha"), (3, "alpha"), (4, "beta alpha alpha")])
    items = decontaminate.test_items(spark.createDataFrame([(1, "alpha beta")], "item_id long, text string"))
    index = decontaminate.build_index(docs, items, run=1)
    ids = {r["h"]: r["doc_id"] for r in index.collect()}
    near = {ids[r["h"]] for r in decontaminate.proximity_matches(index, items, 2).collect()}
    assert near == {1, 4}


def test_line_components(spark):
    a, b = " ".join(prose(20, 40)), " ".join(prose(21, 40))
    rows = [(1, f"{a}\n{b}\nshort line"), (2, f"  {a.upper()} \nshort line\n{b[:-1]}x"), (3, None), (4, ""), (5, "\n\n"),
            (6, "\n".join(" ".join(prose(900 + i, 20)) for i in range(200))), (None, a), (7, f"{a}\n{a}"), (8, a), (8, a),
            (9, f"{a}é {b}\r\n{b}")]
    lines = {}
    for i, t in rows:
        for n, x in enumerate((t or "").split("\n")) if i is not None else ():
            if len(re.findall(r"[^\x20\x09-\x0D]+", x)) >= 5:
                x = x.strip(" \t\n\v\f\r").translate(LOWER)
                lines[i, n] = frozenset(x[j:j + 8] for j in range(max(1, len(x) - 7)))
    keys = sorted(lines)
    linked = [(p, q) for p in keys for q in keys if p < q
              and len(lines[p] & lines[q]) >= 0.8 * len(lines[p] | lines[q])]
    want = components(keys, linked)
    docs = frame(spark, rows)
    members = line_dedup.line_components(docs)
    got = {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["keep_line_no"], r["kept"]) for r in members.collect()}
    assert got == {p: (*want[p], want[p] == p) for p in keys}
    left = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(docs, members).collect()}
    assert left[1] == f"{a}\n{b}\nshort line" and left[2] == "short line" and 7 not in left and 8 not in left
    assert left[3] is None and left[4] == "" and left[5] == "\n\n" and left[None] == a
    assert line_dedup.line_components(frame(spark, [])).count() == 0


def test_lines_without_blanks_and_short_lines(spark):
    """A line in a script without blanks takes part; short lines as exact copies that
    many documents hold."""
    han = "".join(chr(0x4E00 + (i * i * 37 + i * 11) % 5000) for i in range(300))
    rows = [(1, f"{han}\nMenu"), (2, f"{han}\nabc"), (3, han[:150] + "x" + han[151:]), (4, "u" * 24), (5, "u" * 24)]
    rows += [(100 + i, f"Share this page\n{' '.join(prose(500 + i, 20))}\nshare THIS page" + "\nRare" * (i < 9))
             for i in range(10)]
    got = {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["keep_line_no"])
           for r in line_dedup.line_components(frame(spark, rows)).collect()}
    want = {(1, 0): (1, 0), (2, 0): (1, 0), (3, 0): (1, 0)}
    for i in range(100, 110):
        want |= {(i, 0): (100, 0), (i, 1): (i, 1), (i, 2): (100, 0)}
    assert got == want


def test_mixing(spark):
    import duckdb
    rows = [(i, " ".join(prose(i, 5 + i * 37 % 211)), "en", f"s{i % 7}") for i in range(300)]
    rows += [(1000 + i, " ".join(prose(i, 40)), "en", "big") for i in range(200)]
    rows += [(2000, None, "en", "s1"), (2001, "", "en", None), (2002, "a b c", "en", None), (2003, "x", None, "Ä"),
             (2004, "w " * 5000, "en", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string") \
        .selectExpr("*", "1 AS size", "'q' AS bin")
    got = mixing.mix_sources(docs).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    want = {r[0]: r[1:6] for r in con.execute(mixing.oracle()).fetchall()}
    assert {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["copies"], r["taken"]) for r in got} == want
    by = defaultdict(lambda: [0, 0.0, 0, 0])
    for r in got:
        t = by[r["source"]]
        t[0] += r["taken"]
        t[1], t[2], t[3] = r["target"], r["source_size"], max(t[3], r["size"])
        assert r["taken"] <= 3 * r["size"]
    for taken, target, size, largest in by.values():
        assert target <= 3 * size and abs(taken - target) <= max(largest / 2, 1), by
    # repeated rows, a null id
    again = docs.union(docs.where("doc_id < 5")).union(docs.where("doc_id = 9").selectExpr(
        "CAST(NULL AS BIGINT) AS doc_id", *docs.columns[1:]))
    a, b = (sorted(map(str, mixing.mix_sources(d).collect())) for d in (again, again.repartition(5)))
    assert a == b and len(a) == docs.count() + 6
    assert mixing.mix_sources(docs.where("false")).count() == 0


def test_mixing_inclusion(spark, monkeypatch):
    """Over independent draws a document's share is its inclusion probability
    min(1, c * size); draws are sources that hold the same sizes under other ids."""
    sizes, draws = [20, 40, 60, 90, 140, 200, 350, 600] * 40 + [6000], 45
    rows = [(d * 1000 + i, "w " * n, "en", f"s{d:04d}") for d in range(draws) for i, n in enumerate(sizes)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    taken, seen = defaultdict(int), defaultdict(int)
    for r in got.select("doc_id", "size", "copies", "source_size", "target").collect():
        whole = int(r["target"] // r["source_size"])
        need = round(r["target"] - whole * r["source_size"])
        seen[need, r["size"]] += 1
        taken[need, r["size"]] += r["copies"] - whole
    assert len({n for n, _ in seen}) == 3
    for need in {n for n, _ in seen}:
        rest, sure = need, set()
        while True:                              # the definition of c, size by size
            c = rest / sum(n * n for n in sizes if n not in sure)
            more = {n for n in sizes if n not in sure and c * n >= 1}
            if not more:
                break
            sure |= more
            rest = need - sum(n for n in sizes if n in sure)
        for n in set(sizes):
            m, p = seen[need, n], 1.0 if n in sure else c * n
            share, err = taken[need, n] / m, 4 * (p * (1 - p) / m) ** 0.5
            # a draw ends within the size of a document and is filled up with a few small ones
            assert abs(share - p) <= err + 0.05, (need, n, share, p)
    # repeats are listed in runs
    monkeypatch.setattr(mixing, "REPEATS", 4)
    same = spark.createDataFrame([(1, "a b", "en", "s")] * 11 + [(2, "a", "en", "t")] * 4,
                                 "doc_id long, text string, lang string, source string")
    out = mixing.mix_sources(same).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in out} == {1: 11, 2: 4}


def test_toxicity(spark):
    bad = ["rotten", "filthy"]
    rows, labels = [], []
    for i in range(900):
        w = prose(i, 40)
        if i % 5 == 0:
            w[i % 30] = bad[i % 2]
            w[i % 7] = bad[(i // 2) % 2]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(5000, None), (5001, ""), (5002, "x" * 100_000), (None, "rotten filthy"), (3, rows[3][1])]
    labels += [(0, 1, 1), (1, None, None), (None, 1, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(frame(spark, rows), lab).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(900))
    held = [r for i, r in by.items() if i is not None and i < 900 and r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held) >= 0.9 * len(held)
    assert by[5000]["score"] == by[5001]["score"] and not by[None]["held_out"]
    none = toxicity.toxicity(frame(spark, rows[:3]), lab.where("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert toxicity.toxicity(frame(spark, []), lab).count() == 0


def test_toxicity_learns_rare_markers(spark):
    """Markers that only four labelled documents hold find held-out documents."""
    rows, labels, ids = [], [], iter(range(100_000))
    def take(held):
        return next(i for i in ids if (zlib.crc32(str(i).encode()) % 3 == 1) == held)
    for _ in range(600):
        i = take(False)
        rows.append((i, " ".join(prose(i, 30))))
        labels.append((i, 0))
    want = []
    for m in range(12):
        for held in (False,) * 4 + (True,) * 2:
            i = take(held)
            rows.append((i, " ".join(prose(i, 12) + [f"qq{m}x", f"zz{m}y", f"ww{m}v"] + prose(i + 1, 12))))
            labels.append((i, 1))
            want += [i] if held else []
    clean = [take(True) for _ in range(40)]
    rows += [(i, " ".join(prose(i, 30))) for i in clean]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(frame(spark, rows), lab).collect()}
    found, wrong = sum(got[i] >= 0.7 for i in want), sum(got[i] >= 0.7 for i in clean)
    print("found", found, "of", len(want), "wrong", wrong, "of", len(clean))
    assert found >= 0.9 * len(want) and not wrong


def test_language(spark):
    text = {"en": "the weather and the water were there with other things", "fr": "les oiseaux sont dans la maison avec nous",
            "de": "der hund und die katze sind nicht schön heute"}
    rows = []
    for i in range(240):
        g = sorted(text)[i % 3]
        w = text[g].split()
        rows.append((i, " ".join(w[i % 5:] + w[:i % 4]) or "x", g, "s"))
    rows += [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "12 34 — …", "en", "s"), (1003, "und die katze", None, "s"),
             (None, "les oiseaux", "fr", "s"), (1004, "THE WEATHER " * 5000, None, "s"), (1005, "q" * 3000, None, "s")]
    got = {r["doc_id"]: r for r in langid.identify(frame(spark, rows)).collect()}
    assert all(r["lang_pred"] == sorted(text)[i % 3] for i, r in got.items() if i is not None and i < 240)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(240))
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] == "de" and got[None]["lang_pred"] == "fr" and got[1004]["lang_pred"] == "en"
    alone = langid.identify(frame(spark, [(2, "hello", None, "s")])).collect()
    assert alone[0]["lang_pred"] == "und"
    assert langid.identify(frame(spark, [])).count() == 0


def test_language_learns_rare_languages(spark):
    """Every language has a sample of its own: six documents among many are enough."""
    text = {"en": "the weather and the water were there with other things that people have when they go out",
            "fr": "les oiseaux sont dans la maison avec nous pour la fin de cette semaine et nous sommes contents",
            "de": "der hund und die katze sind nicht schön heute weil wir noch keine zeit für sie gefunden haben"}
    rows = []
    for i in range(3000):
        w = text["en" if i % 2 else "fr"].split()
        rows.append((i, " ".join(w[i % 9:] + w[:i % 7]), "en" if i % 2 else "fr", "s"))
    w = text["de"].split()
    rows += [(5000 + i, " ".join(w[i:] + w[:i]), "de", "s") for i in range(6)]
    rows += [(6000, "wir haben keine katze gefunden", None, "s"), (6001, "les oiseaux sont contents", None, "s")]
    rows += rows[:4]                                            # repeated rows are sampled once
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(frame(spark, rows), max_docs=100).collect()}
    assert all(got[5000 + i] == "de" for i in range(6)) and got[6000] == "de" and got[6001] == "fr"
    assert all(got[i] == ("en" if i % 2 else "fr") for i in range(3000))
    assert len(got) == 3008


def test_forward_sums_all_segmentations():
    import math

    import numpy as np
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"abc", b"bc"]
    pieces = sorted(set(pieces))
    lat = langid.Lattice(pieces)
    p = np.zeros((len(pieces) + 1, 1))
    p[:-1, 0] = np.linspace(1, 2, len(pieces)) / np.linspace(1, 2, len(pieces)).sum()
    at = {x: p[i, 0] for i, x in enumerate(pieces)}

    def total(w):
        return 1.0 if not w else sum(at[w[:k]] * total(w[k:]) for k in range(1, 4) if w[:k] in at and len(w) >= k)

    for w in (b" abc", b" aabcbc", b" z"):
        got = langid.forward(lat, np.frombuffer(w, np.uint8).reshape(1, -1), p)[0, 0]
        assert got == pytest.approx(math.log(total(w)), rel=1e-9)


PII_BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def pii_ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum((int(c) * (1 + i % 2)) - 9 * (int(c) * (1 + i % 2) > 9)
                                          for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def test_pii(spark):
    texts = ["mail a.b@x.org, a@b.c%x@d.e and x@y.", "né 1.2.3.4 ip 1.2.3.4.5.6.7.8 or 256.1.1.1 or 000.01.002.255", None, "",
             "card 4111 1111 1111 1111 or 4111111111111112, 41111111111111111111111", "tel +1 (714) 555-9345. +12 3 +49-89-123456-",
             "1 2 3 4 5 6 7 8 9 0 1 2 3", "é" * 50 + " a@b.co " + "漢字" * 9 + "+33 1 23 45 67 89", "9" * 50_000, "a" * 50_000 + "@b.c",
             "1-" * 20_000, "+1" * 5000, "4111-1111-1111-1111 4012888888881881x", "a@b.c" * 300, "x@-.-.a\n+1\n234567890"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a@b.org"), (0, texts[0])]
    rows += [(100 + i, f"call +1 (212) 555-{1000 + i} or (212) 555-{2000 + i} id {i}") for i in range(120)]
    found = pii.find_spans(frame(spark, rows))
    got = pii.report(found).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in rows:
        spans, counts = [], []
        for kind, p in PII_BASE:
            m = [(x.start(), x.end()) for x in re.finditer(p, t or "") if pii_ok(kind, x.group())]
            counts.append(len(m))
            spans += [f"{kind}:{a}:{b}" for a, b in m]
        r = by[i]
        assert [r[f"n_{k}"] for k, _ in PII_BASE] == counts, (i, t[:80])
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r["spans"].split(",")) | {""}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, rows[:2]), found.where("doc_id = 1")).collect()}
    assert clean[1].startswith("né [ip] ip [ip][ip]") is False and clean[1].startswith("né [ip] ip [ip]")
    assert pii.report(pii.find_spans(frame(spark, []))).count() == 0


def test_pii_adds_rewritten_spans(spark):
    """Rewritten addresses and numbers are no negatives of the fit: planted ones are added."""
    rows = [(i, f"mail p{i}@host{i}.org or x@y{i} for order {7_000_000 + i * 37} tel +1 (212) 555-{1000 + i} "
                f"and 4111 1111 1111 {1000 + i} server 10.0.{i % 250}.7 build 1.2.{300 + i}.4") for i in range(400)]
    planted = {"email": "jane.roe [at] site7 [dot] org", "phone": "(212) 555-4321", "ip": "10,0,19,7"}
    cues = {"email": "mail ", "phone": "tel ", "ip": "server "}
    rows += [(1000 + i, f"so {cues[k]}{planted[k]} and order 7654321") for i, k in enumerate(pii.KINDS) if k in planted]
    got = {r["doc_id"]: r["spans"] for r in pii.report(pii.find_spans(frame(spark, rows))).collect()}
    for i, k in enumerate(pii.KINDS):
        if k in planted:
            s = 3 + len(cues[k])
            assert got[1000 + i] == f"{k}:{s}:{s + len(planted[k])}", (k, got[1000 + i])
    assert all(x.count(":") == 2 * len(x.split(",")) for x in got.values()) and "phone:" in got[0]


def test_licences(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    noise = "\n".join(" ".join(prose(i, 30)) for i in range(20))
    rows = [("a/LICENSE", mit), ("a/x.c", noise), ("a/b/y.c", noise + "\n" + gpl), ("a/b/c/z.c", None), ("a/b/COPYING", gpl),
            ("d/w.c", ""), ("d/LICENSE", noise), (None, mit), (None, noise), ("top", noise), ("LICENSE", mit + "\n" + gpl)]
    files = spark.createDataFrame([(i, *r, "z") for i, r in enumerate(rows)], "id int, path string, text string, dir string")
    own = licences.own_licences(files, ["id", "path"])
    from pyspark.sql import functions as F
    out = {r["id"]: (r["own_licence"], r["licence"]) for r in
           licences.inherit(own, F.col("path").rlike(r"(^|/)(LICENSE|COPYING)$")).collect()}
    g, m = "GPL-3.0-only", "MIT"       # a bare version is that version only
    assert out == {0: (m, m), 1: (None, m), 2: (g, g), 3: (None, g), 4: (g, g), 5: (None, m), 6: (None, m),
                   7: (m, m), 8: (None, None), 9: (None, m), 10: (m, m)}
    docs = frame(spark, [(1000, mit, "en", "s"), (1001, noise, "en", "s"), (None, None, None, None), (2001, noise, "en", "s")])
    got = {r["doc_id"]: r["licence"] for r in licences.scan_documents(docs).collect()}
    assert got == {1000: m, 1001: m, None: None, 2001: None}
    assert licences.scan_documents(frame(spark, [])).count() == 0


def _wrapped(text, width, prefix):
    import textwrap
    return "\n".join(prefix + line for line in textwrap.wrap(text, width))


LICENCE_PROBES = [
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-3.0", "Licensed under CC BY 3.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("EPL-2.0", "Licensed under the Eclipse Public License, version 2.0."),
    ("Apache-2.0 OR MIT", "// SPDX-License-Identifier: Apache-2.0 OR MIT"),
    ("GPL-2.0-only WITH Classpath-exception-2.0", "# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */"),
    ("AGPL-3.0-or-later", "Licensed under the GNU Affero General Public License, version 3 or any later version."),
    (None, "Licensed under CC BY-NC 2.0."), (None, "Licensed under the Apache License."), (None, "MIT students licensed a boat"),
]


def test_licence_versions_variants_and_wrapped_headers(spark):
    noise = "\n".join(" ".join(prose(i, 12)) for i in range(40))
    texts = [(want, f"{noise}\n{text}\n{noise}") for want, text in LICENCE_PROBES]
    # every template, wrapped as a comment in front of a file and in the middle of one
    for t in licences.TEMPLATES:
        texts.append((t.licence, _wrapped(t.text, 72, "# ") + "\n\n" + noise))
        texts.append((t.licence, noise + "\n\n" + _wrapped(t.text, 80, " * ") + "\n" + noise))
    texts += [(None, ""), (None, None), (None, "\n\n"), (None, "license " * 3000), ("MIT", "x\n" * 30000 + "Released under the MIT License.\r\n")]
    files = spark.createDataFrame([(i, t, "k") for i, (_, t) in enumerate(texts)], "id int, text string, __own string").drop("__own")
    rows = {r["id"]: r for r in licences.own_licences(files.repartition(3), ["id"]).collect()}
    wrong = [(w, rows[i]["own_licence"], (t or "")[-90:]) for i, (w, t) in enumerate(texts) if rows[i]["own_licence"] != w]
    assert not wrong
    assert rows[0]["own_line"] == 40 and rows[0]["own_lines"] == 1
    assert rows[len(texts) - 1]["own_line"] == 30000
    tag = rows[7]
    assert (tag["own_score"], tag["own_line"], tag["own_lines"]) == (1.0, 40, 1)


def _licence_brute_force(texts, templates, window):
    """Every window of every text, term by term."""
    import math
    import re
    from collections import Counter

    def terms(t):
        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    vocabulary = {w for t in templates for w in terms(t.text + " " + t.must)}
    df = Counter(w for t in texts for w in set(terms(t or "")) & vocabulary)
    n = len(texts)

    def idf(w):
        return math.log((n + 1) / ((df[w] if w in vocabulary else 1) + 1)) + 1
    out = []
    for text in texts:
        lines = (text or "").split("\n")
        best = [(0.0, 0, 0)] * len(templates)
        for i in range(len(lines)):
            for k in range(1, min(window, len(lines) - i) + 1):
                c = Counter(terms("\n".join(lines[i:i + k])))
                norm = math.sqrt(sum((f if w in vocabulary else math.sqrt(f)) ** 2 * idf(w) ** 2 for w, f in c.items()))
                for j, (t, (must, never)) in enumerate(zip(templates, licences.required_terms(templates))):
                    def held(g):
                        return any(w in c for w in g.split("|"))
                    if not all(map(held, must)) or any(map(held, never)):
                        continue
                    tc = Counter(terms(t.text))
                    dot = sum(c[w] * tc[w] * idf(w) ** 2 for w in tc)
                    cos = round(dot / norm / math.sqrt(sum((f * idf(w)) ** 2 for w, f in tc.items())), 9)
                    best[j] = max(best[j], (cos, -i, -k))
        t = licences.choose([b[0] for b in best], [-b[1] for b in best], [-b[2] for b in best],
                            licences.wider_templates(templates))
        out.append((templates[t].licence, best[t][0], -best[t][1], -best[t][2]) if t >= 0 else (None, 0.0, -1, 0))
    return out


def test_licences_against_brute_force(spark):
    rnd = random.Random(4)
    pieces = [t.text for t in licences.TEMPLATES] + [p for _, p in LICENCE_PROBES if "SPDX" not in p]
    texts = [None, ""]
    for i in range(60):
        lines = []
        for _ in range(rnd.randrange(1, 4)):
            words = rnd.choice(pieces).split()
            for _ in range(rnd.randrange(3)):             # words lost and added
                words[rnd.randrange(len(words))] = rnd.choice(["", "foo", "later", "3", "license"])
            lines += _wrapped(" ".join(words), rnd.choice([60, 80, 400]), rnd.choice(["", "# "])).split("\n")
            lines += [" ".join(prose(i, 6))] * rnd.randrange(3)
        texts.append("\n".join(lines[:30]))
    texts += texts[5:8]                                     # repeated rows
    files = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    for window in (1, 6):
        got = {r["id"]: r for r in licences.own_licences(files, ["id"], window=window).collect()}
        want = _licence_brute_force(texts, licences.TEMPLATES, window)
        for i, (name, score, line, height) in enumerate(want):
            r = got[i]
            assert (r["own_licence"], r["own_line"], r["own_lines"]) == (name, line, height), (i, texts[i])
            assert abs(r["own_score"] - min(score, 1.0)) < 1e-8
        assert sum(w[0] is not None for w in want) > 20
