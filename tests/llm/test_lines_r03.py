"""Line de-duplication: candidate pairs, sketches and work (findings of round 3)."""

import random

import numpy as np
import pyarrow as pa
import pytest

from riskmart.llm import components, line_dedup
from riskmart.llm.components import connected_components
from tests.llm.test_text_operators import components as brute_components
from tests.llm.test_text_operators import frame, prose


def shingles(x, k=8):
    return {x[i:i + k] for i in range(max(1, len(x) - k + 1))}


def near_copies(seed, n, words=40):
    """``n`` lines that each have some words of one line changed, from a few to most."""
    rnd = random.Random(seed)
    base = prose(seed, words)
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(1 + i % 12):
            w[rnd.randrange(words)] = f"z{rnd.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("step", [1, 2, 3, 7, 1000])
def test_band_pairs(step):
    """Every pair of a short band, the pairs with one line of a long one, wherever batches end."""
    rnd = random.Random(step)
    bands = {b: rnd.sample(range(-500, 500), n) for b, n in ((-7, 1), (-3, 2), (0, 4), (1, 30), (5, 5), (9, 1), (12, 9))}
    rows = [(b, x) for b in sorted(bands) for x in rnd.sample(bands[b] * 2, 2 * len(bands[b]))]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i:i + step])], names=["band", "h"])
               for i in range(0, len(rows), step)]
    got = [r for out in line_dedup._band_pairs(4)(iter(batches)) for r in zip(*(c.to_pylist() for c in out.columns))]
    plain = {frozenset(r[:2]) for r in got if r[2] is None}
    want = {frozenset((x, y)) for v in bands.values() if len(v) <= 4 for x in v for y in v if x != y}
    assert plain == want and sum(r[2] is None for r in got) == len(want)
    for b in (1, 5, 12):
        mine = [r for r in got if r[2] == b]
        assert len({r[0] for r in mine}) == 1 and {mine[0][0], *(r[1] for r in mine)} == set(bands[b])
    assert {r[2] for r in got} == {None, 1, 5, 12}
    assert list(line_dedup._band_pairs(4)(iter([]))) == []


def test_sketches_and_verified_pairs():
    """Sketches differ in no more bits than the sets do in shingles; the verified pairs are
    those of the sets themselves, also of lines shorter than a shingle."""
    lines = near_copies(3, 60) + ["abc", "abd", "", "ab" * 40, "ab" * 300, "é" * 9 + "漢字" * 20]
    column = pa.array(lines, pa.large_string())
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[:len(lines) + 1]
    cp, at = line_dedup.characters(np.frombuffer(column.buffers()[2], dtype=np.uint8), off)
    windows, sketch = line_dedup.parity_sketches(cp, at, 8)
    sets = [shingles(x) for x in lines]
    pairs = [(i, j) for i in range(len(lines)) for j in range(i)]
    for i, j in pairs:
        differ = int(np.bitwise_count((sketch[i] ^ sketch[j]).view(np.uint64)).sum())
        assert differ <= len(sets[i] ^ sets[j]) and windows[i] >= len(sets[i])
    batch = pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs]),
                                        pa.array([lines[p[0]] for p in pairs]), pa.array([lines[p[1]] for p in pairs])],
                                       names=["a", "b", "ta", "tb"])
    got = {(a, b) for out in line_dedup._verify(8, 0.8)(iter([batch])) for a, b in zip(*(c.to_pylist() for c in out.columns))}
    want = {(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert got == want and 10 < len(want) < len(pairs) - 10


def test_same_components_however_pairs_are_found(spark, monkeypatch):
    """Short bands, hubs, sketches of one band and the prefix filter give the same lines."""
    rows = [(i, "\n".join(x)) for i, x in enumerate(zip(near_copies(11, 70), near_copies(12, 70)))]
    got = []
    for paired, band in ((32, 4096), (1000, 4096), (2, 4096), (2, 1)):
        monkeypatch.setattr(line_dedup, "PAIRED", paired)
        monkeypatch.setattr(line_dedup, "BAND", band)
        got.append(sorted(map(tuple, line_dedup.line_components(frame(spark, rows)).collect())))
    assert got[0] == got[1] == got[2] == got[3] and len(got[0]) == 140
    assert 2 < sum(r[4] for r in got[0]) < 140


def test_lines_apart_in_bands_are_not_sent_through_the_prefix_filter(spark, monkeypatch):
    """Its work grew with all lines that share a band by chance."""
    def none(*a):
        raise AssertionError("prefix filter")
    monkeypatch.setattr(line_dedup, "open_pairs", none)
    rows = [(i, x) for i, x in enumerate(near_copies(21, 60))]
    assert line_dedup.line_components(frame(spark, rows)).count() == 60


def test_texts_that_share_an_id(spark):
    """Each of them gives its own lines' texts."""
    a, b, c = (" ".join(prose(s, 40)) for s in (31, 32, 33))
    rows = [(1, a), (1, b), (2, f"{c}\n{a[:-1]}x"), (3, f"{b[:-1]}y"), (3, f"{b[:-1]}y")]
    got = {(r["doc_id"], r["line_no"], r["keep_doc_id"], r["keep_line_no"])
           for r in line_dedup.line_components(frame(spark, rows)).collect()}
    assert got == {(1, 0, 1, 0), (2, 0, 2, 0), (2, 1, 1, 0), (3, 0, 1, 0)}


def test_components_stop_at_stars(spark, monkeypatch):
    """Links that are stars already take no round; a chain gives its smallest node."""
    names = []
    store = components.store
    monkeypatch.setattr(components, "store", lambda df, name: names.append(name) or store(df, name))
    stars = [(1, 5), (1, 6), (9, 2), (7, 2), (None, 4), (3, 3)]
    got = {tuple(r) for r in connected_components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {(5, 1), (6, 1), (9, 2), (7, 2)} and names == ["cc-edges"]
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == brute_links(chain)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_links(links):
    nodes = sorted({x for p in links for x in p})
    found = brute_components(nodes, links)
    return {x: found[x] for x in nodes if found[x] != x}
