"""Vector join, WARC round trip and union-find against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskmart.llm import vector_join, warc
from riskmart.llm.components import connected_components
from riskmart.session import scratch_path


@pytest.mark.parametrize("piece", [4096, 32])
def test_vector_components(spark, monkeypatch, piece):
    monkeypatch.setattr(vector_join, "PIECE", piece)
    rnd = np.random.default_rng(5)
    x = [rnd.normal(size=32) for _ in range(150)]
    hub = rnd.normal(size=32)
    x += [hub + rnd.normal(size=32) * s for s in np.linspace(0.01, 0.45, 150)]     # links near the limit too
    x += [x[0], x[0] * 3, -x[0], np.zeros(32), np.full(32, np.nan), x[1] * 1e-200, x[2] * 1e200]
    rows = [(i, [float(v) for v in a]) for i, a in enumerate(x)]
    rows += [(900, None), (901, [1.0, None]), (902, [math.inf] * 32), (903, []), (904, [1.0, 0.0]), (905, [2.0, 0.0]),
             (None, rows[0][1]), (5, rows[5][1])]
    ok = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v
          and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    unit = [(i, v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max())) for i, v in ok]
    n, links = {}, []
    for p, (i, u) in enumerate(unit):
        hits = [j for q, (j, v) in enumerate(unit) if q != p and len(u) == len(v) and u @ v >= 0.9]
        n[i] = len(hits)
        links += [(i, j) for j in hits]
    root = {i: i for i, _ in rows if i is not None}
    for _ in range(len(root)):
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "vec_id long, embedding array<double>, u string, n int")
    got = vector_join.vector_components(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, False)
        else:
            i = r["vec_id"]
            assert (r["n_links"], r["component_id"], r["kept"]) == (n.get(i, 0), root[i], root[i] == i), r
    assert vector_join.vector_components(df.where("false")).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(500)] + [(1000, 1000 + k) for k in range(1, 300)]
    edges += [(rnd.randint(2000, 2400), rnd.randint(2000, 2400)) for _ in range(300)] + [(7, 7), (None, 4), (3, 4), (3, 4)]
    df = spark.createDataFrame([(*e, 1) for e in edges], "a long, b long, node int").repartition(7)
    root = {x: x for e in edges for x in e if x is not None}
    while True:
        before = dict(root)
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {k: v for k, v in root.items() if k != v}
    assert connected_components(df.where("false")).count() == 0


PAGES = "page_id long, url string, html string, digest string, kind string"


def pages():
    inner = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    body = "<p>" + "text é 漢 " * 40
    rows = [(1, "http://a/1", body), (2, "http://a/2", body), (3, None, body), (4, "x\r\ny", "short"), (5, "u", "short"),
            (6, "u", None), (7, "u", ""), (8, "u", "pre WARC/1.0\r\n post" + "z" * 200), (9, "u", inner * 3),
            (10, "u", "WARC/1.0\r\n"), (11, "u", "WARC/1.0\r\nContent-Length: 99999999999999999999\r\n\r\nx"),
            (12, "u", "WARC/1.0\r\nContent-Length: 40\r\n\r\nx"), (13, "u", "\r\n\r\nWARC/1.0\r\n\r\n\r\n"),
            (None, "u", body), (14, "u", "y" * 300_000 + inner), (15, "u", inner * 3), (1, "http://a/1", body)]
    return rows + [(100 + i, "u", f"<p>{i}" + inner * (i % 3) + "page" * (i * 13 % 97)) for i in range(150)]


@pytest.mark.parametrize("split", ["128m", "4k"])
def test_warc_round_trip(spark, split):
    rows = pages()
    first = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in rows:
        h = (h or "").encode()
        ref = first.get(h)
        revisit = ref is not None and ref != i
        want.append(str((i, len(h), hashlib.sha256(h).hexdigest(), "revisit" if revisit else "response",
                         ref if revisit else None)))
    df = spark.createDataFrame([(*r, "d", "k") for r in rows], PAGES).repartition(3)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.round_trip(df).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(want) == sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"],
                                       r["refers_to"])) for r in got)


def test_warc_empty_and_bytes(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
    path = scratch_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([(1, "u", "abc", "", "")], PAGES).coalesce(1), path)
    raw = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).first()["content"].decode()
    assert raw.startswith("WARC/1.0\r\nWARC-Type: response\r\n") and raw.endswith("Content-Length: 3\r\n\r\nabc\r\n\r\n")


@pytest.mark.parametrize("split", ["128m", "1k"])
def test_warc_report_of_damaged_archives(spark, split, tmp_path):
    path = scratch_path(spark, "warc-whole")
    inner = "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, "u", f"<p>{i}" + "text" * 60 + inner * (i % 2), "", "") for i in range(20)]
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), path)
    raw = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).first()["content"]
    at = [raw.index(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>" % i) for i in range(20)]
    tenth = raw[at[10]:at[11]]
    n = int(tenth.split(b"\r\nContent-Length: ")[1].split(b"\r\n")[0])
    longer = tenth.replace(b"Content-Length: %d\r\n" % n, b"Content-Length: %d\r\n" % (n + 7), 1)
    headless = tenth.replace(b"\r\nWARC-Date: ", b"\r\nfolded line\r\nWARC-Date: ", 1)
    files = {"whole": raw, "length": raw[:at[10]] + longer + raw[at[11]:], "header": raw[:at[10]] + headless + raw[at[11]:],
             "cut": raw[:at[19] + 200], "empty": b""}
    for name, content in files.items():
        (tmp_path / f"{name}.warc").write_bytes(content)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = {r["file"].split("/")[-1][:-5]: r for r in warc.chain_report(spark, str(tmp_path)).collect()}
        read = warc.read_archives(spark, str(tmp_path)).groupBy("file").count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {k: len(v) for k, v in files.items() if v} == {k: r["bytes"] for k, r in got.items()}
    assert {k: (r["records"], r["last_off"], r["complete"]) for k, r in got.items()} == {
        "whole": (20, at[19], True), "length": (11, at[10], False), "header": (10, at[9], False),
        "cut": (19, at[18], False),    }
    assert got["header"]["next_off"] == at[10]
    assert {r["file"].split("/")[-1][:-5]: r["count"] for r in read if "cut" not in r["file"]} == {
        "whole": 20, "length": 11, "header": 10}
