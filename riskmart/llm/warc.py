"""Operator 8: WARC archives, written from pages and read back by boundary chains.

Archives are plain WARC/1.0 files (one per partition), written and read through
Spark's text source with the record end and the version line as separators, so they
can be split and lie in any file system. Every version line starts a candidate
record; payloads may contain it too. A task that reads a part of a file follows
each candidate's Content-Length to its successor and on to where its chain leaves
the part; pointer jumping over these exits from the start of every file finds the
entry of each part that is reachable, and only records on the chain from there are
taken. A payload that contains version lines is put together again from the pieces.

Payloads of at least ``MIN_SHARED`` bytes that occur several times are stored once,
by the smallest page id; the others are revisit records that refer to it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import prepare, store

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
MIN_SHARED = 100
DATE = "1970-01-01T00:00:00Z"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One record text per row. A null payload is empty. Line breaks in the URL are
    escaped; a null URL gives no target line, a null id the id 'null'."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"),
                       F.octet_length(html).alias("size"))
    shared = store(src.where(F.col("size") >= MIN_SHARED).groupBy("digest")
                   .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
                   .where("n > 1 AND first IS NOT NULL").select("digest", "first"), "op8-shared")
    row = src.join(shared, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    ident = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = F.concat_ws(
        "\r\n", F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), ident, F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.lit(DATE)),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        F.concat(F.lit("X-Payload-Length: "), F.col("size").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))))
    return row.select(F.concat(F.lit(MAGIC), lines, F.lit("\r\n\r\n"),
                               F.when(revisit, "").otherwise(F.col("html"))).alias("value"))


def write_archives(pages: DataFrame, path: str, **columns) -> None:
    records(pages, **columns).write.option("lineSep", END).text(path)


def _header(value: bytes) -> tuple[int, dict[str, str]] | None:
    """(length with the blank line, fields) of a candidate, or None."""
    n = value.find(b"\r\n\r\n")
    if n < 0:
        return None
    fields = {}
    for line in value[:n].split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if not colon:
            return None
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdecimal():
        return None
    return n + 4, fields


def _scan(batches):
    """Candidates of a part in order, each with the exit of its local chain; offsets
    are relative to the first byte after the part's first separator."""
    part, pos, seq, held = None, 0, 0, []

    def flush():
        at = {r["off"]: r for r in held}
        for r in reversed(held):
            nxt = at.get(r["succ"])
            r["leaves"] = nxt["leaves"] if nxt is not None and r["succ"] > r["off"] else r["succ"]
        return pa.RecordBatch.from_pylist(held, schema=SCHEMA)

    for batch in batches:
        values = batch.column(0).cast(pa.binary()).to_pylist()
        files, blocks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for value, file, block in zip(values, files, blocks):
            if (file, block) != part:
                if held:
                    yield flush()
                part, pos, seq, held = (file, block), 0, 0, []
            head = _header(value)
            r = {"file": file, "block": block, "seq": seq, "off": pos - len(MAGIC), "size": len(value)}
            if head is not None:
                n, f = head
                length = int(f["content-length"])
                r["succ"] = pos + n + length + len(END) if length < 1 << 62 else None
                r["head"], r["length"] = n, length if length < 1 << 62 else None
                r["whole"] = n + length + len(END) == len(value) and value[n + length:] == END.encode()
                r["sha"] = hashlib.sha256(value[n:n + length]).hexdigest() if r["whole"] else None
                r["kind"], r["ident"] = f.get("warc-type"), f.get("warc-record-id")
                r["refers"], r["digest"] = f.get("warc-refers-to"), f.get("warc-payload-digest")
                r["full"] = f.get("x-payload-length")
            else:
                r["succ"] = None
            held.append(r)
            pos += len(value) + len(MAGIC)
            seq += 1
    if held:
        yield flush()


SCHEMA = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("off", pa.int64()),
                    ("size", pa.int64()), ("succ", pa.int64()), ("leaves", pa.int64()), ("head", pa.int64()),
                    ("length", pa.int64()), ("whole", pa.bool_()), ("sha", pa.string()), ("kind", pa.string()),
                    ("ident", pa.string()), ("refers", pa.string()), ("digest", pa.string()), ("full", pa.string())])
DDL = ("file string, block long, seq long, off long, size long, succ long, leaves long, head long, length long, "
       "whole boolean, sha string, kind string, ident string, refers string, digest string, full string")


def _chain(group: pa.Table) -> pa.Table:
    """Candidates of one part on the chain from its entry."""
    at = dict(zip(group.column("off").to_pylist(), group.column("succ").to_pylist()))
    x, out = group.column("entry")[0].as_py(), []
    while x in at:
        out.append(x)
        x = at[x] if at[x] is not None and at[x] > x else None
    return pa.table({"file": [group.column("file")[0].as_py()] * len(out), "off": out},
                    schema=pa.schema([("file", pa.string()), ("off", pa.int64())]))


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _numbered(batches):
    part, seq = None, 0
    for batch in batches:
        n = []
        for p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            part, seq = (p, 0) if p != part else (p, seq + 1)
            n.append(seq)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())],
                                         names=["value", "file", "block", "seq"])


def _chains(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All candidates of the archives below ``path``, and (file, off) of those on the
    boundary chain of their file."""
    prepare(spark)
    scan = store(_rows(spark, path).mapInArrow(_scan, DDL), "op8-scan")
    total = scan.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = store(total.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base")),
                 "op8-base")
    cand = scan.join(base, ["file", "block"])
    for c in ("off", "succ", "leaves"):
        cand = cand.withColumn(c, F.col(c) + F.col("base"))
    cand = store(cand.where("off >= 0").drop("base"), "op8-candidates")
    # entries: candidates that some chain leads to, or that start a file
    exits = cand.select("file", F.col("leaves").alias("off")).where("off IS NOT NULL").distinct()
    entries = cand.select("file", "block", "off", F.col("leaves").alias("to"))
    entries = store(entries.join(exits, ["file", "off"], "left_semi").union(entries.where("off = 0")).distinct(),
                    "op8-entries")
    jump = entries.select("file", "off", "to").where("to > off")
    reach = entries.where("off = 0").select("file", "off")
    size = reach.count()
    while True:
        step = reach.join(jump, ["file", "off"]).select("file", F.col("to").alias("off"))
        wider = store(reach.union(step).distinct().join(entries.select("file", "off"), ["file", "off"], "left_semi"),
                      "op8-reach")
        n = wider.count()
        if n == size:
            break
        reach, size = wider, n
        far = jump.select("file", F.col("off").alias("to"), F.col("to").alias("far"))
        jump = store(jump.join(far, ["file", "to"]).select("file", "off", F.col("far").alias("to")), "op8-jump")
    start = (entries.join(reach, ["file", "off"], "left_semi").groupBy("file", "block")
             .agg(F.min("off").alias("entry")))
    chain = (cand.select("file", "block", "off", "succ").join(store(start, "op8-start"), ["file", "block"])
             .groupBy("file", "block").applyInArrow(_chain, "file string, off long"))
    return cand, store(chain, "op8-chain")


def chain_report(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, records, last_off, next_off, complete: one row per archive below
    ``path``, how far its boundary chain came.

    A record with a broken header or a wrong length ends the chain, and what lies behind
    it cannot be told from payload. ``last_off`` is the start of the last record on the
    chain (null without any), ``next_off`` where its successor should start; only a chain
    that ends with the file is complete. An empty file gives no row (file sources leave it out)."""
    cand, chain = _chains(spark, path)
    found = (cand.join(chain, ["file", "off"], "left_semi").where("length IS NOT NULL").groupBy("file")
             .agg(F.count(F.lit(1)).alias("records"), F.max_by(F.struct("off", "succ"), "off").alias("x")))
    # sizes come from the file listing, contents are not read
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"),
                                                              F.col("_metadata.file_size").alias("bytes"))
    end = F.coalesce(F.col("x.succ"), F.lit(0))
    return files.join(found, "file", "left").select(
        "file", "bytes", F.coalesce("records", F.lit(0)).alias("records"), F.col("x.off").alias("last_off"),
        end.alias("next_off"), (end == F.col("bytes")).alias("complete"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """file, off, kind, ident, refers, digest, full, length, sha: the records on the
    boundary chain of every archive below ``path``. ``length`` and ``sha`` are those of
    the payload as read. ``chain_report`` tells which archives were not read to the end."""
    cand, chain = _chains(spark, path)
    keep = ["file", "off", "kind", "ident", "refers", "digest", "full", "length", "sha"]
    found = cand.join(chain, ["file", "off"], "left_semi").where("length IS NOT NULL")
    whole = found.where("whole").select(*keep)
    torn = store(found.where("NOT whole").select(*keep, "head", "succ"), "op8-torn")
    if torn.isEmpty():
        return whole
    # payloads that hold version lines: fetch the rows they span and join them
    spans = torn.select("file", F.col("off").alias("start"), "succ")
    inside = store(cand.select("file", "block", "seq", F.col("off").alias("at")).join(spans, "file")
                   .where("at >= start AND at < succ"), "op8-inside")
    text = (_rows(spark, path).mapInArrow(_numbered, "value string, file string, block long, seq long")
            .join(inside, ["file", "block", "seq"])
            .groupBy("file", F.col("start").alias("off"))
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]),
                              MAGIC).cast("binary").alias("bytes")))
    body = F.expr("substring(bytes, CAST(head + 1 AS INT), CAST(length AS INT))")
    joined = torn.join(text, ["file", "off"]).withColumn("body", body)
    return whole.union(joined.select("file", "off", "kind", "ident", "refers", "digest", "full",
                                     F.octet_length("body").cast("long").alias("length"),
                                     F.sha2("body", 256).alias("sha")))


def _page(c: str):
    return F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) AS BIGINT)")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: one row per
    page, from archives written under the checkpoint folder and read back.

    A null html is an empty payload. Pages that repeat the id of a shared payload's
    first page are responses too; a page without an id can be a revisit, never the
    one referred to. Extra columns are not archived. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "op8-warc")
    write_archives(pages, path)
    got = read_archives(spark, path)
    response = F.col("kind") == "response"
    return got.select(_page("ident").alias("page_id"),
                      F.when(response, F.col("length")).otherwise(F.expr("try_cast(full AS BIGINT)"))
                      .alias("payload_bytes"),
                      F.when(response, F.col("sha")).otherwise(F.regexp_replace("digest", "^sha256:", ""))
                      .alias("payload_digest"),
                      F.col("kind").alias("record_type"), _page("refers").alias("refers_to"))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= {MIN_SHARED} GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN f.first IS NOT NULL AND f.first IS DISTINCT FROM d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first IS DISTINCT FROM d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest"""
