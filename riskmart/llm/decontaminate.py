"""Operator 6: benchmark decontamination with a distributed positional index.

The index holds, per document, the positions of the terms of the test set (the
vocabulary; above ``VOCABULARY`` terms, of all terms). A word can be part of a
match only if it stands in an unbroken run of vocabulary words at least as long as
the shortest window, so other positions are not stored. A phrase search takes the
rarest term of every window, shifts its postings by the term's offset to get
alignments of item and document, and intersects those with the postings of the
item's other terms at their own offsets. Unbroken stretches of at least one window
are the exact matches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, store
from .tokens import ALNUM, text_blocks, words

WINDOW = 10
VOCABULARY = 4_000_000        # terms; 32 MB broadcast at most

POSTINGS = "array<struct<term:bigint,at:array<int>>>"


def _terms(batches):
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, buf, off in text_blocks(batch.column(1)):
            h, _, _, first = words(buf, off, ALNUM)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo),
                 pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h.view(np.int64)))],
                names=["item", "terms"])


def test_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (text; a null id is the text 'null'), terms, key: one row per distinct
    id and word sequence; items without words are left out."""
    src = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"),
                           F.col(text_col).cast("string").alias("text"))
    out = src.mapInArrow(_terms, "item string, terms array<long>").where("size(terms) > 0").distinct()
    return store(out.withColumn("key", F.xxhash64("item", "terms")), "op6-items")


def _postings(vocabulary, run: int):
    def go(batches):
        known = None if vocabulary is None else vocabulary.value
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, off in text_blocks(batch.column(1)):
                h, _, _, first = words(buf, off, ALNUM)
                h = h.view(np.int64)
                if known is None:
                    use = np.ones(len(h), dtype=bool)
                elif len(known) == 0:
                    use = np.zeros(len(h), dtype=bool)
                else:
                    use = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                # runs of vocabulary words end at gaps and at document ends
                edge = np.zeros(len(h) + 1, dtype=bool)
                edge[first] = True
                edge[len(h)] = True
                begin = np.flatnonzero(use & (edge[:-1] | ~np.concatenate(([False], use[:-1]))))
                end = np.flatnonzero(use & (edge[1:] | ~np.concatenate((use[1:], [False])))) + 1
                ok = end - begin >= run
                begin, size = begin[ok], (end - begin)[ok]
                at = (np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size)
                      + np.arange(size.sum())) if len(begin) else np.empty(0, np.int64)
                doc = np.searchsorted(first[1:], at, side="right")
                order = np.lexsort((at, h[at], doc))
                at, doc = at[order], doc[order]
                term = h[at]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
                heads = np.flatnonzero(new)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(heads, len(at)), pa.int32()), pa.array((at - first[doc]).astype(np.int32)))
                entry = pa.StructArray.from_arrays([pa.array(term[heads]), lists], names=["term", "at"])
                per = np.searchsorted(doc[heads], np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo),
                     pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(per, pa.int32()), entry)],
                    names=["doc_id", "h", "n_words", "postings"])
    return go


def text_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart that repeat an id, or have none."""
    return F.xxhash64(doc_id.isNull(), text.cast("string"))


def build_index(docs: DataFrame, items: DataFrame | None = None, run: int | None = None,
                id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Store the positional index: doc_id, h (hash of the text), n_words, postings.

    With ``items`` only their terms are indexed, and of those only runs of at least
    ``run`` (by default the shortest window that a search of ``window`` words has). Without, every position is."""
    spark = docs.sparkSession
    prepare(spark)
    vocabulary = None
    if items is not None:
        terms = items.select(F.explode("terms").alias("t")).distinct()
        if terms.count() <= VOCABULARY:
            t = np.sort(terms.toArrow().column("t").to_numpy())
            vocabulary = spark.sparkContext.broadcast(t)
        if run is None:
            run = items.agg(F.min(F.least(F.size("terms"), F.lit(window)))).first()[0] or 1
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      text_key(F.col(id_col), F.col(text_col)).alias("h"))
    return store(src.mapInArrow(_postings(vocabulary, run or 1),
                                f"doc_id long, h long, n_words long, postings {POSTINGS}"), "op6-index")


def _lists(index: DataFrame) -> DataFrame:
    """doc (id, 0 for null; ``h`` differs then), h, term, at: one row per posting list."""
    return (index.select(F.coalesce("doc_id", F.lit(0)).alias("doc"), "h", F.explode("postings").alias("p"))
            .select("doc", "h", F.col("p.term").alias("term"), F.col("p.at").alias("at")))


def _frequency(index: DataFrame) -> DataFrame:
    return store(_lists(index).groupBy("term").agg(F.sum(F.size("at")).alias("f")), "op6-frequency")


def phrase_matches(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, h, item, first, last: stretches of a document (word positions) that
    equal a stretch of the item of at least ``window`` words, or the whole item if it
    has fewer."""
    terms = items.select("key", F.size("terms").alias("n"), F.posexplode("terms").alias("j", "term"))
    known = terms.join(_frequency(index), "term")
    # a window whose rarest term is absent cannot occur: absent terms sort first
    seen = known.groupBy("key").agg(F.first("n").alias("n"), F.map_from_entries(
        F.collect_list(F.struct("j", F.struct("f", "j", "term")))).alias("at"))
    span = F.least(F.lit(window), F.col("n"))
    starts = F.sequence(F.lit(0), F.col("n") - span)

    def rarest(s: Column) -> Column:
        inside = F.transform(F.sequence(s, s + span - 1), lambda j: F.try_element_at("at", j))
        return F.when(~F.exists(inside, lambda x: x.isNull()), F.array_min(inside))

    anchors = (seen.select("key", F.explode(F.array_distinct(F.transform(starts, rarest))).alias("a"))
               .where("a IS NOT NULL").select("key", F.col("a.j").alias("j"), F.col("a.term").alias("term")))
    anchors = store(anchors, "op6-anchors")
    lists = _lists(index)
    aligned = store(lists.join(anchors, "term")
                    .select("doc", "h", "key", "j", F.explode("at").alias("p"))
                    .select("doc", "h", "key", (F.col("p") - F.col("j")).alias("shift")).distinct(), "op6-aligned")
    wanted = (aligned.join(items.select("key", "terms"), "key")
              .select("doc", "h", "key", "shift", F.posexplode("terms").alias("j", "term"))
              .where("shift + j >= 0"))
    met = (wanted.join(lists, ["doc", "h", "term"])
           .where(F.array_contains("at", F.col("shift") + F.col("j"))).select("doc", "h", "key", "shift", "j")
           .distinct())                  # repeated rows hold the same postings
    line = Window.partitionBy("doc", "h", "key", "shift").orderBy("j")
    return (met.withColumn("g", F.col("j") - F.row_number().over(line))
            .groupBy("doc", "h", "key", "shift", "g")
            .agg(F.min("j").alias("a"), F.max("j").alias("b"))
            .join(items.select("key", "item", F.size("terms").alias("n")), "key")
            .where(F.col("b") - F.col("a") + 1 >= F.least(F.lit(window), F.col("n")))
            .select("doc", "h", "item", (F.col("shift") + F.col("a")).alias("first"),
                    (F.col("shift") + F.col("b")).alias("last")))


def proximity_matches(index: DataFrame, items: DataFrame, slop: int) -> DataFrame:
    """doc, h, item, at: places of an item's rarest term with all its other terms at
    most ``slop`` words away, in any order. The index must hold single positions
    (``build_index(..., run=1)``)."""
    terms = items.select("key", "item", F.explode(F.array_distinct("terms")).alias("term"))
    known = terms.join(_frequency(index), "term", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    lead = known.groupBy("key", "item").agg(F.min(F.struct("f", "term")).alias("a"), F.count("*").alias("n"))
    lead = lead.where("a.f > 0").select("key", "item", "n", F.col("a.term").alias("term"))
    lists = _lists(index)
    place = lists.join(lead, "term").select("doc", "h", "key", "item", "n", F.explode("at").alias("p"))
    others = terms.join(lead.select("key", "term"), ["key", "term"], "left_anti").select("key", "term")
    near = (place.join(others, "key").join(lists, ["doc", "h", "term"])
            .where(F.exists("at", lambda x: F.abs(x - F.col("p")) <= slop))
            .groupBy("doc", "h", "key", "p").agg(F.count("*").alias("met")))
    return (place.join(near, ["doc", "h", "key", "p"], "left")
            .where(F.coalesce("met", F.lit(0)) == F.col("n") - 1)
            .select("doc", "h", "item", F.col("p").alias("at")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items_found: one
    row per input row.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Null
    or empty texts have no words and no hits; items without words match nothing; a
    null item id is named 'null'. Repeated rows get the same answer each, rows that
    repeat an id with another text are judged by their own text. Other columns are
    not read; empty tables give no hits.
    """
    items = test_items(benchmark)
    index = build_index(docs, items, window=window)
    hits = store(phrase_matches(index, items, window), "op6-hits")
    covered = (hits.select("doc", "h", F.explode(F.sequence("first", "last")).alias("p")).distinct()
               .groupBy("doc", "h").agg(F.count("*").alias("n_hit")))
    named = (hits.select("doc", "h", "item").distinct().groupBy("doc", "h")
             .agg(F.sort_array(F.collect_list("item")).alias("items_found")))
    found = store(covered.join(named, ["doc", "h"]), "op6-found")
    none = F.array().cast("array<string>")
    return (index.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("doc"), "h", "n_words")
            .join(found, ["doc", "h"], "left")
            .withColumn("items_found", F.coalesce("items_found", none))
            .withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
            .select("doc_id", "n_words", "n_hit", F.size("items_found").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items_found", ","), 256).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated"), "items_found", "h"))
