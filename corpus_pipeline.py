"""Training-data pipeline over ``documents``: every stage works on all that the
stage before kept, and is written as Parquet and read again by the next.

Toxic documents go, near-equal lines are kept once, one document of each group of
near copies stays, documents that hold benchmark passages go, and what is left is
mixed to target weights per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.llm import common, decontaminate, line_dedup, mixing, ngram_join, toxicity

THRESHOLD = 0.7
SHINGLE, PERCENT = 5, 80


ROW = "__row"


def with_row(docs: DataFrame) -> DataFrame:
    """``docs`` with ``ROW``: the id, or a number of its own (above all usual ids) for a
    text whose id also names other texts. Equal rows share it; it is null without an id."""
    key = decontaminate.text_key(F.col("doc_id"), F.col("text"))
    many = (docs.select(F.col("doc_id").alias("__id"), key.alias("__key")).where("__id IS NOT NULL")
            .groupBy("__id").agg(F.min("__key").alias("lo"), F.max("__key").alias("hi")).where("lo < hi").select("__id"))
    many = common.store(many, "pipeline-repeated-ids")
    own = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("doc_id", key), 2)
    return (docs.join(many, F.col("doc_id").cast("long") == F.col("__id"), "left")
            .withColumn(ROW, F.when(F.col("__id").isNull(), F.col("doc_id").cast("long")).otherwise(own)).drop("__id"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``THRESHOLD`` by a model fitted on ``labels``."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, docs.columns).where(F.col("score") < THRESHOLD).drop("score")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that (nearly) repeat an earlier one; ``n_chars`` follows.
    Texts whose id names several come after the others."""
    rows = with_row(docs)
    out = line_dedup.drop_lines(rows, line_dedup.line_components(rows, id_col=ROW, short_docs=1), id_col=ROW)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies; texts whose id
    names several come after the others and are judged each by itself. Rows without an
    id stay; a row repeated with its id and text stays once."""
    rows = with_row(docs)
    groups = common.store(ngram_join.ngram_components(rows, k=SHINGLE, percent=PERCENT, id_col=ROW), "groups")
    others = groups.where("doc_id != component_id").select(F.col("doc_id").alias(ROW)).distinct()
    kept = rows.join(others, ROW, "left_anti")
    again = groups.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1") \
        .select(F.col("doc_id").alias(ROW))
    if not again.isEmpty():
        ids = common.store(again, "repeated")
        kept = kept.join(ids, ROW, "left_anti").unionByName(
            kept.join(ids, ROW, "left_semi").dropDuplicates([ROW]))
    return kept.select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    found = decontaminate.contamination(docs, common.table(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) \
        & (decontaminate.text_key(F.col("doc_id"), F.col("text")) == F.col("__h"))
    return docs.join(bad, same, "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many copies and words the mix takes of every document."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram jaccard join", one_of_each_group),
    ("benchmark decontamination", decontaminated),
    ("mix sources to target weights", mixed),
]

#: The learned and the similarity stages have no SQL form; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.store(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
