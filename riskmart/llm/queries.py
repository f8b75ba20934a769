"""The thin queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontaminate, langid, licences, line_dedup, manifest, mixing, ngram_join, pii, quality, toxicity, vector_join, \
    warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.vector_components(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_components(table(spark, sf_dir, "documents"), short_docs=1)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items_found", "h")


def op7_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find_spans(table(spark, sf_dir, "documents")))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_documents(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_embedding_near_dedup, op3_language_id, op4_pareto_mix, op5_fuzzy_lines, op6_decontamination,
    op7_ftrl_toxicity, op8_warc, op9_pii,
    op10_licence_scan, op11_conversation_repair, op12_merkle_manifest,
    op13_quality)}
ORACLES: dict[str, str] = {"op4_pareto_mix": mixing.oracle(), "op8_warc": warc.ORACLE,
                           "op11_conversation_repair": conversations.oracle(),
                           "op12_merkle_manifest": manifest.oracle()}
