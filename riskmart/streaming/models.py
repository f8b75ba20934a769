"""Live scoring by a fitted model (STR-2, SNK-13): published versions, one version per
micro-batch, swap between batches.

A registry folder holds one folder per published model and ``published/seq=<n>``, one
small row per publication. A model's files are complete before its row appears, so a
swap is the appearance of one file: a batch sees the old version or the new one whole.
The version that scored a batch is stored under the batch's id, and a replay takes that
one, also after later swaps.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from ..operators import ml as ML
from ..operators.linear import LinearModel, weights_table
from ..plans.features import engineer, type_numeric
from ..sources import sinks as SK
from ..sources.readers import null_tokens

ENTRY = "version string, kind string, path string, features array<string>, lab_threshold double"

#: Version of rows that no model scored.
NO_MODEL = "none"

BIAS = "(bias)"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def publish(spark: SparkSession, registry: str, version: str, model, features: Sequence[str],
            lab_threshold: float | None = None) -> None:
    """Store ``model`` (a ``LinearModel`` or a fitted ML pipeline) and make it the current
    version. ``lab_threshold`` is the high-lab cut of its training rows (D6). Of two
    publications at once one fails with an existing path and can be repeated."""
    path = f"{registry}/models/{uuid.uuid4().hex}"
    if isinstance(model, LinearModel):
        kind = "linear"
        weights_table(model, spark).write.parquet(path)
    else:
        kind = "pipeline"
        SK.save_model(model, path)
    announce(spark, registry, Row(version=version, kind=kind, path=path, features=list(features),
                                  lab_threshold=lab_threshold))


def announce(spark: SparkSession, registry: str, entry: Row) -> None:
    """Name an already stored model as the current one (also: go back to an earlier)."""
    known = _read(spark, f"{registry}/published")
    last = None if known is None else known.agg(F.max("seq")).first()[0]
    n = 0 if last is None else int(last) + 1
    spark.createDataFrame([entry], ENTRY).coalesce(1).write.mode("errorifexists").parquet(f"{registry}/published/seq={n}")


def versions(spark: SparkSession, registry: str) -> DataFrame | None:
    """All publications with their sequence number, or None without any."""
    return _read(spark, f"{registry}/published")


def current(spark: SparkSession, registry: str) -> Row | None:
    known = versions(spark, registry)
    if known is None:
        return None
    return known.agg(F.max_by(F.struct(*[c for c in known.columns if c != "seq"]), "seq").alias("e")).first()["e"]


def load(spark: SparkSession, entry: Row):
    """The stored model of a publication."""
    if entry["kind"] == "pipeline":
        return SK.load_model(entry["path"])
    # one row per feature
    w = {r["term"]: r["weight"] for r in spark.read.parquet(entry["path"]).collect()}
    names = tuple(entry["features"])
    return LinearModel(names, tuple(w[c] for c in names), w[BIAS], 0, 0.0)


def live_features(records: DataFrame, features: Sequence[str], lab_threshold: float | None) -> DataFrame:
    """Raw records with ``__raw`` (the record as it came), ``__readable`` and the model's
    features, row by row: an absent column or number counts as 0 (ENC-3), a number that
    cannot be read makes the record unreadable. Nothing is fitted on the batch."""
    df = null_tokens(records.select(F.struct(*records.columns).alias("__raw"), *records.columns))
    numeric = [c for c in K.NUMERIC_RAW_COLUMNS if c in records.columns]
    readable = F.lit(True)
    for c in numeric:
        readable = readable & (F.col(c).isNull() | S.safe_number(c, None).isNotNull())
    df = df.withColumn("__readable", readable)
    # without a cut of its own a model sees no high lab counts
    df = engineer(type_numeric(df, numeric), float("inf") if lab_threshold is None else lab_threshold)
    return df.select("__raw", "__readable", *[
        (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(c) for c in features])


def model_scores(records: DataFrame, entry: Row, model, out: str = "model_score") -> DataFrame:
    """Records with ``out``, the positive class's probability to 4 decimals (null for
    unreadable records), and ``model_version``."""
    rows = live_features(records, entry["features"], entry["lab_threshold"])
    p = ML.predicted(model, rows, out)
    return p.select("__raw.*", F.when(F.col("__readable"), F.bround(out, 4)).alias(out),
                    F.lit(entry["version"]).alias("model_version"))


def scorer(registry: str, root: str) -> Callable[[DataFrame, int], DataFrame]:
    """``(batch, batch_id) -> batch with model_score and model_version``.

    The current version is looked up once per batch and loaded once per version. Without
    a published model, or where its files cannot be loaded, the score is null and the
    version ``none``, which the caller turns into .5 / Medium. A failing task is not
    caught: it fails the batch, and the restarted stream repeats it.
    """
    loaded: dict[str, object] = {}

    def usable(spark, entry):
        if entry is None:
            return None
        if entry["path"] not in loaded:
            try:
                model = load(spark, entry)
            except Exception as e:  # noqa: BLE001 - any unreadable model means fallback scores (STR-8)
                print(f"model {entry['version']} cannot be loaded: {type(e).__name__}")
                return None
            loaded.clear()
            loaded[entry["path"]] = model
        return loaded[entry["path"]]

    def chosen(spark, batch_id):
        past = _read(spark, f"{root}/batch_models")
        mine = None if past is None else past.where(F.col("batch_id") == int(batch_id)).first()
        if mine is not None:
            entry = mine["entry"]
            return entry, usable(spark, entry)
        entry = current(spark, registry)
        model = usable(spark, entry)
        if model is None:
            entry = None
        SK.write_batch_partition(spark.createDataFrame([(entry,)], f"entry struct<{_fields()}>"),
                                 f"{root}/batch_models", batch_id)
        return entry, model

    def score(batch: DataFrame, batch_id: int) -> DataFrame:
        entry, model = chosen(batch.sparkSession, batch_id)
        if model is None:
            return batch.select("*", F.lit(None).cast("double").alias("model_score"), F.lit(NO_MODEL).alias("model_version"))
        return model_scores(batch, entry, model)

    return score


def _fields() -> str:
    return ", ".join(f"{f.split()[0]}: {f.split()[1]}" for f in ENTRY.split(", "))
