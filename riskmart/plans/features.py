"""Cleaning and feature jobs shared by training and scoring (JOB-1..3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from ..operators.aggregates import median_mode_fill
from ..operators.quantiles import quantile_row
from ..operators.sequence import first_per_key
from ..operators.shape import columns_of_kind, drop_present
from ..session import materialize
from ..sources.readers import null_tokens


def type_numeric(df: DataFrame, cols=K.NUMERIC_RAW_COLUMNS) -> DataFrame:
    """Parse the known numeric raw columns that are present (text -> double)."""
    return df.select(*[S.safe_number(c, None).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def clean(raw: DataFrame, keep_ids: bool = False, order_col: str = "admitted_at",
          tokens=K.NULL_TOKENS, materialize_rows: bool = True) -> DataFrame:
    """JOB-1: null tokens -> null, first encounter per patient, binary target,
    drop listed columns, diagnosis categories, median/mode fill."""
    df, numbers = raw, K.NUMERIC_RAW_COLUMNS
    if "patient_nbr" in df.columns:
        # only what picks the row is cleaned on all rows, the rest on those that stay
        df = type_numeric(null_tokens(df, tokens, ["patient_nbr", "encounter_id", order_col]), [order_col] if order_col in numbers else [])
        order = ([order_col] if order_col in df.columns else []) + \
                [F.col("encounter_id").try_cast("long")]
        df = first_per_key(df, "patient_nbr", order)
        numbers = [c for c in numbers if c != order_col]
    df = type_numeric(null_tokens(df, tokens), numbers)
    df = df.withColumn("readmitted_binary", S.readmit_flag("readmitted")).drop("readmitted")
    drop = [c for c in K.DROP_COLUMNS if not (keep_ids and c in ("encounter_id", "patient_nbr"))]
    df = drop_present(df, drop)
    for c in K.DIAG_COLUMNS:
        if c in df.columns:
            df = df.withColumn(f"{c}_category", S.code_category(c)).drop(c)
    ids = {"encounter_id", "patient_nbr"}
    numeric = [c for c in columns_of_kind(df, "numeric") if c != "readmitted_binary"]
    text = [c for c in columns_of_kind(df, "text") if c not in ids]
    if materialize_rows:
        # fill statistics are a second pass over the same rows
        df = materialize(df, "clean-rows")
    return median_mode_fill(df, numeric, text)


def engineer(df: DataFrame, lab_threshold: float | None = None,
             materialize_rows: bool = True) -> DataFrame:
    """JOB-2: derived features. ``lab_threshold`` fixes the high-lab cut
    (score time); by default it is the data's 75th percentile (fit time)."""
    cols = set(df.columns)
    visits = [c for c in K.VISIT_COLUMNS if c in cols]
    out = df
    if visits:
        out = out.withColumn("total_visits", S.row_sum(visits))
    if "change" in cols:
        out = out.withColumn("medication_change", S.equals_flag("change", "Ch"))
    if "num_lab_procedures" in cols:
        if lab_threshold is None and materialize_rows:
            # the quantile is a second pass over the same rows
            out = materialize(out, "feature-rows")
        if lab_threshold is None:
            t = quantile_row(out, "num_lab_procedures", K.HIGH_LAB_QUANTILE, "__t")
            out = (out.crossJoin(F.broadcast(t))
                   .withColumn("high_lab_procedures", S.above_flag("num_lab_procedures",
                                                                  F.col("__t")))
                   .drop("__t"))
        else:
            out = out.withColumn("high_lab_procedures",
                                 S.above_flag("num_lab_procedures", lab_threshold))
    if "age" in cols:
        out = out.withColumn("age_numeric", S.lookup("age", K.AGE_MAP, K.AGE_DEFAULT)
                             .cast("double"))
    if "num_medications" in cols:
        out = out.withColumn("num_medications_bin", S.medication_bin("num_medications"))
    meds = [m for m in K.MEDICATION_COLS if m in cols]
    if meds:
        # the text stays (D9); the 0/1 flag goes to <column>_flag
        out = out.select("*", *[S.not_no_flag(c).alias(f"{c}_flag") for c in meds])
        out = out.withColumn("total_medications_active",
                             S.row_sum([f"{c}_flag" for c in meds]))
    diag = [c for c in out.columns if c.startswith("diag_") and c.endswith("_category")]
    if diag:
        out = out.withColumn("num_diagnoses", S.count_true([F.col(c) != "Other" for c in diag]))
    return out


def fit_params(cleaned: DataFrame) -> DataFrame:
    """Fit-time feature parameters as a one-row table (D6): the high-lab
    threshold is the 75th percentile of the training rows. Stored next to the
    encoders, it is passed to ``engineer(..., lab_threshold=...)`` at score time
    so training and scoring share one value."""
    return quantile_row(cleaned, "num_lab_procedures", K.HIGH_LAB_QUANTILE, "lab_threshold")
