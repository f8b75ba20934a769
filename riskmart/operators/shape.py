"""Projection helpers (PRJ-1..7, SCA-29): schema decisions made on the driver
at plan time from ``df.columns`` / ``df.schema``, never from the data."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def rename_project(df: DataFrame, mapping: Mapping[str, str],
                   defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Select ``src AS dst`` for every pair; absent sources take ``defaults[dst]`` (PRJ-1/2)."""
    defaults = defaults or {}
    cols = []
    for src, dst in mapping.items():
        if src in df.columns:
            cols.append(F.col(src).alias(dst))
        else:
            cols.append(F.lit(defaults.get(dst)).alias(dst))
    return df.select(*cols)


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add every absent column with its default value (PRJ-2, SRC-8)."""
    missing = [(c, v) for c, v in defaults.items() if c not in df.columns]
    if not missing:
        return df
    return df.select("*", *[F.lit(v).cast(_lit_type(v)).alias(c) for c, v in missing])


def _lit_type(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "int"
    if isinstance(v, float):
        return "double"
    return "string"


def align(df: DataFrame, columns: Iterable[str], defaults: Mapping[str, object] | None = None,
          dtype: str | None = None) -> DataFrame:
    """Exactly ``columns`` in that order; absent ones get their default (ENC-3, SRC-8)."""
    defaults = defaults or {}
    out = []
    for c in columns:
        e = F.col(c) if c in df.columns else F.lit(defaults.get(c))
        if dtype:
            e = e.cast(dtype)
        out.append(e.alias(c))
    return df.select(*out)


def drop_present(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop the listed columns that exist (PRJ-3)."""
    present = [c for c in cols if c in df.columns]
    return df.drop(*present)


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    """Names of numeric or text columns (PRJ-4)."""
    if kind == "numeric":
        return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]
    if kind == "text":
        return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    raise ValueError(kind)


def select_kind(df: DataFrame, kind: str) -> DataFrame:
    return df.select(*columns_of_kind(df, kind))


def drop_text(df: DataFrame) -> DataFrame:
    """Drop leftover text columns after encoding (PRJ-4)."""
    return df.drop(*columns_of_kind(df, "text"))


def constant(df: DataFrame, name: str, value) -> DataFrame:
    """Constant column (PRJ-6)."""
    return df.withColumn(name, F.lit(value))


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Fill nulls with constants (SCA-29)."""
    return df.fillna(dict(values))
