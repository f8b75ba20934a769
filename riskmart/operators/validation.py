"""Data validation (VAL-*): rules as columns, results as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S


def rule_errors(df: DataFrame, rules: Sequence[tuple] = K.INPUT_RULES,
                numeric: bool = True) -> tuple[Column, list[Column]]:
    """Array column of rule violations per row, and the defaulted columns (VAL-1).

    A rule is ``(name, default, minimum, maximum)``: a required field has no
    default; a bounded field is parsed as a number and checked against its
    range. Absent optional columns take their default.
    """
    errs: list[Column] = []
    values: list[Column] = []
    for name, default, lo, hi in rules:
        present = name in df.columns
        raw = F.col(name) if present else F.lit(None).cast("string")
        if default is None:
            errs.append(F.when(raw.isNull(), F.lit(f"{name}: required")))
        v = raw if default is None else F.coalesce(raw.cast("string"), F.lit(str(default)))
        if lo is not None or hi is not None:
            num = S.safe_number(v.cast("string"), None)
            errs.append(F.when(v.isNotNull() & num.isNull(), F.lit(f"{name}: not a number")))
            if lo is not None:
                errs.append(F.when(num < F.lit(lo), F.lit(f"{name}: below {lo}")))
            if hi is not None:
                errs.append(F.when(num > F.lit(hi), F.lit(f"{name}: above {hi}")))
            v = num
        values.append(v.alias(name))
    arr = F.filter(F.array(*errs), lambda e: e.isNotNull())
    return arr, values


def validate(df: DataFrame, key: str, rules: Sequence[tuple] = K.INPUT_RULES
             ) -> tuple[DataFrame, DataFrame]:
    """Split rows into (valid, quarantine); quarantine keeps the error list."""
    arr, values = rule_errors(df, rules)
    checked = df.select(F.col(key), *values, arr.alias("errors"))
    valid = checked.where(F.size("errors") == 0).drop("errors")
    bad = checked.where(F.size("errors") > 0)
    return valid, bad


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count (VAL-2)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null count per listed column as one row (VAL-4)."""
    return df.agg(*[F.count(F.when(F.col(c).isNull(), F.lit(1))).alias(c) for c in cols])


def total_missing(df: DataFrame) -> DataFrame:
    """Number of null cells in the whole frame (VAL-5)."""
    cells = [F.when(F.col(c).isNull(), F.lit(1)).otherwise(F.lit(0)) for c in df.columns]
    return df.agg(F.sum(sum(cells, F.lit(0))).cast("long").alias("missing_cells"))


def require_rows(df: DataFrame, layer: str) -> DataFrame:
    """Fail loudly when a layer is empty (VAL-6); ``isEmpty`` reads one row."""
    if df.isEmpty():
        raise ValueError(f"{layer} is empty")
    return df


def parse_errors(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per row: numbers parsed with ``try``-semantics and the names of the
    columns that failed to parse, instead of failing the job (VAL-7)."""
    parsed = [S.safe_number(c, None).alias(c) for c in cols]
    bad = F.filter(F.array(*[F.when(F.col(c).isNotNull() & S.safe_number(c, None).isNull(),
                                    F.lit(c)) for c in cols]), lambda e: e.isNotNull())
    return df.select("*", *[p.alias(f"{c}_num") for p, c in zip(parsed, cols)],
                     F.array_join(bad, ",").alias("error"))


def integrity_report(tables: dict, primary_keys: dict, foreign_keys: list) -> DataFrame:
    """One row per check over stored tables (VAL-2, VAL-3, VAL-4): duplicate
    primary keys, null primary keys, and child rows without a parent."""
    parts = []
    for name, keys in primary_keys.items():
        df = tables.get(name)
        if df is None:
            continue
        dup = duplicate_keys(df, keys).agg(F.count(F.lit(1)).alias("violations"))
        parts.append(dup.select(F.lit(name).alias("table_name"),
                                F.lit("duplicate_key").alias("check"), "violations"))
        nulls = df.agg(F.count(F.when(sum((F.col(k).isNull().cast("int") for k in keys),
                                          F.lit(0)) > 0, 1)).alias("violations"))
        parts.append(nulls.select(F.lit(name).alias("table_name"),
                                  F.lit("null_key").alias("check"), "violations"))
    for child, ck, parent, pk in foreign_keys:
        c, p = tables.get(child), tables.get(parent)
        if c is None or p is None:
            continue
        orphan = c.select(ck).join(p.select(F.col(pk).alias(ck)), ck, "left_anti")
        parts.append(orphan.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(child).alias("table_name"), F.lit(f"orphan_{ck}").alias("check"),
            "violations"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
