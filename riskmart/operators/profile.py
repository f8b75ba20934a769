"""Data-quality and exploratory profiles (AGG-23..28, TOP-6, TOP-10).

Each profile is one aggregate pass over the data that yields a single wide
row, which is then turned into long form with ``unpivot``/``stack``; the
wide row has one cell per column (or column pair), so its size is bounded by
the schema, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..session import materialize
from .gram import moments
from .joins import BROADCAST_ROWS
from .quantiles import grouped_exact_quantiles
from .shape import columns_of_kind


def _stack(pairs: Sequence[tuple[str, str]], name_col: str, value_col: str) -> str:
    inner = ", ".join(f"'{n}', `{c}`" for n, c in pairs)
    return f"stack({len(pairs)}, {inner}) AS (`{name_col}`, `{value_col}`)"


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: null count and percent of rows (AGG-23)."""
    cols = list(cols or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("__rows"),
                  *[F.count(F.when(F.col(c).isNull(), F.lit(1))).alias(f"__n_{i}")
                    for i, c in enumerate(cols)])
    long = wide.selectExpr("__rows", _stack([(c, f"__n_{i}") for i, c in enumerate(cols)],
                                            "column_name", "missing"))
    return long.select(
        "column_name", F.col("missing").cast("long").alias("missing"),
        S.share_percent("missing", F.nullif(F.col("__rows"), F.lit(0)), 2).alias("missing_pct"))


def shape_profile(df: DataFrame) -> DataFrame:
    """Rows, columns, numeric and text column counts (AGG-24)."""
    n_num = len(columns_of_kind(df, "numeric"))
    n_txt = len(columns_of_kind(df, "text"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.lit(len(df.columns)).alias("n_columns"),
                  F.lit(n_num).alias("n_numeric"),
                  F.lit(n_txt).alias("n_text"))


def dtypes_table(df: DataFrame) -> DataFrame:
    """Column name and type, as a small table (AGG-24)."""
    return df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString()) for f in df.schema.fields],
        "column_name string, data_type string")


def corr_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered column pair over the rows that have both,
    long form (AGG-25). One pass folds all cross products (``gram``); the diagonal is 1."""
    return moments(df, cols).select(F.col("a").alias("col_a"), F.col("b").alias("col_b"),
                                    F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.col("corr")).alias("corr"))


def top_corr_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.3,
                   n: int = 20) -> DataFrame:
    """Lower-triangle pairs with |r| > threshold, largest signed r first (TOP-6)."""
    place = {c: i for i, c in enumerate(cols)}
    at = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])
    out = (moments(df, cols).where((at[F.col("a")] < at[F.col("b")]) & (F.abs("corr") > F.lit(threshold)))
           .select(F.col("a").alias("feature_1"), F.col("b").alias("feature_2"), "corr"))
    return out.orderBy(F.col("corr").desc(), "feature_1", "feature_2").limit(n)


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Equal-width bin counts between min and max (AGG-26, SCA-28).

    min/max are a one-row aggregate broadcast to every row; the maximum value
    is counted in the last bin.
    """
    rng = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    x = df.select(column).where(F.col(column).isNotNull()).crossJoin(F.broadcast(rng))
    b = S.hist_bin(column, "__lo", "__hi", bins)
    width = (F.col("__hi") - F.col("__lo")) / F.lit(float(bins))
    return (x.groupBy(b.alias("bin"), "__lo", "__hi").agg(F.count(F.lit(1)).alias("count"))
            .select("bin",
                    (F.col("__lo") + (F.col("bin") - 1) * width).alias("bin_start"),
                    (F.col("__lo") + F.col("bin") * width).alias("bin_end"),
                    "count"))


def box_stats(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Five numbers, 1.5·IQR fences and outlier count (AGG-27).

    Quartiles are exact and computed without holding a group in one task
    (``grouped_exact_quantiles``); min/max are partial aggregates; the outlier
    count is a second pass with the fences joined back (one row per group).
    """
    quart = grouped_exact_quantiles(df, keys, column, [0.25, 0.5, 0.75]).select(
        *keys, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    mm = df.groupBy(*keys).agg(F.min(column).alias("min"), F.max(column).alias("max"))
    stats = (mm.join(quart, list(keys)) if keys else mm.crossJoin(quart)).select(
        *keys, "min", "q1", "median", "q3", "max")
    iqr = F.col("q3") - F.col("q1")
    stats = stats.withColumn("lower_fence", F.col("q1") - F.lit(1.5) * iqr) \
                 .withColumn("upper_fence", F.col("q3") + F.lit(1.5) * iqr)
    fences = stats.select(*keys, "lower_fence", "upper_fence")
    # one row per group: counted, then broadcast; only a large table is shuffled
    if keys:
        fences = materialize(fences, "fences")
        few = fences.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        joined = df.join(F.broadcast(fences) if few else fences.hint("merge"), list(keys))
    else:
        joined = df.crossJoin(F.broadcast(fences))
    x = F.col(column)
    out = joined.groupBy(*keys).agg(F.count(F.when((x < F.col("lower_fence")) |
                                                   (x > F.col("upper_fence")), F.lit(1)))
                                    .alias("n_outliers"))
    return stats.join(out, list(keys)) if keys else stats.crossJoin(out)


def ols_trend(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` (AGG-28)."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def null_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """0/1 is-null indicator per column (TOP-10)."""
    cols = list(cols or df.columns)
    return df.select(*[F.col(c).isNull().cast("int").alias(c) for c in cols])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.IntegerType, T.LongType, T.DoubleType,
                                       T.FloatType, T.ShortType, T.DecimalType))]
