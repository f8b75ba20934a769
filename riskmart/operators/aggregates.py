"""Grouped and global aggregates (AGG-*).

All of them are single ``groupBy``/``agg`` passes, which Spark runs as a
partial (map-side) aggregate followed by one shuffle of the partial rows; a hot
group is therefore reduced on every map task before it moves. Global totals
are one-row aggregates joined back with a broadcast, never a window without
partition keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .quantiles import medians_row


def value_counts(df: DataFrame, column: str, normalize: bool = False,
                 out: str = "count", share: str = "share") -> DataFrame:
    """Rows per value, optionally with the fraction of all rows (AGG-16, WIN-4);
    the total is a one-row aggregate joined back, not a global window."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias(out))
    if not normalize:
        return counts
    total = counts.agg(F.sum(out).alias("__total"))
    return (counts.crossJoin(F.broadcast(total))
            .withColumn(share, F.col(out) / F.col("__total")).drop("__total"))


def level_counts(df: DataFrame, level: str = "risk_level", out: str = "n") -> DataFrame:
    """Rows per level (AGG-6)."""
    return df.groupBy(level).agg(F.count(F.lit(1)).alias(out))


def zero_filled_levels(df: DataFrame, levels: Sequence[str], level: str = "risk_level",
                       out: str = "patient_count", pct: str = "percentage") -> DataFrame:
    """Rows per level with every listed level present (0 when absent), and
    percent of all rows (AGG-5). The level list is a fixed, tiny table."""
    spark = df.sparkSession
    lv = spark.createDataFrame([(x, i) for i, x in enumerate(levels)], [level, "__ord"])
    counts = df.groupBy(level).agg(F.count(F.lit(1)).alias(out))
    j = (F.broadcast(lv).join(counts, level, "left")
         .select(level, F.coalesce(F.col(out), F.lit(0)).cast("long").alias(out)))
    total = j.agg(F.sum(out).alias("__total"))
    return (j.crossJoin(F.broadcast(total))
            .withColumn(pct, S.share_percent(out, F.nullif(F.col("__total"), F.lit(0)), 1))
            .drop("__total"))


def grouped_stats(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column],
                  drop_null_keys: bool = True) -> DataFrame:
    """``groupBy(keys).agg(**aggs)``; null keys are dropped as pandas does."""
    if drop_null_keys:
        for k in keys:
            df = df.where(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def pct_true(cond: Column) -> Column:
    """Percent of rows where ``cond`` holds (AGG-10): mean of 100/0."""
    return F.avg(F.when(cond, F.lit(100.0)).otherwise(F.lit(0.0)))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def pivot_counts(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Row × column count table with fixed column values (AGG-14).

    Passing ``values`` avoids the extra job Spark runs to discover them.
    """
    return (df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1)))
            .fillna(0, subset=list(values)))


def monthly_rate(df: DataFrame, ts: str, flag: Column, out_month: str = "month") -> DataFrame:
    """Rows, flagged rows and percent flagged per calendar month (AGG-29)."""
    m = df.groupBy(S.month_start(ts).alias(out_month)).agg(
        F.count(F.lit(1)).alias("total_patients"),
        F.count(F.when(flag, F.lit(1))).alias("readmissions"))
    return m.withColumn("readmission_rate", S.share_percent("readmissions", "total_patients", 1))


def medians(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """One row with the exact median of each column (AGG-18), bounded memory."""
    return medians_row(df, list(cols))


def mode_row(df: DataFrame, column: str, default: str = "Unknown") -> DataFrame:
    """One row with the most frequent non-null value; ties -> smallest value.

    Counting is a grouped aggregate (partial per task, shuffled by value); the
    pick is a global ``min_by`` whose buffer is one (value, count) pair, so no
    task holds the whole value -> count map.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("__n"))
    best = counts.agg(F.min_by(F.col(column), F.struct(-F.col("__n"), F.col(column)))
                      .alias(column))
    return best.select(F.coalesce(F.col(column), F.lit(default)).alias(column))


def modes(df: DataFrame, cols: Iterable[str], default: str = "Unknown") -> DataFrame:
    """One row with each column's most frequent value; ties -> smallest value;
    an all-null column gives ``default`` (AGG-19).

    All columns are counted in one pass over a long (column, value) form; the
    pick per column is a ``min_by`` over that column's distinct values."""
    cols = list(cols)
    if not cols:
        return df.sparkSession.range(1).select()
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v"))
                                for c in cols]))
    long = df.select(pairs.alias("p")).select("p.k", "p.v").where(F.col("v").isNotNull())
    counts = long.groupBy("k", "v").agg(F.count(F.lit(1)).alias("__n"))
    best = counts.groupBy("k").agg(F.min_by("v", F.struct(-F.col("__n"), F.col("v"))).alias("v"))
    wide = best.groupBy().pivot("k", cols).agg(F.first("v"))
    return wide.select(*[F.coalesce(F.col(c), F.lit(default)).alias(c) for c in cols])


def fill_from_row(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill nulls of ``cols`` from the one-row ``stats`` table (broadcast)."""
    st = stats.select(*[F.col(c).alias(f"__fill_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(st))
    return j.select(*[F.coalesce(F.col(c), F.col(f"__fill_{c}")).alias(c) if c in cols
                      else F.col(c) for c in df.columns])


def median_mode_fill(df: DataFrame, numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    """Numeric nulls -> column median, text nulls -> column mode (JOB-1 step 5).

    Medians use the bounded exact quantile; modes are one aggregate pass (a
    mode's buffer holds the distinct values of a categorical column).
    """
    parts = []
    if numeric:
        parts.append(medians_row(df, list(numeric)))
    if text:
        parts.append(modes(df, list(text)))
    if not parts:
        return df
    stats = parts[0] if len(parts) == 1 else parts[0].crossJoin(parts[1])
    return fill_from_row(df, stats, list(numeric) + list(text))


def class_ratio(df: DataFrame, label: str) -> DataFrame:
    """negatives / positives (AGG-30)."""
    pos = F.count(F.when(F.col(label) == 1, F.lit(1)))
    neg = F.count(F.when(F.col(label) == 0, F.lit(1)))
    return df.agg(neg.alias("negatives"), pos.alias("positives"),
                  S.safe_ratio(neg, pos).alias("ratio"))


def arg_max(df: DataFrame, value: str, by: str, keys: Sequence[str] = ()) -> DataFrame:
    """Value of ``value`` at the maximum of numeric ``by`` (AGG-31); per group if
    keys. Ties on ``by`` go to the smallest ``value``, so the pick is
    deterministic (one (by, value) pair in the aggregation buffer)."""
    agg = [F.min_by(F.col(value), F.struct(-F.col(by), F.col(value))).alias(value),
           F.max(by).alias(by)]
    return df.groupBy(*keys).agg(*agg) if keys else df.agg(*agg)


def table_counts(tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """Row count per named table; a missing table counts 0 (AGG-22)."""
    parts = []
    spark = None
    for name, df in tables.items():
        if df is not None:
            spark = df.sparkSession
            parts.append(df.agg(F.lit(name).alias("table_name"),
                                F.count(F.lit(1)).alias("row_count")))
    missing = [n for n, df in tables.items() if df is None]
    if spark is None:
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
    if missing:
        parts.append(spark.createDataFrame([(n, 0) for n in missing],
                                           "table_name string, row_count long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
