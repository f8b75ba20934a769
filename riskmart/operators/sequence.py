"""Order-dependent row operators (WIN-1, WIN-2, WIN-3, WIN-4, ``lead``).

Spark's ``Window.partitionBy(key)`` sends every row of a key to one task, so a
key that holds a third of the data would become one huge sort. The operators
here split each key before anything order-dependent runs:

* ``first_per_key`` aggregates ``min_by(row, order)`` with map-side partial
  aggregation, so a hot key is already one row per map task when shuffled.
* ``next_in_order`` computes ``lead`` inside (key, time block) partitions and
  links blocks with a second, much smaller ``lead`` over one row per block.
* ``dense_row_id`` numbers rows after a range partitioning: each partition
  numbers its own rows and adds the row counts of the partitions before it,
  which is one row per partition (a bounded broadcast).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def first_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[Column | str],
                  descending: bool = False) -> DataFrame:
    """Keep the first row of every key under a total ``order`` (WIN-1).

    ``descending=True`` keeps the last row instead ("latest per key").
    Rows whose key is null form one group, as a window would.
    """
    keys = _cols(key)
    rest = [c for c in df.columns if c not in keys]
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    pick = F.max_by if descending else F.min_by
    row = F.struct(*[F.col(c) for c in rest])
    ordering = F.struct(*order_cols)
    out = df.groupBy(*keys).agg(pick(row, ordering).alias("__row"))
    return out.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def first_per_key_window(df: DataFrame, key: str | Sequence[str],
                         order: Sequence[Column | str]) -> DataFrame:
    """Window form of WIN-1; fine when no key is heavy."""
    w = Window.partitionBy(*_cols(key)).orderBy(*order)
    return (df.withColumn("__rn", F.row_number().over(w))
            .where(F.col("__rn") == 1).drop("__rn"))


def next_in_order(df: DataFrame, key: str, ts: str, tiebreak: str, value: str,
                  out: str, block: str = "day", method: str = "ranged",
                  partitions: int | None = None) -> DataFrame:
    """Add ``out`` = ``value`` of the next row of the same ``key`` in order
    (``ts``, ``tiebreak``); null for the last row. Equal to
    ``lead(value) over (partition by key order by ts, tiebreak)``.

    ``method='ranged'`` (default) range-partitions rows on (key, ts, tiebreak),
    so a key holding a third of the data spans many partitions. ``lead`` runs
    inside each (partition, key) segment, which is no larger than a partition.
    The last row of a segment takes the first value of the key's next segment,
    found with a window over one row per segment; a key has at most as many
    segments as there are partitions. Both windows are bounded.

    ``method='blocks'`` splits each key by time instead: ``lead`` inside
    (key, ``date_trunc(block, ts)``) and a second ``lead`` over one row per
    block. This needs no stored copy, but one busy block of a hot key is still
    a single task.
    """
    if method == "ranged":
        return _next_ranged(df, key, ts, tiebreak, value, out, partitions)
    blk = "__blk"
    data = df.withColumn(blk, F.date_trunc(block, F.col(ts)))
    w_in = Window.partitionBy(key, blk).orderBy(ts, tiebreak)
    data = data.withColumn("__lead", F.lead(value).over(w_in))
    heads = (data.groupBy(key, blk)
             .agg(F.min_by(F.col(value), F.struct(F.col(ts), F.col(tiebreak))).alias("__head")))
    w_blk = Window.partitionBy(key).orderBy(blk)
    links = heads.select(key, blk, F.lead("__head").over(w_blk).alias("__next_head"))
    joined = data.join(links.hint("merge"), [key, blk], "left")
    return (joined.withColumn(out, F.coalesce(F.col("__lead"), F.col("__next_head")))
            .drop("__lead", "__next_head", blk))


def _next_ranged(df: DataFrame, key: str, ts: str, tiebreak: str, value: str, out: str,
                 partitions: int | None) -> DataFrame:
    from ..session import materialize, range_partitions
    n = partitions or range_partitions(df.sparkSession)
    # range boundaries come from a sample: write the partitioned rows once
    ranged = materialize(df.repartitionByRange(n, key, ts, tiebreak)
                         .withColumn("__pid", F.spark_partition_id()), "lead-ranged")
    w_seg = Window.partitionBy("__pid", key).orderBy(ts, tiebreak)
    data = ranged.withColumn("__lead", F.lead(value).over(w_seg))
    heads = ranged.groupBy("__pid", key).agg(
        F.min_by(F.col(value), F.struct(F.col(ts), F.col(tiebreak))).alias("__head"))
    w_next = Window.partitionBy(key).orderBy("__pid")
    links = heads.select("__pid", key, F.lead("__head").over(w_next).alias("__next_head"))
    joined = data.join(links.hint("merge"), ["__pid", key], "left")
    return (joined.withColumn(out, F.coalesce(F.col("__lead"), F.col("__next_head")))
            .drop("__lead", "__next_head", "__pid"))


def dense_row_id(df: DataFrame, order: Sequence[str], out: str = "id",
                 partitions: int | None = None, start: int = 1) -> DataFrame:
    """Consecutive ids ``start, start+1, ...`` in ``order`` (WIN-2, SNK-10).

    A global ``row_number()`` would pull every row into one partition. Here the
    rows are range-partitioned by ``order``; each row gets its rank inside its
    partition, and the offset of its partition comes from a one-row-per-
    partition table of counts, which is broadcast (its size is the partition
    count, not the data size).

    Range boundaries come from a sample and may differ between two
    evaluations, so the partitioned rows (with their partition id) are written
    once to the shared checkpoint folder and both passes read that copy.
    """
    from ..session import materialize, range_partitions
    n = partitions or range_partitions(df.sparkSession)
    ranged = materialize(df.repartitionByRange(n, *order)
                         .withColumn("__pid", F.spark_partition_id()), "ranged")
    w_in = Window.partitionBy("__pid").orderBy(*order)
    numbered = ranged.withColumn("__rn", F.row_number().over(w_in))
    counts = numbered.groupBy("__pid").agg(F.max("__rn").alias("__cnt"))
    w_off = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__cnt").over(w_off), F.lit(0))
                            .alias("__off"))
    return (numbered.join(F.broadcast(offsets), "__pid")
            .withColumn(out, (F.col("__off") + F.col("__rn") + F.lit(start - 1)).cast("long"))
            .drop("__pid", "__rn", "__off"))


def running_total(df: DataFrame, order: str, cols: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Add ``cum_<c>``: the sum of ``c`` over all rows up to and including each row
    in ascending ``order`` (a column of distinct values).

    As in ``dense_row_id``, rows are range-partitioned and stored once; each partition
    adds its own sums to those of the partitions before it (one row per partition)."""
    from ..session import materialize, range_partitions
    n = partitions or range_partitions(df.sparkSession)
    ranged = materialize(df.repartitionByRange(n, order)
                         .withColumn("__pid", F.spark_partition_id()), "ranged-sums")
    w_in = Window.partitionBy("__pid").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    w_off = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("__pid").agg(*[F.sum(c).alias(f"__s_{c}") for c in cols])
    offsets = sums.select("__pid", *[F.coalesce(F.sum(f"__s_{c}").over(w_off), F.lit(0)).alias(f"__o_{c}")
                                     for c in cols])
    out = ranged
    for c in cols:
        out = out.withColumn(f"cum_{c}", F.sum(c).over(w_in))
    out = out.join(F.broadcast(offsets), "__pid")
    for c in cols:
        out = out.withColumn(f"cum_{c}", F.col(f"cum_{c}") + F.col(f"__o_{c}"))
    return out.drop("__pid", *[f"__o_{c}" for c in cols])


def share_of_total(df: DataFrame, count_col: str, out: str = "percentage",
                   digits: int | None = 1) -> DataFrame:
    """``count * 100 / total`` with the total joined as a one-row table (WIN-4).

    The total is an aggregate over the (already grouped) input, so it is one
    row; joining it avoids a window without partition keys, which would pull
    all rows into one task.
    """
    total = df.agg(F.sum(count_col).alias("__total"))
    pct = F.col(count_col) * F.lit(100.0) / F.nullif(F.col("__total"), F.lit(0))
    if digits is not None:
        pct = F.round(pct, digits)
    return df.crossJoin(F.broadcast(total)).withColumn(out, pct).drop("__total")


def rank_column(df: DataFrame, order: Sequence[Column | str], out: str = "rank") -> DataFrame:
    """1-based rank column over an already bounded (top-n) frame (WIN-3)."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(*order)))
