"""Join helpers (JOI-*).

No dimension that grows with the data is broadcast by hint: Spark's adaptive
execution measures the join sides at run time and converts a join to a
broadcast only when a side is below ``spark.sql.autoBroadcastJoinThreshold``.
Explicit ``broadcast`` hints are kept for sides whose size is fixed by
construction (code tables, level lists, one-row totals).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_with_fallback(left: DataFrame, right: DataFrame, on: str | Sequence[str],
                       value: str, fallback: Column, out: str | None = None) -> DataFrame:
    """``left ⟕ right`` with ``coalesce(right.value, fallback)`` (JOI-1, JOI-6)
    and a 0/1 ``matched`` column."""
    r = right.withColumn("__matched", F.lit(1))
    j = left.join(r, on, "left")
    return (j.withColumn(out or value, F.coalesce(F.col(value), fallback))
            .withColumn("matched", F.coalesce(F.col("__matched"), F.lit(0)))
            .drop("__matched"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str | Sequence[str],
            parent_key: str | Sequence[str] | None = None) -> DataFrame:
    """Child rows without a parent row (JOI-5, VAL-3)."""
    ck = [child_key] if isinstance(child_key, str) else list(child_key)
    pk = ck if parent_key is None else ([parent_key] if isinstance(parent_key, str)
                                        else list(parent_key))
    p = parent.select(*[F.col(a).alias(b) for a, b in zip(pk, ck)])
    return child.join(p, ck, "left_anti")


# a side of at most this many (narrow) rows is broadcast after it was counted
BROADCAST_ROWS = 10_000


def lookup_join(df: DataFrame, lookup: DataFrame, on: str, columns: Sequence[str] | None = None
                ) -> DataFrame:
    """Left join to a code table (JOI-7). The table is counted (a limited scan) and
    broadcast if it has at most ``BROADCAST_ROWS`` rows; a larger one is joined by a
    shuffle, whose skewed partitions adaptive execution splits."""
    lk = lookup if columns is None else lookup.select(on, *columns)
    few = lk.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(lk) if few else lk, on, "left")


def with_key_total(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Add the total of ``value`` over each row's ``key``. Totals are aggregated
    before the shuffle and stored, so both sides of the join are plain exchanges and
    the rows of a hot key can be split over tasks."""
    from ..session import materialize
    totals = materialize(df.groupBy(F.col(key).alias("__k")).agg(F.sum(value).alias(out)), "key-totals")
    return df.join(totals, F.col(key) == F.col("__k")).drop("__k")
