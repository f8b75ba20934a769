"""Ordered limits, samples and splits (TOP-*, SRC-5).

``orderBy(...).limit(n)`` plans as ``TakeOrderedAndProject``: every partition
keeps its own best ``n`` rows and only those reach the final merge, so the
cost is one pass with O(n) memory per task regardless of data size.
Sampling and splitting use a deterministic integer hash of the row key, so no
shuffle is needed and results are reproducible in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def top_k(df: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """First ``n`` rows under ``order`` (TOP-1..5, TOP-7)."""
    return df.orderBy(*order).limit(n)


def bounded_scan(df: DataFrame, n: int, order: Sequence[Column | str] | None = None) -> DataFrame:
    """At most ``n`` rows of a layer (SRC-5, TOP-8); ordered by a key when
    given so the rows are reproducible."""
    return (df.orderBy(*order) if order else df).limit(n)


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows with the smallest key hash: a seeded sample (TOP-9)."""
    return (df.withColumn("__h", S.hash_rank(key, seed))
            .orderBy("__h", key).limit(n).drop("__h"))


def hash_split(df: DataFrame, key: str, train_per_mille: int = 800, seed: int = 42,
               out: str = "split") -> DataFrame:
    """Mark rows ``train``/``test`` by hash bucket (TOP-11); no shuffle."""
    h = F.pmod(S.hash_rank(key, seed), F.lit(1000))
    return df.withColumn(out, F.when(h < F.lit(train_per_mille), F.lit("train"))
                         .otherwise(F.lit("test")))
