"""Exact quantiles with bounded memory per task (AGG-17, AGG-18).

``percentile``/``median`` keep a value -> count map and merge it in one task, so on
a continuous column their final step holds every distinct value. Here all wanted
ranks of all columns narrow value brackets together: one pass asks
``percentile_approx`` (whose sketch has a fixed size) for a value just below and just
above each rank inside its bracket, a second counts the rows below, at, and between
those values. A rank that falls on one of the two values is answered by the counts;
otherwise its bracket becomes the open interval it fell into, which leaves the two
values out, so ties cannot stall the search and a sketch that missed only costs a
pass. Brackets with at most ``max_candidates`` rows are read by one last pass. Only a
few numbers per rank reach the driver, and the path is the same at every size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CANDIDATES = 10_000
ACCURACY = 10_000


class _Rank:
    """The search for the k-th smallest (0-based) of one column."""

    def __init__(self, x: Column, k: int, n: int):
        self.x, self.k = x, k
        self.lo = self.hi = None          # open bracket
        self.below, self.within = 0, n
        self.value = None

    def inside(self) -> Column:
        c = self.x.isNotNull()
        if self.lo is not None:
            c = c & (self.x > F.lit(self.lo))
        if self.hi is not None:
            c = c & (self.x < F.lit(self.hi))
        return c

    def narrow(self, a: float, b: float, lt: int, at_a: int, mid: int, at_b: int) -> None:
        r = self.k - self.below
        if r < lt:
            self.hi, self.within = a, lt
        elif r < lt + at_a:
            self.value = a
        elif r < lt + at_a + mid:
            self.lo, self.hi = a, b
            self.below, self.within = self.below + lt + at_a, mid
        elif a != b and r < lt + at_a + mid + at_b:
            self.value = b
        else:
            done = lt + at_a + mid + (at_b if a != b else 0)
            self.lo = b
            self.below, self.within = self.below + done, self.within - done


def _select(df: DataFrame, ranks: list[_Rank], max_candidates: int, accuracy: int) -> None:
    while True:
        wide = [r for r in ranks if r.value is None and r.within > max_candidates]
        if not wide:
            break
        eps = 2.0 / accuracy
        asked = []
        for i, r in enumerate(wide):
            f = (r.k - r.below) / r.within
            at = F.array(F.lit(max(0.0, f - eps)), F.lit(min(1.0, f + eps)))
            asked.append(F.percentile_approx(F.when(r.inside(), r.x), at, accuracy).alias(f"p{i}"))
        found = df.agg(*asked).first()
        counts = []
        for i, r in enumerate(wide):
            a, b = found[f"p{i}"]
            inside = r.inside()
            for name, c in (("lt", r.x < a), ("a", r.x == a), ("m", (r.x > a) & (r.x < b)), ("b", r.x == b)):
                counts.append(F.count(F.when(inside & c, 1)).alias(f"{name}{i}"))
        n = df.agg(*counts).first()
        for i, r in enumerate(wide):
            r.narrow(*found[f"p{i}"], n[f"lt{i}"], n[f"a{i}"], n[f"m{i}"], n[f"b{i}"])
    left = [r for r in ranks if r.value is None]
    if left:
        # at most max_candidates values each
        row = df.agg(*[F.get(F.sort_array(F.collect_list(F.when(r.inside(), r.x))), F.lit(r.k - r.below))
                       .alias(f"v{i}") for i, r in enumerate(left)]).first()
        for i, r in enumerate(left):
            r.value = row[f"v{i}"]


def column_quantiles(df: DataFrame, cols: Sequence[str], qs: float | Sequence[float],
                     max_candidates: int = MAX_CANDIDATES, accuracy: int = ACCURACY) -> list:
    """Linear-interpolated quantiles (pandas/``quantile_cont`` rule) of several
    columns, nulls and NaN skipped: one value per column for a single ``q``, else one
    list per column. All columns and ranks share the passes."""
    single = not isinstance(qs, Sequence)
    wanted = [qs] if single else list(qs)
    cols = list(cols)
    x = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    n = df.agg(*[F.count(x[c]).alias(c) for c in cols]).first()
    ranks: dict[tuple[str, int], _Rank] = {}
    for c in cols:
        for q in wanted if n[c] else []:
            low = math.floor(q * (n[c] - 1))
            for k in (low, min(low + 1, n[c] - 1)):
                ranks.setdefault((c, k), _Rank(x[c], k, n[c]))
    _select(df, list(ranks.values()), max_candidates, accuracy)

    def at(c: str, q: float):
        if not n[c]:
            return None
        pos = q * (n[c] - 1)
        low = math.floor(pos)
        a, b = ranks[c, low].value, ranks[c, min(low + 1, n[c] - 1)].value
        return float(a + (b - a) * (pos - low))

    out = [[at(c, q) for q in wanted] for c in cols]
    return [v[0] for v in out] if single else out


def exact_quantiles(df: DataFrame, column: str, qs: Sequence[float], max_candidates: int = MAX_CANDIDATES,
                    accuracy: int = ACCURACY) -> list[float | None]:
    """Quantiles of one column."""
    return column_quantiles(df, [column], list(qs), max_candidates, accuracy)[0]


def quantile_row(df: DataFrame, column: str, q: float, name: str) -> DataFrame:
    """One-row DataFrame with the exact quantile (for broadcast joins)."""
    v = column_quantiles(df, [column], q)[0]
    return df.sparkSession.range(1).select(F.lit(v).cast("double").alias(name))


def medians_row(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the exact median of each column."""
    vals = column_quantiles(df, cols, 0.5)
    return df.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(c)
                                             for c, v in zip(cols, vals)])


def grouped_exact_quantiles(df: DataFrame, keys: Sequence[str], column: str,
                            qs: Sequence[float], partitions: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one row per group with one
    column ``q<i>`` per requested quantile; no task holds a whole group.

    Equal values of a group are counted first. The (keys, value, count) rows are then
    range-partitioned on (keys, value), so a group that holds a third of the data is
    spread over many partitions. A row covers the ranks from the counts before it in its
    (partition, group) segment plus the sizes of the group's segments in earlier
    partitions; a group's quantiles come from the few rows that cover a wanted rank.
    The joins are hinted: the stored rows compress to a small file, by which Spark would
    take them for a table that fits into a broadcast.
    """
    from pyspark.sql import Window

    from ..session import materialize, range_partitions
    keys = list(keys)
    spark = df.sparkSession
    n = partitions or range_partitions(spark)
    base = df.select(*keys, F.col(column).cast("double").alias("__x")).where(
        F.col("__x").isNotNull() & ~F.isnan("__x"))
    for k in keys:   # rows with a null group key are left out, as pandas groupby does
        base = base.where(F.col(k).isNotNull())
    counted = base.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__c"))
    # range boundaries come from a sample: fix them by writing the rows once
    ranged = materialize(counted.repartitionByRange(n, *keys, "__x")
                         .withColumn("__pid", F.spark_partition_id()), "grouped-q")
    local = ranged.withColumn("__end", F.sum("__c").over(
        Window.partitionBy("__pid", *keys).orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)))
    # at most (groups + partitions) rows
    seg = ranged.groupBy("__pid", *keys).agg(F.sum("__c").alias("__cnt"))
    w_all = Window.partitionBy(*keys)
    w_off = w_all.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.select("__pid", *keys, F.sum("__cnt").over(w_all).alias("__n"),
                     F.coalesce(F.sum("__cnt").over(w_off), F.lit(0)).alias("__off"))
    ranked = local.join(seg.hint("merge"), ["__pid", *keys]).select(
        *keys, "__x", "__n", (F.col("__off") + F.col("__end") - F.col("__c")).alias("__lo"),
        (F.col("__off") + F.col("__end")).alias("__hi"))
    # wanted ranks per group: floor and ceil of q * (n - 1)
    found = []
    for i, q in enumerate(qs):
        pos = F.lit(float(q)) * (F.col("__n") - 1)
        for name, r in ((f"__a{i}", F.floor(pos)), (f"__b{i}", F.ceil(pos))):
            found.append(F.when((r >= F.col("__lo")) & (r < F.col("__hi")), F.col("__x")).alias(name))
    names = [f"__{side}{i}" for i in range(len(qs)) for side in "ab"]
    picked = (ranked.select(*keys, "__n", *found).where(F.coalesce(*names).isNotNull())
              .groupBy(*keys).agg(F.max("__n").alias("__n"), *[F.max(c).alias(c) for c in names]))

    def value(i: int, q: float) -> Column:
        pos, a, b = F.lit(float(q)) * (F.col("__n") - 1), F.col(f"__a{i}"), F.col(f"__b{i}")
        return (a + (b - a) * (pos - F.floor(pos))).alias(f"q{i}")

    return picked.select(*keys, *[value(i, q) for i, q in enumerate(qs)])
