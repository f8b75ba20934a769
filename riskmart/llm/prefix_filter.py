"""Prefix, position and parity filter for the pairs that signatures leave open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, store

PARITY = 512          # bits of a set's parity sketch, in longs
WORDS = [f"b{i}" for i in range(PARITY // 64)]


def parity_bits(e: Column) -> list[Column]:
    """Aggregates: every element flips one of ``PARITY`` bits of its set's sketch, so two
    sketches differ in at most as many bits as the sets differ in elements."""
    at = F.pmod(e, F.lit(PARITY))
    bit = F.expr("shiftleft(1L, cast(pmod(e, 64) as int))")
    return [F.bit_xor(F.when(F.floor(at / 64) == i, bit).otherwise(F.lit(0).cast("long"))).alias(w)
            for i, w in enumerate(WORDS)]


def open_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) node pairs that share a key, lie in different components and can have
    Jaccard similarity of at least ``percent`` / 100.

    ``members``: node, c (component), keys (shared signatures); ``sets``: node, elems (the
    node's set, one row per node). A set of which more than 1 - ``percent`` / 100 occurs
    nowhere else has no partner; a share of the hash domain half as large again shows that
    for most sets before the others' elements are listed. With every set sorted by rarity, a
    qualifying pair has a common element among the first n - ceil(p n) + 1 of the
    larger and the first n - ceil(2 p n / (1 + p)) + 1 of the smaller set, and what
    stands before it counts against the overlap. Near copies that each hold elements of
    their own drop out without being paired: their parity sketches differ in more bits
    than a qualifying pair may differ in elements. A row of the join holds one element
    and a sketch, no arrays; shared keys are tested once per pair that is left.
    """
    share = min(64, -(-64 * 3 * (100 - percent) // 200))
    thin = sets.select("node", F.size("elems").alias("n"),
                       F.explode(F.filter("elems", lambda e: F.pmod(e, F.lit(64)) < share)).alias("e"))
    alone = (thin.groupBy("e").agg(F.count("*").alias("df"), F.min("node").alias("node"), F.min("n").alias("n"))
             .where("df = 1").groupBy("node").agg(F.count("*").alias("u"), F.min("n").alias("n"))
             .where(F.lit(100) * F.col("u") > F.lit(100 - percent) * F.col("n")).select("node"))
    members = store(members.join(alone, "node", "left_anti"), "open-members")
    sets = store(sets.join(members.select("node"), "node", "left_semi").select("node", F.explode("elems").alias("e")),
                 "open-sets")
    freq = store(sets.groupBy("e").agg(F.count("*").alias("df")).where("df > 1"), "open-df")
    # elements of one set only come first in its order and are never stored with it: a set
    # is out unless ``percent`` of its elements occur elsewhere too
    common = store(sets.join(freq, "e"), "open-common")
    drop_stored(freq)
    per = store(sets.groupBy("node").agg(F.count("*").alias("n"), *parity_bits(F.col("e"))), "open-sketches")
    drop_stored(sets)
    own = F.col("n") - F.size("es")
    length = F.greatest(F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1 - own, F.lit(0)).cast("int")
    prefix = (common.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("es"))
              .join(per, "node").where(F.lit(100) * F.size("es") >= F.lit(percent) * F.col("n"))
              .join(members.select("node", "c"), "node")
              .select("node", "n", "c", *WORDS, own.alias("own"), F.posexplode(F.slice("es", F.lit(1), length)).alias("q", "x"))
              .select("node", "n", "c", *WORDS, (F.col("own") + F.col("q")).alias("p"), F.col("x.e").alias("e")))
    prefix = store(prefix, "open-prefix")
    drop_stored(common, per)
    short = F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / (100 + percent)) + 1
    x, y = prefix.where(F.col("p") < short).alias("x"), prefix.alias("y")
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    left = F.least(F.col("x.n") - F.col("x.p"), F.col("y.n") - F.col("y.p"))
    both = F.col("x.n") + F.col("y.n")
    differ = sum((F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in WORDS), F.lit(0))
    near = (x.join(y, F.col("x.e") == F.col("y.e"))
            .where(smaller & (F.col("x.c") != F.col("y.c")) & ((100 + percent) * left >= percent * both)
                   & ((100 + percent) * differ <= (100 - percent) * both))
            .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())
    near = store(near, "open-near")
    drop_stored(prefix)
    keys = members.select("node", "keys")
    out = store(near.join(keys.select(F.col("node").alias("a"), F.col("keys").alias("ka")), "a")
                .join(keys.select(F.col("node").alias("b"), F.col("keys").alias("kb")), "b")
                .where(F.arrays_overlap("ka", "kb")).select("a", "b"), "open-pairs")
    drop_stored(near, members)
    return out
