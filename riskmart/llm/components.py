"""Connected components of an edge table by alternating large and small stars.

Each round rewires every edge towards the smallest neighbour; the number of
rounds grows with the logarithm of the graph. Only whether a round was the last
reaches the driver. The table of smallest neighbours is stored before it is joined, so both
sides of that join are plain exchanges and a hub's edges can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, store


def _stars(e: DataFrame) -> bool:
    """Whether every node has one neighbour or is one: then the neighbours are the smallest
    nodes of their components, as every edge points to a smaller node."""
    ends = e.select("u", F.lit(1).alias("up"), F.lit(0).alias("low")) \
        .union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("low").alias("low")) \
        .where("up > 1 OR up = 1 AND low = 1").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link and is not itself the
    smallest of its component; ``component`` is the smallest node reachable.

    Rows with a null end and self-links say nothing and are left out; repeated
    links count once; an empty table gives an empty result.
    """
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"),
                      F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y"))
         .where("x AND y AND u != v").select("u", "v").distinct())
    e = store(e, "cc-edges")
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = store(both.groupBy("u").agg(F.min("v").alias("m"))
                    .select("u", F.least("u", "m").alias("m")), "cc-low")
        large = store(both.join(low, "u").where("v > u")
                      .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        least = store(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = (large.join(least, "u").where("v != m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        nxt = store(small, "cc-edges")
        drop_stored(e, low, large, least)
        e = nxt
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def merged(comp: DataFrame, into: DataFrame) -> DataFrame:
    """``comp`` (node, component) after its components themselves are joined by ``into``,
    the result of ``connected_components`` over them: a join instead of a new search."""
    onto = into.select(F.col("node").alias("component"), F.col("component").alias("__into"))
    moved = comp.join(onto, "component", "left").select("node", F.coalesce("__into", "component").alias("component"))
    # a component is named by its smallest node, which ``comp`` has no row for
    return store(moved.unionByName(into.select("node", "component")), "cc-merged")


def component_edges(links: DataFrame, comp: DataFrame) -> DataFrame:
    """(ca, cb): the components of the ends of the links (a, b)."""
    def side(x: str) -> DataFrame:
        return comp.select(F.col("node").alias(x), F.col("component").alias(f"__{x}"))
    return (links.join(side("a"), "a", "left").join(side("b"), "b", "left")
            .select(F.coalesce("__a", "a").alias("ca"), F.coalesce("__b", "b").alias("cb")))
