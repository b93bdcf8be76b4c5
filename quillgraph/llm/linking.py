"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillgraph.llm.scratch import Scratch
from quillgraph.session import materialise


def connected(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is its smallest node.

    Alternates large-star and small-star steps until the links are stars around the
    smallest nodes, which links that are stars already are at once.  Minima are taken by
    aggregation before they are shuffled, and every step is written, so neither a node of
    many links nor a long chain grows a task or the lineage.
    """
    state = materialise(links.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(state):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.select("u", F.col("m").alias("v")).unionByName(
            met.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        state = materialise(small, replaces=state)
    if scratch is not None:
        scratch.keep(state)
    roots = state.select(F.col("v").alias("node")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.withColumn("component", F.col("node")))


def _stars(links: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has one only, and that one has none."""
    ends = F.explode(F.array(
        F.struct(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")
    counted = links.select(ends).groupBy("e.n").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return counted.filter("up > 1 or (up = 1 and down = 1)").isEmpty()
