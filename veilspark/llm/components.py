"""Connected components of a table of links by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small, written


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) from links (a, b); nodes without a link do not appear.

    Each round gives the nodes a new random order, moves every node to the first of itself
    and its neighbours, and relabels the links; loops and repeats go. The expected number
    of links falls by a constant share each round, whatever the shape of a component. The
    moves of all rounds are composed from the last to the first. Nothing is collected;
    null ends and loops are dropped; an empty table gives an empty result.
    """
    edges = links.select("a", "b").where(F.col("a") != F.col("b"))
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        order = lambda c, n=len(moves): F.struct(F.xxhash64(F.col(c), F.lit(n)).alias("h"), F.col(c).alias("v"))
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        step = both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", order("a")).getField("v").alias("to"))
        step = written(step, "cc-moves")
        moves.append(step)
        step = small(step)
        ends = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").select("x", "b")
        ends = ends.join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").where(F.col("x") != F.col("y"))
        edges = written(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-links")
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    root = moves[-1]
    for step in reversed(moves[:-1]):
        later = small(root).select(F.col("node").alias("to"), F.col("to").alias("root"))
        root = written(step.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("to")), "cc-root")
    least = written(root.groupBy("to").agg(F.min("node").alias("n")).select("to", F.least("n", "to").alias("component")), "cc-least")
    return written(root.join(small(least), "to").select("node", "component"), "cc-components")


def extended(found: DataFrame, links: DataFrame) -> DataFrame:
    """node, component of what components() found and of further links (a, b); only classes that new links join are worked on."""
    links = links.select("a", "b").where(F.col("a") != F.col("b"))
    of = small(found.select("node", "component"))
    label = lambda c: of.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    ends = links.join(label("a"), "a", "left").join(label("b"), "b", "left")
    joined = components(ends.select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b")))
    fresh = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(of, "node", "left_anti")
    every = found.select("node", "component").union(fresh.select("node", F.col("node").alias("component")))
    moved = every.join(small(joined).select(F.col("node").alias("component"), F.col("component").alias("into")), "component", "left")
    return written(moved.select("node", F.coalesce("into", "component").alias("component")), "cc-extended")
